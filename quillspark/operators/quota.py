"""Calls to a service by several tasks under one shared quota: barrier tasks deal out each minute's texts among themselves.

The tasks run at the same time and meet before each round (``allGather``): each tells whether it has texts left and how long the
service asked it to wait.  All then know the same and come to the same shares: the round's texts are dealt out evenly to those that have any, the
remainder in turn.  A round begins a minute after the last call of the round before, or later if the service asked for that, so no
minute, wherever it begins, sees more than the quota.  A batch that was refused is tried again in the next round.  If one
task gives up (the daily quota, too many refusals, any other error) Spark ends all of them: all or nothing.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model


def shares(asking: list[bool], batches: int, turn: int) -> list[int]:
    """How many of ``batches`` each task gets."""
    some = [k for k, more in enumerate(asking) if more]
    out = [0] * len(asking)
    for place in range(len(some)):
        out[some[(place + turn) % len(some)]] = batches // len(some) + (place < batches % len(some))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _call(batches: Iterator[pa.RecordBatch], call: Callable, checked: Callable, refused: Callable, per_minute: int, minute: float, retries: int, column: str) -> Iterator[pa.RecordBatch]:
    context, turn, attempt, wait = BarrierTaskContext.get(), 0, 0, 0.0
    size = min(model.BATCH_SIZE, per_minute)
    todo = _pieces(batches, size)
    held = next(todo, None)
    while True:
        told = [json.loads(x) for x in context.allGather(json.dumps([held is not None, wait]))]
        if not any(more for more, _ in told):
            return
        if turn:
            time.sleep(max(minute, max(w for _, w in told)))
        wait = 0.0
        for _ in range(shares([more for more, _ in told], per_minute // size, turn)[context.partitionId()]):
            if held is None:
                break
            texts = held.column(1).to_pylist()
            try:
                made = checked(texts, call(texts))
            except Exception as error:
                wait = refused(error, attempt) if attempt < retries else None
                if wait is None:
                    raise
                attempt += 1
                break
            attempt = 0
            yield pa.RecordBatch.from_arrays([held.column(0), made], names=[held.schema.names[0], column])
            held = next(todo, None)
        turn += 1


def mapped(rows: DataFrame, call: Callable, checked: Callable, refused: Callable, schema: str, tasks: int, per_minute: int, minute: float = 60.0, retries: int = model.MAX_RETRIES) -> DataFrame:
    """``rows``: key, text -> key, result.  ``call``: texts -> results; ``checked``: (texts, results) -> an Arrow array of them;
    ``refused``: (error, attempt) -> seconds to wait before another try, or None to give up.

    At most ``tasks`` tasks, which must all find a slot; ``per_minute``: texts that all of them may send within ``minute`` seconds.
    """
    if per_minute < 1:
        raise ValueError("per_minute: expected 1 or more")
    work = partial(_call, call=call, checked=checked, refused=refused, per_minute=per_minute, minute=minute, retries=retries, column=schema.split(", ")[1].split(" ")[0])
    spread = rows.repartition(tasks, F.xxhash64(rows.columns[0]))
    return spread.mapInArrow(work, schema, barrier=True)
