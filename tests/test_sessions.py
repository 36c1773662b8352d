"""Sessions as a stateful stream against the plain reader of event streams."""

import json
import random

from pyspark.sql import functions as F

from quillspark.streaming import answer, sessions

READS = "session_id string, seq int, ts timestamp, piece string"


def frames(kinds):
    return "".join(f"data: {json.dumps({'type': k, 'text': f'{k} {i} é漢'}, ensure_ascii=False)}\n\n" if k != "ping" else ": ping\n\n" for i, k in enumerate(kinds))


def follow(spark, tmp_path, batches, **options):
    """Run the stream over batches of (session, seq, second, piece); one batch a file, two runs with one checkpoint."""
    place, out = str(tmp_path / "reads"), str(tmp_path / "events")
    for half in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for batch in half:
            rows = spark.createDataFrame(batch, "session_id string, seq int, second long, piece string").select("session_id", "seq", F.timestamp_seconds(F.col("second") + 1_700_000_000).alias("ts"), "piece")
            rows.coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(place)
        sessions.run(stream, out, str(tmp_path / "checkpoint"), **options)
    found = {}
    for r in spark.read.parquet(out).orderBy("session_id", "place").collect():
        found.setdefault(r["session_id"], []).append((r["place"], r["type"], json.loads(r["event"]) if r["type"] != "unknown" else r["event"]))
    return found, spark.read.parquet(out)


def test_any_cuts_and_any_order_give_the_events_of_the_plain_reader(spark, tmp_path):
    draw, streams, reads = random.Random(4), {}, []
    for k in range(12):
        text = frames([draw.choice(["trace", "token", "token", "ping", "citations"]) for _ in range(draw.randint(0, 12))] + (["done", "token"] if k % 2 else [])) + draw.choice(["", "data: {cut"])
        streams[f"s{k}"], cuts = text, sorted(draw.randint(0, len(text)) for _ in range(8))
        reads += [(f"s{k}", seq, draw.randint(0, 5), text[a:b]) for seq, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)]))]
    reads += reads[::7]  # some come twice
    draw.shuffle(reads)
    found, table = follow(spark, tmp_path, [reads[k::4] for k in range(4)])
    for name, text in streams.items():
        want = list(answer.parse_frames([text]))
        ends = [k for k, e in enumerate(want) if e["type"] in sessions.ENDS]
        want = want[: ends[0] + 1] if ends else want
        assert found.get(name, []) == [(k, e["type"], e) for k, e in enumerate(want)], name
    state = {r["session_id"]: r for r in sessions.states(table).collect()}
    for name in found:
        plain = answer.fold(e for _, _, e in found[name])if all(e["type"] in ("token", "done") for _, _, e in found[name]) else None
        if plain:
            assert (state[name]["status"], state[name]["text"]) == (plain["status"], plain["text"])


def test_time_limit_cancels_and_what_comes_later_is_ignored(spark, tmp_path):
    batches = [
        [("slow", 0, 0, frames(["token"])), ("fast", 0, 0, frames(["token", "done"])), ("gap", 1, 0, frames(["token"]))],
        [("slow", 1, 20, frames(["token"])), ("clock", 0, 25, ": ping\n\n")],
        [("clock", 1, 100, ": ping\n\n")],
        [("clock", 2, 101, ": ping\n\n")],
        [("slow", 2, 102, frames(["token"])), ("gap", 0, 102, frames(["token"]))],
        [("clock", 3, 103, ": ping\n\n")],
    ]
    found, table = follow(spark, tmp_path, batches, limit_seconds=30)
    assert [k for _, k, _ in found["slow"]] == ["token", "token", "cancelled"] and [k for _, k, _ in found["fast"]] == ["token", "done"]
    assert [(p, k, e) for p, k, e in found["gap"]] == [(0, "cancelled", {"type": "cancelled", "elapsedMs": 30_000})]
    assert {r["session_id"]: r["status"] for r in sessions.states(table).collect()} == {"slow": "cancelled", "fast": "done", "gap": "cancelled", "clock": "cancelled"}


def test_odd_reads(spark, tmp_path):
    odd = [("a", 0, 0, None), ("a", 1, 0, 'data: no json\n\ndata: [1]\n\ndata: {"type": 5}\n\nevent: x\n\n'), ("a", 2, 0, 'data: {"type":\ndata: "token"}\n\n'), (None, 0, 0, frames(["token"])), ("b", None, 0, frames(["token"])), ("", 0, 0, frames(["token"]))]
    found, _ = follow(spark, tmp_path, [odd, [("c", 0, 0, "x" * 50_000)]])
    assert [k for _, k, _ in found["a"]] == ["unknown", "unknown", "unknown", "token"] and set(found) == {"a", ""}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
