"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over the words of whole documents, find
the n-grams that occur again later in the same document; the characters that lie inside such later
occurrences, and inside later copies of a line, are measured against all characters in words.  A
document whose repeated share exceeds the published limits of a length is rejected.

One pass over the documents, no shuffle: every document is judged alone, so no key can be hot.

Defined results: a null text counts as a text without words; an empty text or one of white space
has n_words 0 and fails the base rule; repeated rows give repeated results; an empty table gives an
empty result; further columns of the input do not matter (the id column is carried as it is, nulls
included).  Texts are never cut: a slice holds at least one whole document,
and a worker needs about 100 bytes for each byte of its longest one.  Words and lines are compared by
their bytes and windows by their words, so a hash that two of them share changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import SPACE, Texts, byte_class, mix, slices, window_hashes
from .lookup import whole_row

#: Largest share of word characters inside later occurrences of an n-gram, by n (limits published for web text).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of word characters inside later copies of a line.
LINE_LIMIT = 0.30
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_NEWLINE = byte_class((10, 10))
_CONTINUATION = byte_class((0x80, 0xBF))

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_chars long, worst_ngram_share double, kept boolean"
)


def _occurrences(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, exact: Callable[[], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is its key met again anywhere, and was it met before?

    ``same`` compares entries (by place) that share a key; if a key joins unequal ones, ``exact`` gives
    keys that do not.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    met = keys[order][1:] == keys[order][:-1]
    later, earlier = order[1:][met], order[:-1][met]
    if same is not None and not same(later, earlier).all():
        return _occurrences(exact())
    again, before = np.zeros(n, bool), np.zeros(n, bool)
    before[later] = True
    again[earlier] = True
    return again | before, before


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of n words that begins at one of ``starts``."""
    change = np.zeros(total + 1, np.int32)
    change[starts] += 1
    change[starts + n] -= 1
    return np.cumsum(change[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray, limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """All figures of the documents in one slice."""
    words = Texts(data, offsets, SPACE)
    n_docs, total = len(offsets) - 1, len(words.starts)
    code_points = 1 - _CONTINUATION[data]
    in_word = code_points * (1 - SPACE[data])
    char_prefix = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=char_prefix[1:])
    word_len = char_prefix[words.ends] - char_prefix[words.starts]
    word_chars = words.per_doc(in_word)
    doc, kind = words.doc_of_word(), words.kinds()[1]
    hashes, salt = mix(kind.astype(np.uint64) + np.uint64(1)), mix(~doc.astype(np.uint64))

    def windows(n: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the (chosen) n-word windows inside one document; which are met again, which before."""
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
        inside = doc[: total - n + 1] == doc[n - 1 :]
        at = np.flatnonzero(inside if chosen is None else inside & chosen[: total - n + 1])

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            equal = doc[at[a]] == doc[at[b]]
            for k in range(n):
                equal &= kind[at[a] + k] == kind[at[b] + k]
            return equal

        def exact() -> np.ndarray:
            return np.unique(np.column_stack([doc[at], *(kind[at + k] for k in range(n))]), axis=0, return_inverse=True)[1].ravel()

        return at, *_occurrences(window_hashes(hashes, n)[at] ^ salt[at], same, exact)

    at, again, _ = windows(WINDOW)
    n_repeat = words.per_doc_words(_covered(at[again], WINDOW, total))

    worst, ngram_bad = np.zeros(n_docs), np.zeros(n_docs, bool)
    safe = np.maximum(word_chars, 1)
    maybe = None  # starts of shorter n-grams met again: a longer one met again begins at one of them
    for n in sorted(limits):
        at, again, before = windows(n, maybe)
        maybe = np.zeros(total, bool)
        maybe[at[again]] = True
        share = words.per_doc_words(_covered(at[before], n, total) * word_len) / safe
        worst = np.maximum(worst, share)
        ngram_bad |= share > limits[n]

    lines = Texts(data, offsets, _NEWLINE)
    line_prefix = np.zeros(len(data) + 1, np.int64)
    np.cumsum(1 - SPACE[data], out=line_prefix[1:])
    has_word = line_prefix[lines.ends] > line_prefix[lines.starts]
    line_doc = lines.doc_of_word()
    _, before = _occurrences(lines.kinds()[1] * n_docs + line_doc)
    repeated = before & has_word
    line_chars = char_prefix[lines.ends] - char_prefix[lines.starts]
    dup_line_chars = lines.per_doc_words(repeated * line_chars)

    n_words = words.n_words
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": words.per_doc(SYMBOLS[data]),
        "n_dup_lines": lines.per_doc_words(repeated),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "dup_line_chars": dup_line_chars,
        "worst_ngram_share": worst,
        "kept": ~(failed | ngram_bad | (dup_line_chars / safe > line_limit)),
    }


def _judge(batches: Iterator[pa.RecordBatch], limits: dict[int, float], line_limit: float, inside: str | None = None) -> Iterator[pa.RecordBatch]:
    """The columns but the text, and the figures; with ``inside`` the struct column alone, of the rows that are kept."""
    for rows, data, offsets in slices(batches, inside=inside):
        figures = measure(data, offsets, limits, line_limit)
        if inside:
            yield pa.RecordBatch.from_arrays([rows.column(0)], names=[inside]).filter(pa.array(figures["kept"]))
            continue
        others = [name for name in rows.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [rows.column(rows.schema.get_field_index(c)) for c in others] + [pa.array(v) for v in figures.values()],
            names=others + list(figures),
        )


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per document: its id, its figures and ``kept``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(partial(_judge, limits=limits or NGRAM_LIMITS, line_limit=line_limit), f"doc_id {id_type}, {SCHEMA}")


def filter_quality(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` (all columns, as they are) whose ``text`` is kept; judged row by row, so no join."""
    rows = docs.select(whole_row(docs).alias("row"))
    return rows.mapInArrow(partial(_judge, limits=limits or NGRAM_LIMITS, line_limit=line_limit, inside="row"), rows.schema).select("row.*")
