"""Lexical index terms and the query language of the lexical leg.

Terms are runs of letters, digits and signs outside ASCII in lower case; stop words are left out of
the index but keep their places, so phrases stay exact.  A query is an AND of words, quoted phrases
and ``-`` exclusions; ``or`` between two of them asks for either; it never fails: what cannot be read is ignored, and a query without a positive
term matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: common English words that are not indexed.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
TERM = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_PY_TERM = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def terms(text: Column) -> Column:
    """All terms in order, stop words too."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def indexed_text() -> Column:
    """What of a chunk is indexed: symbol, signature and content."""
    return F.concat(F.coalesce("symbol_name", F.lit("")), F.lit(" "), F.coalesce("signature", F.lit("")), F.lit(" "), F.col("content"))


def lexemes(text: Column, stems: Callable[[Column], Column] | None = None) -> Column:
    """Terms to be stored; stop words become '' and keep their places."""
    found = F.transform(terms(text), lambda t: F.when(t.isin(*STOP_WORDS), F.lit("")).otherwise(t))
    return stems(found) if stems else found


@dataclass(frozen=True)
class Query:
    """``phrases``: each must occur; a single word is a phrase of one.  ``others``: what may stand for all of them."""

    phrases: tuple[tuple[str, ...], ...]
    excluded: tuple[tuple[str, ...], ...]
    others: tuple[Query, ...] = ()

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys([w for p in self.phrases for w in p] + [w for q in self.others for w in q.words]))


def parse_query(text: str, stem: Callable[[str], str] = lambda w: w) -> Query:
    wanted: list[tuple[str, ...]] = []
    excluded: list[tuple[str, ...]] = []
    either: list[Query] = []

    def ended() -> Query:
        return Query(tuple(dict.fromkeys(wanted)), tuple(dict.fromkeys(excluded)))

    for found in re.finditer(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if (found[3] or "").lower() == "or" and not found[1]:
            either.append(ended())
            wanted, excluded = [], []
            continue
        words = tuple(stem(w) for w in _PY_TERM.findall((found[2] if found[2] is not None else found[3]).lower()) if w not in STOP_WORDS)
        if words:
            (excluded if found[1] else wanted).append(words)
    first, *others = [q for q in (*either, ended()) if q.phrases] or [ended()]
    return Query(first.phrases, first.excluded, tuple(others))


def _has(column: Column, phrase: tuple[str, ...]) -> Column:
    every = F.array_contains(column, phrase[0])
    for w in phrase[1:]:
        every = every & F.array_contains(column, w)
    if len(phrase) == 1:
        return every
    kept = F.filter(column, lambda t: t != "")
    want = F.array(*[F.lit(w) for w in phrase])
    starts = F.sequence(F.lit(1), F.greatest(F.size(kept) - len(phrase) + 1, F.lit(1)))
    return every & F.exists(starts, lambda i: F.slice(kept, i, len(phrase)) == want)


def matches(column: Column, query: Query) -> Column:
    if not query.phrases:
        return F.lit(False)
    if query.others:
        result = matches(column, Query(query.phrases, query.excluded))
        for other in query.others:
            result = result | matches(column, other)
        return result
    result = F.lit(True)
    for phrase in query.phrases:
        result = result & _has(column, phrase)
    for phrase in query.excluded:
        result = result & ~_has(column, phrase)
    return result


def rank(column: Column, doc_len: Column, query: Query) -> Column:
    """Occurrences of the query's words, divided by 1 + the logarithm of the document's length."""
    if not query.words:
        return F.lit(0.0)
    hits = F.size(F.filter(column, lambda t: t.isin(*query.words)))
    return hits / (F.lit(1.0) + F.log(F.greatest(doc_len, F.lit(1)).cast("double")))
