"""Table functions for SQL: chunks of a file, windows of a text, citations of an answer, called by lateral join.

    SELECT f.file_path, c.* FROM files f, LATERAL chunks(f.file_path, f.source) c

Each is a user-defined table function whose rows go through Arrow; it sees one text at a time.  A null text has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .. import model
from ..operators import chunk_generic, chunk_tsjs
from ..sources.walk import extension_of

_KINDS = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType()}
_CITATION = re.compile(model.CITATION_PATTERN)


def _schema(ddl: str, *arguments: AnalyzeArgument, kinds: tuple[str, ...]) -> AnalyzeResult:
    given = tuple(a.dataType.simpleString() for a in arguments)
    if len(given) != len(kinds) or any(g not in (k, "void") for g, k in zip(given, kinds)):
        raise ValueError(f"expected ({', '.join(kinds)}), got ({', '.join(given)})")
    fields = (f.split(" ") for f in ddl.split(", "))  # there is no session here to parse them
    return AnalyzeResult(StructType([StructField(name, _KINDS[kind]) for name, kind in fields]))


class Chunks:
    """chunks(file_path, source): what :func:`chunking.chunk_files` makes of one file, with the chunk's place in it; a file that cannot be chunked has no rows."""

    @staticmethod
    def analyze(file_path: AnalyzeArgument, source: AnalyzeArgument) -> AnalyzeResult:
        return _schema(f"place int, {model.CHUNK_FIELDS}", file_path, source, kinds=("string", "string"))

    def eval(self, file_path: str, source: str) -> Iterator[tuple]:
        if file_path is None or source is None:
            return
        extension = extension_of(file_path.rsplit("/", 1)[-1])
        chunker = chunk_tsjs.chunk if extension in model.TSJS_EXTENSIONS else chunk_generic.chunk
        try:
            found = list(chunker(file_path, model.LANGUAGES.get(extension, "unknown"), source)[1])
        except Exception:  # as in chunk_files: one file's failure is not the end of the query
            return
        names = [f.split(" ")[0] for f in model.CHUNK_FIELDS.split(", ")]
        for place, chunk in enumerate(found):
            yield place, *(chunk[n] for n in names)


class Windows:
    """windows(text, tokens): greedy runs of lines within the budget."""

    @staticmethod
    def analyze(text: AnalyzeArgument, tokens: AnalyzeArgument) -> AnalyzeResult:
        return _schema("part_index int, part_total int, start_line int, end_line int, content string", text, tokens, kinds=("string", "int"))

    def eval(self, text: str, tokens: int) -> Iterator[tuple]:
        found = chunk_generic.split_by_lines(text, 1, tokens) if text is not None and tokens is not None else []
        for k, span in enumerate(found, 1):
            yield k, len(found), span.start, span.end, span.text


class Citations:
    """citations(answer): place (from 0), raw, file_path, start_line, end_line."""

    @staticmethod
    def analyze(answer: AnalyzeArgument) -> AnalyzeResult:
        return _schema("place int, raw string, file_path string, start_line int, end_line int", answer, kinds=("string",))

    def eval(self, answer: str) -> Iterator[tuple]:
        for place, found in enumerate(_CITATION.finditer(answer or "")):
            lines = [int(x) if x is not None and int(x) < 1 << 31 else None for x in found.group(2, 3)]
            yield place, found[0], found[1], lines[0], lines[1] if lines[1] is not None else lines[0]


FUNCTIONS = {"chunks": Chunks, "windows": Windows, "citations": Citations}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler, useArrow=True))
