"""Scalar expressions: all built-in functions, so they stay in generated code."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model


#: Fixed value: how an error message names the delay.
RETRY_DELAY = r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"'


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 code units (a character outside the basic plane counts twice)."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("int")


def estimate_tokens(text: Column | str) -> Column:
    return F.ceil(utf16_length(text) / 4).cast("int")


def extension(path: Column | str) -> Column:
    """Lower-cased last extension with its dot; '' for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(col(path), r"([^/]*)$", 1), r"^.+(\.[^.]*)$", 1))


def language_of(path: Column | str) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in model.LANGUAGES.items()))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def route(path: Column | str) -> Column:
    """Which chunker takes a file: the first of the registry that supports its extension."""
    return F.when(extension(path).isin(*model.TSJS_EXTENSIONS), "ts-morph").otherwise("generic")


def _part(label: str, value: str) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), F.col(value)))


def header() -> Column:
    """``file:``, ``kind:`` and the non-empty ones of symbol, parent, signature and jsDoc, a line each."""
    fixed = [F.concat(F.lit("file: "), F.col("file_path")), F.concat(F.lit("kind: "), F.col("kind"))]
    return F.concat_ws("\n", *fixed, _part("symbol", "symbol_name"), _part("parent", "parent_symbol"), _part("signature", "signature"), _part("jsDoc", "js_doc"))


def embed_text() -> Column:
    return F.concat(header(), F.lit("\n\n"), F.col("content"))


def content_hash() -> Column:
    """SHA-256 of the identity of a chunk; lines, signature, jsDoc, kind and repository are not part of it."""
    parts = F.concat_ws("\0", F.col("chunker_kind"), F.col("file_path"), F.coalesce("symbol_name", F.lit("")), F.col("part_index").cast("string"), F.col("content"))
    return F.sha2(parts, 256)


def context_block() -> Column:
    symbol = F.when(F.length("symbol_name") > 0, F.concat(F.lit(" ("), F.col("symbol_name"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("--- "), F.col("file_path"), F.lit(":"), F.col("start_line"), F.lit("-"), F.col("end_line"), symbol, F.lit(" ["), F.col("language"), F.lit("] ---\n"), F.col("content"))


def error_class(name: Column | str, message: Column | str) -> Column:
    """aborted, daily-quota, rate-limit or other, from an error's name and message."""
    limited = col(message).rlike("429") | col(message).rlike("(?i)RESOURCE_EXHAUSTED")
    return F.when(col(name) == "AbortError", "aborted").when(limited & col(message).rlike("(?i)PerDay"), "daily-quota").when(limited, "rate-limit").otherwise("other")


def retry_delay_ms(message: Column | str) -> Column:
    """Delay that the server asks for (``"retryDelay":"1.5s"``), in ms rounded up; null if it names none."""
    seconds = F.regexp_extract(col(message), RETRY_DELAY, 1)
    return F.ceil(F.nullif(seconds, F.lit("")).cast("double") * 1000).cast("long")


def backoff_ms(attempt: Column | str, hint: Column | str, jitter: Column | str) -> Column:
    """The server's hint, else base * 2^attempt plus up to one base of jitter; capped."""
    own = F.lit(model.BASE_DELAY_MS) * F.pow(F.lit(2.0), col(attempt)) + col(jitter) * model.BASE_DELAY_MS
    return F.least(F.coalesce(col(hint).cast("double"), own), F.lit(float(model.MAX_DELAY_MS)))


def tokens_left(text: Column | str) -> Column:
    return F.greatest(F.lit(0), F.lit(model.MAX_OUTPUT_TOKENS) - estimate_tokens(text))


def clamp_end(start: Column | str, end: Column | str) -> Column:
    return F.least(col(end), col(start) + (model.MAX_SOURCE_LINES - 1))


def sse_frame(payload: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))
