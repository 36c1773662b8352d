"""Citations ``path.ext:N-M`` in answers: found, checked by containment, and marked in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CITATION_PATTERN


def parse(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a citation: place (from 0), raw, file_path, start_line, end_line (the start if none is given)."""
    found = answers.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(CITATION_PATTERN), F.lit(0))).alias("place", "raw"))
    start = F.regexp_extract("raw", CITATION_PATTERN, 2).try_cast("int")
    end = F.coalesce(F.nullif(F.regexp_extract("raw", CITATION_PATTERN, 3), F.lit("")).try_cast("int"), start)
    return found.select(id_col, "place", "raw", F.regexp_extract("raw", CITATION_PATTERN, 1).alias("file_path"), start.alias("start_line"), end.alias("end_line"))


def validate(citations: DataFrame, included: DataFrame, id_col: str) -> DataFrame:
    """``included``: id_col, file_path, start_line, end_line of the chunks that the answer was given.
    Valid: some chunk of the file contains the range.  Adds valid, reason and reversed (start after end)."""
    known = included.select(id_col, "file_path", F.col("start_line").alias("k_start"), F.col("end_line").alias("k_end"))
    inside = (F.col("start_line") >= F.col("k_start")) & (F.col("end_line") <= F.col("k_end"))
    met = citations.join(known, [id_col, "file_path"], "left")
    keys = [id_col, "place", "raw", "file_path", "start_line", "end_line"]
    checked = met.groupBy(*keys).agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("valid"), F.count("k_start").alias("of_file"))
    reason = F.when(~F.col("valid"), F.when(F.col("of_file") == 0, "unknown-file").otherwise("range-not-retrieved"))
    return checked.select(*keys, "valid", reason.alias("reason"), (F.col("start_line") > F.col("end_line")).alias("reversed"))


def lookup(checked: DataFrame, id_col: str) -> DataFrame:
    """One status for each raw citation; an invalid one wins over a valid one, the last of equals."""
    last = F.max_by(F.struct("file_path", "start_line", "end_line", "valid", "reason"), F.struct((~F.col("valid")).cast("int"), "place"))
    return checked.groupBy(id_col, "raw").agg(last.alias("s")).select(id_col, "raw", "s.*")


def segments(answers: DataFrame, checked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The text in pieces, in order: text, or citation with its status; unknown citations stay text."""
    text = answers.select(id_col, F.split(F.col(text_col), CITATION_PATTERN).alias("plain"), F.regexp_extract_all(F.col(text_col), F.lit(CITATION_PATTERN), F.lit(0)).alias("raws"))
    pieces = F.flatten(F.transform("plain", lambda p, i: F.array(F.struct((2 * i).alias("place"), p.alias("text"), F.lit(None).cast("string").alias("raw")), F.struct((2 * i + 1).alias("place"), F.get("raws", i).alias("text"), F.get("raws", i).alias("raw")))))
    rows = text.select(id_col, F.inline(F.filter(pieces, lambda x: F.length(x["text"]) > 0)).alias("place", "text", "raw"))
    status = lookup(checked, id_col).select(id_col, "raw", "valid", "reason")
    joined = rows.join(status, [id_col, "raw"], "left")
    return joined.select(id_col, "place", F.when(F.col("valid").isNotNull(), "citation").otherwise("text").alias("type"), "text", "valid", "reason").orderBy(id_col, "place")
