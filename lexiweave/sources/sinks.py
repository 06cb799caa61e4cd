"""Lexicon and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import escape

#: Header of a derived regional lexicon.
REGIONAL_HEADER = "# Derived from regional phrases; do not edit by hand."


def lexicon_lines(entries: DataFrame) -> DataFrame:
    """value: ``key TAB value value`` lines in key order."""
    return entries.orderBy("key").select(F.concat_ws("\t", "key", F.concat_ws(" ", "candidates")).alias("value"))


def lexicon_text(entries: DataFrame, header: str | None = None) -> DataFrame:
    """(lexicon, text): each lexicon of a frame as one text, with its header."""
    line = F.concat_ws("\t", "key", F.concat_ws(" ", "candidates"))
    rows = entries.groupBy("lexicon").agg(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))).alias("rows"))
    body = F.concat(F.array_join(F.col("rows.line"), "\n"), F.lit("\n"))
    return rows.select("lexicon", (F.concat(F.lit(header + "\n"), body) if header else body).alias("text"))


def dump_lines(entries: DataFrame) -> DataFrame:
    """value: entries with every field escaped, tab-separated, in key order."""
    fields = entries.select("lexicon", "key", F.posexplode("candidates").alias("n", "c"))
    coded = fields.select("lexicon", "key", "n", escape(F.col("key")).alias("k"), escape(F.col("c")).alias("v"))
    rows = coded.groupBy("lexicon", "key", "k").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("vs"))
    return rows.orderBy("lexicon", "key").select(F.concat_ws("\t", "k", F.array_join(F.col("vs.v"), "\t")).alias("value"))


def drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, state (missing, different, stale) of (path, content) frames that disagree."""
    a = expected.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("want"))
    b = found.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "stale").when(F.col("want") != F.col("have"), "different")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def bench_lines(measures: DataFrame) -> DataFrame:
    """value: ``[bench] key=value`` fields of every row."""
    parts = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in measures.columns]
    return measures.select(F.concat(F.lit("[bench] "), F.concat_ws(" ", *parts)).alias("value"))
