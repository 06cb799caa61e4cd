"""Lookups in lexicons as relational operators.

Lexicon frames have ``lexicon, key, candidates``; in groups ``child_ord`` gives
the order of the children.  Joins carry no broadcast hints: Spark broadcasts a
lexicon only where its measured size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_code_point, utf16_length


def exact(texts: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """``texts`` with the candidates of the key that equals a column, NULL for none."""
    lex = lexicon.select(F.col("key").alias(column), "candidates")
    return texts.join(lex, column, "left")


def group_exact(texts: DataFrame, column: str, group: DataFrame) -> DataFrame:
    """As :func:`exact` over the children of a group: the first child that has the key."""
    first = group.groupBy(F.col("key").alias(column)).agg(F.min_by("candidates", "child_ord").alias("candidates"))
    return texts.join(first, column, "left")


def _hits(texts: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """Every key a text begins with: an equi-join of the keys and the texts' prefixes
    of the lengths that keys have (as many as the longest key has characters, at most)."""
    lex = lexicon.where("key <> ''").withColumnRenamed("key", "_key")
    sizes = sorted(r.n for r in lex.select(F.length("_key").alias("n")).distinct().collect())
    if not sizes:
        return texts.join(lex, F.lit(False))
    fitting = F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= F.length(column))
    starts = texts.withColumn("_key", F.explode(F.transform(fitting, lambda n: F.substring(F.col(column), F.lit(1), n))))
    return starts.join(lex, "_key")


def longest_prefix(texts: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """Distinct texts with the length in UTF-16 units and default value of their
    longest prefix in a lexicon; texts without one are left out."""
    hits = _hits(texts.select(column).distinct(), column, lexicon)
    best = hits.groupBy(column).agg(F.max_by(F.struct("_key", "candidates"), F.length("_key")).alias("b"))
    return best.select(column, utf16_length(F.col("b._key")).alias("length"), F.col("b.candidates")[0].alias("value"))


def group_prefix(texts: DataFrame, column: str, group: DataFrame, policy: str) -> DataFrame:
    """As :func:`longest_prefix` in a group: under ``short_circuit`` the first child
    that matches at all, under ``union`` the longest match, earlier children first."""
    hits = _hits(texts.select(column).distinct(), column, group)
    size, child = F.length("_key").desc(), F.col("child_ord").asc()
    order = (child, size) if policy == "short_circuit" else (size, child)
    rank = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    best = hits.withColumn("_n", rank).where("_n = 1")
    return best.select(column, utf16_length(F.col("_key")).alias("length"), F.col("candidates")[0].alias("value"))


def starting(texts: DataFrame, column: str, lexicon: DataFrame) -> DataFrame:
    """Texts whose first code point begins some key."""
    first = lexicon.where("key <> ''").select(first_code_point(F.col("key")).alias("_cp")).distinct()
    return texts.where(F.col(column) != "").withColumn("_cp", first_code_point(F.col(column))).join(first, "_cp", "left_semi").drop("_cp")


def key_starts(lexicon: DataFrame) -> DataFrame:
    """lexicon, starts: sorted first code points of each lexicon's keys."""
    return lexicon.where("key <> ''").groupBy("lexicon").agg(F.array_sort(F.collect_set(first_code_point(F.col("key")))).alias("starts"))


def group_index(lexicon: DataFrame) -> DataFrame:
    """lexicon, code_point, start, size: where each first code point's keys begin
    in key order.  Running counts of the groups, so no window holds a lexicon."""
    groups = lexicon.where("key <> ''").groupBy("lexicon", first_code_point(F.col("key")).alias("code_point")).agg(F.count("*").alias("size"))
    before = Window.partitionBy("lexicon").orderBy("code_point").rowsBetween(Window.unboundedPreceding, -1)
    return groups.select("lexicon", "code_point", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), "size")


def max_key_length(lexicon: DataFrame) -> DataFrame:
    """lexicon, max_key_length in UTF-16 units."""
    return lexicon.groupBy("lexicon").agg(F.max(utf16_length(F.col("key"))).alias("max_key_length"))


def contains(points: Column, point: Column) -> Column:
    """Whether a sorted array of code points has one."""
    return F.array_contains(points, point)


def index_of(points: Column, point: Column) -> Column:
    """Rank in a sorted array of code points, -1 for others."""
    return F.coalesce(F.array_position(points, point), F.lit(0)) - 1


def union_points(a: Column, b: Column) -> Column:
    """Union of two sorted arrays of code points."""
    return F.array_sort(F.array_union(a, b))


def stops_skip(point: Column, starts: Column) -> Column:
    """Whether a code point ends a run: it begins a key or is a description operator."""
    return F.array_contains(starts, point) | point.between(0x2FF0, 0x2FFF)


def self_lookup(lexicon: DataFrame) -> DataFrame:
    """lexicon, key of entries not found again exactly or as their own longest prefix (none, in a good lexicon)."""
    own = lexicon.select("lexicon", "key", F.col("candidates")[0].alias("value"))
    found = longest_prefix(own.select("key"), "key", lexicon).withColumnRenamed("value", "got")
    return own.join(found, "key", "left").where("got is null or length <> length(encode(key, 'UTF-16BE')) / 2").select("lexicon", "key")
