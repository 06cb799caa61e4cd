"""Validation, profiling, comparison and measurement of runs."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_code_point


def stats(lexicon: DataFrame) -> DataFrame:
    """One row per lexicon: entries, key bytes, starts, the largest group and its code
    point (ties: the lowest), keys that start beyond the BMP, candidates."""
    cp = lexicon.select("lexicon", first_code_point(F.col("key")).alias("cp"), F.octet_length("key").alias("b"), F.size("candidates").alias("c"))
    groups = cp.groupBy("lexicon", "cp").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"), F.sum("c").alias("total"), F.max("c").alias("most"), F.sum((F.col("c") > 1).cast("long")).alias("multi"))
    return groups.groupBy("lexicon").agg(
        F.sum("n").alias("entries"),
        F.sum("bytes").alias("key_bytes"),
        F.count("*").alias("starts"),
        F.max("n").alias("largest_group"),
        F.max_by("cp", F.struct("n", -F.col("cp"))).cast("long").alias("largest_start"),
        F.sum(F.when(F.col("cp") > 0xFFFF, F.col("n")).otherwise(0)).alias("astral_starts"),
        F.sum("total").alias("candidates"),
        F.max("most").cast("long").alias("most_candidates"),
        F.sum("multi").alias("multi_candidates"),
    )


def audit(lexicon: DataFrame) -> DataFrame:
    """lexicon, key of entries with an empty candidate."""
    return lexicon.where(F.exists("candidates", lambda c: c == "")).select("lexicon", "key")


def compare(left: DataFrame, right: DataFrame, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """(comparisons, mismatches) and the first differing rows (id, a, b) of (id, output)
    frames; an id on one side only is a mismatch.

    Ids meet with 128-bit digests of the outputs; texts are fetched for the samples only."""

    def digests(df: DataFrame, name: str) -> DataFrame:
        known = F.struct(F.col("output").isNull().alias("none"), F.xxhash64("output").alias("x"), F.xxhash64(F.lit(1), "output").alias("y"))
        return df.select("id", known.alias(name))

    both = digests(left, "a").join(digests(right, "b"), "id", "full")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    tally = both.agg(F.count("*").alias("comparisons"), F.count_if(differs).alias("mismatches"))
    first = both.where(differs).select("id").orderBy("id").limit(samples)
    found = first.join(left.select("id", F.col("output").alias("a")), "id", "left").join(right.select("id", F.col("output").alias("b")), "id", "left")
    return tally, found.orderBy("id")


def first_difference(a: Column, b: Column) -> Column:
    """Name of the first field in which two inspections differ, NULL for none."""
    order = ("normalization_stages", "segments", "stages", "output")
    return F.coalesce(*[F.when(~a[n].eqNullSafe(b[n]), F.lit(n)) for n in order])


def same_outcome(a: Column, b: Column) -> Column:
    """Whether two configuration outcomes agree: outputs if accepted, phase and category if not."""
    both = a["accepted"] & b["accepted"]
    return (a["accepted"] == b["accepted"]) & F.when(both, a["outputs"].eqNullSafe(b["outputs"])).otherwise(a["phase"].eqNullSafe(b["phase"]) & a["category"].eqNullSafe(b["category"]))


def verdict_split(differing: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state: unexpected (differs, not registered), registered, stale (registered, does not differ)."""
    label = lambda df, s: df.select(*keys, F.lit(s).alias("state"))
    d, r = differing.select(*keys).distinct(), registered.select(*keys).distinct()
    return label(d.join(r, keys, "left_anti"), "unexpected").union(label(d.join(r, keys, "left_semi"), "registered")).union(label(r.join(d, keys, "left_anti"), "stale"))


def golden_failures(results: DataFrame, registered: DataFrame) -> DataFrame:
    """id, stem, state of (id, stem, expected, output) rows against registered (id, stem)
    divergences, each of which must be necessary."""
    wrong = results.where(~F.col("expected").eqNullSafe(F.col("output")))
    return verdict_split(wrong, registered, ["id", "stem"]).where("state <> 'registered'")


def percentiles(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """min, p50, p90 by nearest rank: the sample at index int((n - 1) * p).

    Equal samples are counted before the shuffle; ranks are running sums of the counts."""
    counts = samples.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = counts.select(*keys, value, "_c", upto.alias("_upto"), F.sum("_c").over(w).alias("_n"))
    rank = lambda p: F.floor((F.col("_n") - 1) * F.lit(p))
    pick = lambda p: F.max(F.when((F.col("_upto") > rank(p)) & (F.col("_upto") - F.col("_c") <= rank(p)), F.col(value)))
    return at.groupBy(*keys).agg(F.min(value).alias("min"), pick(0.5).alias("p50"), pick(0.9).alias("p90"))


def summarize(samples: list[float]) -> dict[str, float]:
    """min, p50, p90 of samples by nearest rank."""
    s = sorted(samples)
    at = lambda p: s[int((len(s) - 1) * p)]
    return {"min": s[0], "p50": at(0.5), "p90": at(0.9)}


def measure(op, n: int) -> dict[str, float]:
    """Seconds of ``n`` calls after a warm-up of max(200, n / 10)."""
    for _ in range(max(200, n // 10)):
        op()
    out = []
    for _ in range(n):
        t = time.perf_counter()
        op()
        out.append(time.perf_counter() - t)
    return summarize(out)


def median_millis(op, runs: int) -> float:
    """The middle run's milliseconds."""
    out = []
    for _ in range(runs):
        t = time.perf_counter()
        op()
        out.append((time.perf_counter() - t) * 1000)
    return sorted(out)[math.floor(runs / 2)]


def retained_kib(make) -> float:
    """KiB that the result of a call keeps allocated."""
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    held = make()
    gc.collect()
    now = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    del held
    return now / 1024


#: Special samples by profile.
SPECIAL = {"s2t": ["short", "phrases"], "s2twp": ["twp"], "s2hk": ["hk"]}


def samples_for(samples: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile, id, text: ``medium`` and ``long`` for every profile, and its specials."""
    general = F.col("id").isin("medium", "long")
    for profile, ids in SPECIAL.items():
        general = general | (F.col("profile") == profile) & F.col("id").isin(ids)
    return profiles.join(samples, general)
