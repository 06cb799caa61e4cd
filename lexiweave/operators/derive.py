"""Lexicons derived from lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidFormat
from ..plans import config
from .convert import convert

#: Shortest converted key, in code points, of a regional lexicon.
LEAST_POINTS = 3
TOFU_MARK = "# @tofu-risk:"


def reverse(entries: DataFrame, prefer: DataFrame | None = None) -> DataFrame:
    """key, candidates with values as keys and keys as candidates, in the order of
    ``ord`` and candidate position; ``prefer`` (key, preferred) moves one to the front."""
    flat = entries.select("ord", "key", F.posexplode("candidates").alias("pos", "value"))
    back = flat.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "key"))).alias("held"))
    out = back.select(F.col("value").alias("key"), F.col("held.key").alias("candidates"))
    if prefer is not None:
        out = out.join(prefer.select("key", "preferred"), "key", "left")
        at = F.array_position("candidates", F.col("preferred"))
        front = F.concat(F.array("preferred"), F.expr("slice(candidates, 1, cast(array_position(candidates, preferred) as int) - 1)"), F.expr("slice(candidates, cast(array_position(candidates, preferred) as int) + 1, size(candidates))"))
        wrong = F.raise_error(F.concat(F.lit("reverse-prefer names a key that is no candidate: "), F.col("preferred")))
        out = out.select("key", F.when(F.col("preferred").isNull(), F.col("candidates")).when(at > 0, front).otherwise(wrong.cast("array<string>")).alias("candidates"))
    return out


def tofu_risk(lines: DataFrame) -> DataFrame:
    """key, candidates of the entry behind each mark in (file, line_no, line) rows,
    without a first candidate that equals the key; a mark without entry fails."""
    near = lines.withColumn("next", F.lead("line").over(Window.partitionBy("file").orderBy("line_no")))
    marked = near.where(F.col("line").startswith(TOFU_MARK))
    at = F.instr("next", "\t")
    key = F.when(F.col("next").isNull() | (F.trim("next") == "") | F.col("next").startswith("#") | (at < 2), F.raise_error(F.lit("a tofu-risk mark without an entry")).cast("string")).otherwise(F.substr("next", F.lit(1), at - 1))
    got = marked.select(key.alias("key"), F.expr("filter(split(substr(next, instr(next, '\t') + 1), ' ', -1), v -> v <> '')").alias("v"))
    left = F.when(F.get("v", F.lit(0)) == F.col("key"), F.expr("slice(v, 2, size(v))")).otherwise(F.col("v"))
    kept = got.select("key", left.alias("candidates"))
    return kept.select("key", F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(F.raise_error(F.concat(F.lit("no tofu-risk candidate for "), F.col("key"))).cast("array<string>")).alias("candidates"))


def regional(entries: DataFrame, plan) -> DataFrame:
    """key, candidates: keys of (ord, key) rows converted by a plan, with at least
    three code points, each leading back to its source; two sources of one key fail."""
    made = entries.select("ord", F.col("key").alias("source"), convert("key", plan).alias("key"))
    groups = made.where(F.length("key") >= LEAST_POINTS).groupBy("key").agg(F.min_by("source", "ord").alias("source"), F.collect_set("source").alias("all"))
    clash = F.raise_error(F.concat(F.lit("regional phrases with one converted form: "), F.array_join(F.array_sort("all"), ", ")))
    return groups.select("key", F.when(F.size("all") > 1, clash.cast("array<string>")).otherwise(F.array("source")).alias("candidates"))


#: Derived lexicons and what they are made of; all others are read directly.
RECIPES = {
    "TSCharactersExt": ("tofu", ["TSCharacters"]),
    "STPhrases_GeneratedFromRegionalPhrases": ("regional", ["HKPhrases", "TWPhrases"]),
    "TWVariantsRev": ("reverse", ["TWVariants"]),
    "HKVariantsRev": ("reverse", ["HKVariants"]),
    "JPShinjitaiCharactersRev": ("reverse", ["JPShinjitaiCharacters"]),
}


def recipe(name: str, sources: set[str]) -> tuple[str, list[str]]:
    """How a lexicon is made: derived by name, else read directly, else an error."""
    if name in RECIPES:
        return RECIPES[name]
    if name in sources:
        return "direct", [name]
    raise InvalidConfig(f"no source and no recipe for lexicon '{name}'")


def set_check(wanted: DataFrame, found: DataFrame, registered: DataFrame) -> DataFrame:
    """name, state of (name) frames: missing (wanted, not found), unregistered (found,
    neither wanted nor registered), stale (registered, not found)."""
    label = lambda df, s: df.select("name", F.lit(s).alias("state"))
    missing = label(wanted.join(found, "name", "left_anti"), "missing")
    extra = label(found.join(wanted, "name", "left_anti").join(registered, "name", "left_anti"), "unregistered")
    return missing.union(extra).union(label(registered.join(found, "name", "left_anti"), "stale"))


def closure(referenced: DataFrame, generated: DataFrame) -> DataFrame:
    """name, state of (name) frames that are not the same set: not generated, not referenced."""
    a, b = referenced.select("name").distinct().withColumn("r", F.lit(True)), generated.select("name").distinct().withColumn("g", F.lit(True))
    return a.join(b, "name", "full_outer").where("r is null or g is null").select("name", F.when(F.col("g").isNull(), "not generated").otherwise("not referenced").alias("state"))


def generate(spark, configs: dict[str, str], sources: DataFrame, prefer: DataFrame | None = None, plan=None) -> tuple[dict[str, str], DataFrame]:
    """Configurations rewritten to containers and the lexicons they refer to, made
    from a frame of (lexicon, ord, key, candidates); reversals may use ``prefer``
    (lexicon, key, preferred), the regional lexicon needs ``plan``."""
    written = {name: config.rewrite(text) for name, text in configs.items()}
    names = sorted({f.rpartition("/")[2].rpartition(".")[0] for text in written.values() for k, f in config.referenced(config.read(text)) if k == config.CONTAINER})
    have = {r.lexicon for r in sources.select("lexicon").distinct().collect()}
    out = None
    for name in names:
        kind, of = recipe(name, have)
        missing = set(of) - have
        if missing:
            raise InvalidFormat(f"lexicon '{name}' needs {sorted(missing)}")
        base = sources.where(F.col("lexicon").isin(of))
        if kind == "reverse":
            made = reverse(base, prefer.where(F.col("lexicon") == name) if prefer is not None else None)
        elif kind == "regional":
            if plan is None:
                raise InvalidConfig("the regional lexicon needs a plan that converts its keys")
            made = regional(base, plan)
        elif kind == "direct":
            made = base.select("key", "candidates")
        else:
            raise InvalidConfig(f"lexicon '{name}' comes from marked lines: use tofu_risk")
        made = made.select(F.lit(name).alias("lexicon"), "key", "candidates")
        out = made if out is None else out.union(made)
    return written, out if out is not None else spark.createDataFrame([], "lexicon string, key string, candidates array<string>")
