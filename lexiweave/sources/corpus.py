"""Test corpora: golden cases, fuzz inputs, hex corpora, samples, comparison inputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat
from ..functions.columns import fnv1a64
from ..functions.text import escape, fnv1a64 as fnv, hex64
from ..plans.config import parse_json

#: Longest input of a hex corpus, in bytes.
MOST_BYTES = 512


def golden(spark: SparkSession, path: str) -> DataFrame:
    """id, input, stem, expected: one row for each expectation of each case.

    A corpus is a fixture of bounded size, read as a whole: JSON that may hold
    comments and trailing commas.  A file that is none, and a case without a
    string id and input, are refused."""
    rows = []
    for file in spark.read.text(path, wholetext=True).collect():
        try:
            cases = parse_json(file.value)["cases"]
            for c in cases:
                fields = (c["id"], c["input"], *c["expected"], *c["expected"].values())
                if not all(isinstance(x, str) for x in fields):
                    raise InvalidFormat(f"a golden case holds strings only: {c['id']}")
                rows += [(c["id"], c["input"], stem, text) for stem, text in c["expected"].items()]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise InvalidFormat(f"not a golden corpus: {e!r}") from e
    return spark.createDataFrame(rows, "id string, input string, stem string, expected string")


def stem_states(cases: DataFrame, ported: list[str], unported: list[str]) -> DataFrame:
    """stem, state: ``unported`` (expected by a case, neither ported nor registered as
    unported) or ``stale`` (registered as unported, but ported or in no case)."""
    stems = cases.groupBy("stem").agg(F.count("*").alias("n"))
    registered = cases.sparkSession.createDataFrame([(s,) for s in sorted(set(unported))], "stem string").withColumn("known", F.lit(True))
    both = stems.join(registered, "stem", "full")
    is_ported = F.col("stem").isin(list(ported))
    state = F.when(F.col("known") & (is_ported | F.col("n").isNull()), "stale").when(F.col("known").isNull() & ~is_ported, "unported")
    return both.select("stem", state.alias("state")).where("state is not null")


def fuzz(spark: SparkSession, path: str) -> DataFrame:
    """input: one JSON string per line; a line that is none fails the query."""
    line = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    text = F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"]
    return line.select(F.when(F.col("value").rlike('(?s)^".*"$') & text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not a JSON string: "), "value"))).alias("input"))


def hex_corpus(lines: DataFrame) -> DataFrame:
    """id, bytes, valid of ``id TAB hex`` lines; valid if the id is the bytes' hash."""
    line = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p"))
    return line.select(F.col("p")[0].alias("id"), F.unhex(F.col("p")[1]).alias("bytes")).withColumn("valid", fnv1a64("bytes") == F.col("id"))


def hex_lines(files: DataFrame) -> DataFrame:
    """value: ``id TAB hex`` of distinct (bytes) rows of at most 512 bytes, ordered by id."""
    kept = files.where(F.octet_length("bytes") <= MOST_BYTES).select(fnv1a64("bytes").alias("id"), "bytes").dropDuplicates(["id"])
    return kept.orderBy("id").select(F.concat_ws("\t", "id", F.lower(F.hex("bytes"))).alias("value"))


def expectations(lines: DataFrame) -> DataFrame:
    """id, verdict, entry_count, max_key_length, digest, audit, rule of expectation lines."""
    p = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    accept = at(1) == "accept"
    return p.select(at(0).alias("id"), at(1).alias("verdict"), F.when(accept, at(2)).cast("int").alias("entry_count"), F.when(accept, at(3)).cast("int").alias("max_key_length"), F.when(accept, at(4)).alias("digest"), F.when(accept, at(5)).alias("audit"), F.when(~accept, at(2)).alias("rule"))


def sample(spark: SparkSession, path: str) -> DataFrame:
    """text of whole files, without one trailing line end."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("text"))


def comparable(inputs: DataFrame) -> DataFrame:
    """Distinct inputs in first-seen order without line ends and NUL: (ord, input)."""
    kept = inputs.where(~F.col("input").rlike("[\\n\\r\\x00]"))
    return kept.groupBy("input").agg(F.min("ord").alias("ord")).select("ord", "input")


def united(*parts: DataFrame) -> DataFrame:
    """The comparison corpus of several (input) frames, earlier frames first."""
    out = None
    for k, p in enumerate(parts):
        q = p.select(F.struct(F.lit(k).alias("part"), F.monotonically_increasing_id().alias("n")).alias("ord"), "input")
        out = q if out is None else out.union(q)
    return comparable(out)


def token_lines(inputs: DataFrame) -> DataFrame:
    """value: distinct characters of the inputs as fuzzer dictionary lines."""
    points = inputs.select(F.explode(F.split("input", "")).alias("c")).where("c <> ''").distinct()
    coded = F.concat(F.lit('"'), F.regexp_replace(F.hex(F.encode("c", "UTF-8")), "(..)", "\\\\x$1"), F.lit('"'))
    return points.select(coded.alias("value")).orderBy("value")


def id_of(data: bytes) -> str:
    """The id of a hex corpus' input."""
    return hex64(fnv(data))


def parse_fuzz(text: str) -> list[str]:
    """Inputs of a JSON-lines text; a line that is no string is an error."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if line.strip():
            try:
                value = json.loads(line)
            except json.JSONDecodeError as e:
                raise InvalidFormat(f"line {n}: {e}") from e
            if not isinstance(value, str):
                raise InvalidFormat(f"line {n}: not a string")
            out.append(value)
    return out


__all__ = ["comparable", "escape", "expectations", "fuzz", "golden", "hex_corpus", "hex_lines", "id_of", "parse_fuzz", "sample", "token_lines", "united"]
