"""Lexicons as DataFrames and as plan leaves.

A lexicon frame has the columns ``lexicon, key, candidates`` (and ``ord``, the
line it came from, where there is one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileNotFound, InvalidFormat, LexiconError, Unsupported
from ..plans.config import CONTAINER, OTHER, TEXT
from ..plans.model import Leaf
from . import container

#: A lexicon larger than this many entries is not made into a broadcast plan leaf.
LEAF_ENTRIES = 5_000_000
BOM = "\ufeff"
#: Fixed value: marks the preferred key of a reversal.
PREFER_MARK = "# @reverse-prefer:"


def split_lines(text: str) -> list[tuple[int, str]]:
    """(number, line) pairs, one trailing carriage return dropped from each."""
    text = text.removeprefix(BOM)
    return [(n, line.removesuffix("\r")) for n, line in enumerate(text.split("\n"), 1)]


def parse_text(text: str, name: str | None = None) -> Leaf:
    """A runtime lexicon: ``key TAB value value``; every space separates, empty
    candidates count; ``#`` and empty lines are skipped; an empty key never matches."""
    pairs, seen = [], set()
    for n, line in split_lines(text):
        if not line or line.startswith("#"):
            continue
        key, tab, values = line.partition("\t")
        if not tab:
            raise InvalidFormat(f"line {n}: no tab")
        if key in seen:
            raise InvalidFormat(f"line {n}: duplicate key '{key}'")
        seen.add(key)
        if key:
            pairs.append((key, values.split(" ")))
    return Leaf.of(pairs, name)


def parse_source(text: str) -> tuple[list[tuple[str, list[str]]], dict[str, str]]:
    """A lexicon of the derivation scripts: (entries in order, preferred keys of
    reversals).  Empty fragments are dropped; an entry needs a key and a value."""
    entries: list[tuple[str, list[str]]] = []
    prefer: dict[str, str] = {}
    for n, line in split_lines(text):
        if line.startswith(PREFER_MARK):
            fields = line.removeprefix(PREFER_MARK).split()
            if len(fields) not in (1, 2):
                raise InvalidFormat(f"line {n}: a reverse preference has one or two fields")
            prefer[fields[0]] = fields[-1]
        elif line and not line.startswith("#"):
            key, tab, rest = line.partition("\t")
            values = [v for v in rest.split(" ") if v]
            if not tab or not key or not values:
                raise InvalidFormat(f"line {n}: an entry needs a key, a tab and a value")
            entries.append((key, values))
    return entries, prefer


def text_frame(files: DataFrame) -> DataFrame:
    """lexicon, ord, key, candidates from (lexicon, value) rows of whole texts."""
    cut = files.select("lexicon", F.posexplode(F.split(F.regexp_replace("value", f"^{BOM}", ""), "\n", -1)).alias("pos", "line"))
    line = cut.select("lexicon", (F.col("pos") + 1).alias("ord"), F.regexp_replace("line", "\r$", "").alias("line"))
    line = line.where(~F.col("line").startswith("#") & (F.col("line") != ""))
    at = F.instr("line", "\t")
    key = F.when(at > 0, F.substr("line", F.lit(1), at - 1))
    rest = F.substr("line", at + 1)
    return line.select("lexicon", "ord", key.alias("key"), F.when(at > 0, F.split(rest, " ", -1)).alias("candidates"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text lexicons under a path; named after their files."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("lexicon"), "value")
    return text_frame(raw)


def duplicates(entries: DataFrame) -> DataFrame:
    """lexicon, key of keys that stand more than once."""
    return entries.groupBy("lexicon", "key").agg(F.count("*").alias("n")).where("n > 1").select("lexicon", "key")


def rejected(entries: DataFrame) -> DataFrame:
    """lexicon, ord, reason of rows that break the text format."""
    no_tab = entries.where("key is null").select("lexicon", "ord", F.lit("no tab").alias("reason"))
    twice = entries.join(duplicates(entries), ["lexicon", "key"], "left_semi").select("lexicon", "ord", F.lit("duplicate key").alias("reason"))
    return no_tab.union(twice)


def inline_frame(spark: SparkSession, name: str, entries: dict[str, str]) -> DataFrame:
    """A lexicon from literal entries; keys and values must not be empty."""
    if any(not k or not v for k, v in entries.items()):
        raise InvalidFormat("inline dictionary entries must be non-empty")
    return spark.createDataFrame([(name, k, [v]) for k, v in entries.items()], "lexicon string, key string, candidates array<string>")


def ordered(entries: DataFrame) -> DataFrame:
    """Entries in code-point order of their keys, which is the order of UTF-8."""
    return entries.orderBy("lexicon", "key")


def leaf(entries: DataFrame, name: str | None = None) -> Leaf:
    """A lexicon frame as a plan leaf; its size is checked before it comes to the driver."""
    rows = entries.where("key <> ''").select("key", "candidates").limit(LEAF_ENTRIES + 1).collect()
    if len(rows) > LEAF_ENTRIES:
        raise Unsupported(f"a lexicon of more than {LEAF_ENTRIES} entries; use operators.lookup")
    return Leaf.of([(r.key, list(r.candidates)) for r in rows], name)


def leaf_frame(spark: SparkSession, name: str, plan: Leaf) -> DataFrame:
    """A plan leaf as a lexicon frame."""
    return spark.createDataFrame([(name, k, list(v)) for k, v in plan.entries.items()], "lexicon string, key string, candidates array<string>")


class Resources:
    """Bytes by path; ``None`` where there is no such path.  Backed by a mapping
    or by Spark's binary reader over a root folder."""

    def __init__(self, files: dict[str, bytes] | None = None, spark: SparkSession | None = None, root: str | None = None):
        self.files, self.spark, self.root = files or {}, spark, root

    def load(self, path: str) -> bytes | None:
        if path in self.files:
            return self.files[path]
        if self.spark is None or self.root is None:
            return None
        jvm = self.spark.sparkContext._jvm
        full = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{path}")
        if not full.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(full):
            return None
        return bytes(self.spark.read.format("binaryFile").load(full.toString()).select("content").first()[0])


class Lexicons:
    """Opens lexicons by type and file, once each; readers by type can be added."""

    def __init__(self, resources: Resources):
        self.resources = resources
        self.known: dict[tuple[str, str], Leaf] = {}
        self.readers = {TEXT: lambda b, n: parse_text(_decoded(b), n), CONTAINER: lambda b, n: container.decode(b).leaf(n)}

    def open(self, kind: str, file: str) -> Leaf:
        if kind in OTHER:
            raise Unsupported(f"{file}: dictionary format '{kind}' is not supported")
        if kind not in self.readers:
            raise Unsupported(f"{file}: no reader for dictionary format '{kind}'")
        if (kind, file) not in self.known:
            data = self.resources.load(file)
            if data is None:
                raise FileNotFound(f"{file}: no such lexicon; supply it through Resources")
            try:
                made = self.readers[kind](data, file)
            except LexiconError as e:
                kind_of = next(c for c in type(e).__mro__ if c.__module__ == LexiconError.__module__)
                raise kind_of(f"{file}: {e}") from e
            self.known.setdefault((kind, file), made)
        return self.known[kind, file]


def _decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise InvalidFormat(f"not UTF-8: {e}") from e
