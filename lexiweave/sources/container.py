"""The compact binary lexicon container: decode, encode, validate, digest, audit.

Layout, all integers unsigned and little-endian: a 32-byte header (magic,
version, flags, entry count, longest key in UTF-16 units, key bytes, value
bytes, reserved), key offsets, value offsets, candidate counts (one byte each),
keys, and per candidate a two-byte length and its bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFormat
from ..functions.text import decode_lenient, fnv1a64, hex64, is_well_formed, utf16_length
from ..plans.model import Leaf

#: Fixed values of the format.
MAGIC, VERSION, HEADER = b"SOK1", 1, 32
MOST_CANDIDATES, MOST_BYTES, MOST_FILE = 255, 65_535, (1 << 31) - 1


class Violation(InvalidFormat):
    """A broken acceptance rule, by its id."""

    def __init__(self, rule: str, detail: str):
        super().__init__(f"{rule}: {detail}")
        self.rule = rule


@dataclass(frozen=True)
class Container:
    """An accepted container: keys and raw candidates in key order."""

    max_key_length: int
    entries: list[tuple[bytes, list[bytes]]]

    def leaf(self, name: str | None = None) -> Leaf:
        return Leaf({k.decode(): [decode_lenient(c) for c in v] for k, v in self.entries}, name)

    def digest(self) -> str:
        """Canonical digest of what the container says."""
        out = [struct.pack("<II", len(self.entries), self.max_key_length)]
        for key, values in self.entries:
            out += [struct.pack("<I", len(key)), key, bytes([len(values)])]
            for v in values:
                out += [struct.pack("<H", len(v)), v]
        return hex64(fnv1a64(b"".join(out)))

    def audit(self) -> str:
        """Whether every candidate is non-empty, well-formed text."""
        good = all(v and is_well_formed(v) for _, values in self.entries for v in values)
        return "audit-ok" if good else "audit:A5"


def _offsets(data: bytes, at: int, n: int, end: int, rule: str) -> tuple[int, ...]:
    out = struct.unpack_from(f"<{n + 1}I", data, at)
    if out[0] != 0 or out[-1] != end or any(a >= b for a, b in zip(out, out[1:])):
        raise Violation(rule, "offsets must rise strictly from 0 to the blob's size")
    return out


def decode(data: bytes) -> Container:
    """Accept or reject a container's bytes."""
    if len(data) < HEADER:
        raise Violation("V1", f"{len(data)} bytes are no header")
    magic, version, flags, n, longest, key_bytes, value_bytes, reserved = struct.unpack_from("<4s7I", data)
    if magic != MAGIC:
        raise Violation("V2", "bad magic")
    if version != VERSION:
        raise Violation("V3", f"version {version}")
    if flags or reserved:
        raise Violation("V4", "flags and reserved must be 0")
    keys_at = HEADER + 8 * (n + 1) + n
    if keys_at + key_bytes + value_bytes != len(data):
        raise Violation("V6", "the parts do not add up to the file's size")
    key_ends = _offsets(data, HEADER, n, key_bytes, "V7")
    keys = []
    for k in range(n):
        key = data[keys_at + key_ends[k] : keys_at + key_ends[k + 1]]
        if not is_well_formed(key):
            raise Violation("V8", f"key {k} is not well-formed")
        if keys and key <= keys[-1]:
            raise Violation("V12", f"key {k} is not above the one before it")
        keys.append(key)
    if longest != max((utf16_length(k.decode()) for k in keys), default=0):
        raise Violation("V5", "wrong longest key")
    value_ends = _offsets(data, HEADER + 4 * (n + 1), n, value_bytes, "V9")
    counts = data[HEADER + 8 * (n + 1) : keys_at]
    if 0 in counts:
        raise Violation("V10", "an entry has no candidate")
    values_at, entries = keys_at + key_bytes, []
    for k in range(n):
        at, end, values = value_ends[k], value_ends[k + 1], []
        for _ in range(counts[k]):
            if at + 2 > end:
                raise Violation("V11", f"the candidates of entry {k} leave their range")
            (size,) = struct.unpack_from("<H", data, values_at + at)
            values.append(data[values_at + at + 2 : values_at + min(at + 2 + size, end)])
            at += 2 + size
        if at != end:
            raise Violation("V11", f"the candidates of entry {k} do not fill their range")
        entries.append((keys[k], values))
    return Container(longest, entries)


def encode(entries) -> bytes:
    """Container bytes of (key, candidates) pairs, in any order; deterministic."""
    rows, seen = [], set()
    for key, values in entries:
        if not key:
            raise InvalidFormat("empty key")
        if key in seen:
            raise InvalidFormat(f"duplicate key '{key}'")
        if not values:
            raise InvalidFormat(f"no candidates for key '{key}'")
        if len(values) > MOST_CANDIDATES:
            raise InvalidFormat(f"more than {MOST_CANDIDATES} candidates for key '{key}'")
        seen.add(key)
        try:
            raw = [v.encode("utf-8") for v in values]
            rows.append((key.encode("utf-8"), raw))
        except UnicodeEncodeError as e:
            raise InvalidFormat(f"unpaired surrogate in entry '{key!r}'") from e
        if not all(raw):
            raise InvalidFormat(f"empty candidate for key '{key}'")
        if max(map(len, raw)) > MOST_BYTES:
            raise InvalidFormat(f"a candidate of key '{key}' exceeds {MOST_BYTES} bytes")
    rows.sort()
    key_ends, value_ends, keys, values = [0], [0], [], []
    for key, raw in rows:
        keys.append(key)
        values += [struct.pack("<H", len(v)) + v for v in raw]
        key_ends.append(key_ends[-1] + len(key))
        value_ends.append(value_ends[-1] + sum(len(v) + 2 for v in raw))
    longest = max((utf16_length(k.decode()) for k in keys), default=0)
    n = len(rows)
    size = HEADER + 8 * (n + 1) + n + key_ends[-1] + value_ends[-1]
    if size > MOST_FILE:
        raise InvalidFormat("the container exceeds 2 GiB")
    head = struct.pack("<4s7I", MAGIC, VERSION, 0, n, longest, key_ends[-1], value_ends[-1], 0)
    return head + struct.pack(f"<{n + 1}I", *key_ends) + struct.pack(f"<{n + 1}I", *value_ends) + bytes(len(r) for _, r in rows) + b"".join(keys) + b"".join(values)


def read(spark: SparkSession, path: str, pattern: str = "*.sok") -> DataFrame:
    """(id, bytes) of the containers under a path, ordered by name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), F.col("content").alias("bytes")).orderBy("id")


def verdicts(files: DataFrame) -> DataFrame:
    """id, verdict, entry_count, max_key_length, digest, audit, rule of (id, bytes) rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, b in zip(batch.column("id").to_pylist(), batch.column("bytes").to_pylist()):
                try:
                    c = decode(b or b"")
                    rows.append({"id": i, "verdict": "accept", "entry_count": len(c.entries), "max_key_length": c.max_key_length, "digest": c.digest(), "audit": c.audit()})
                except Violation as e:
                    rows.append({"id": i, "verdict": "reject", "rule": e.rule})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.string()), ("verdict", pa.string()), ("entry_count", pa.int32()), ("max_key_length", pa.int32()), ("digest", pa.string()), ("audit", pa.string()), ("rule", pa.string())]))

    return files.select(F.col("id").cast("string").alias("id"), "bytes").mapInArrow(run, "id string, verdict string, entry_count int, max_key_length int, digest string, audit string, rule string")


def expectation_lines(files: DataFrame) -> DataFrame:
    """One tab-separated verdict line per container."""
    v = verdicts(files)
    good = F.concat_ws("\t", "id", "verdict", "entry_count", "max_key_length", "digest", "audit")
    return v.select("id", F.when(F.col("verdict") == "accept", good).otherwise(F.concat_ws("\t", "id", "verdict", "rule")).alias("line"))


def entries(files: DataFrame) -> DataFrame:
    """lexicon, ord, key, candidates of the accepted containers of (id, bytes) rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, b in zip(batch.column("id").to_pylist(), batch.column("bytes").to_pylist()):
                try:
                    got = decode(b or b"")
                except Violation:
                    continue
                rows += [{"lexicon": i, "ord": n, "key": k.decode(), "candidates": [decode_lenient(c) for c in v]} for n, (k, v) in enumerate(got.entries)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("lexicon", pa.string()), ("ord", pa.int32()), ("key", pa.string()), ("candidates", pa.list_(pa.string()))]))

    return files.select(F.col("id").cast("string").alias("id"), "bytes").mapInArrow(run, "lexicon string, ord int, key string, candidates array<string>")


def containers(lexicons: DataFrame) -> DataFrame:
    """(id, bytes): each lexicon of a lexicon frame as one container (at most 2 GiB)."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("key").to_pylist(), table.column("candidates").to_pylist()))
        return pa.table({"id": pa.array([table.column("lexicon")[0].as_py()]), "bytes": pa.array([encode(rows)], pa.binary())})

    return lexicons.select("lexicon", "key", "candidates").groupBy("lexicon").applyInArrow(run, "id string, bytes binary")
