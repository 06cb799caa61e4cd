"""Repeated passages by a depth-limited radix sort of sampled suffixes.

Only the first ``LENGTH`` bytes of a suffix matter, so suffixes are ordered by
most significant digits until that depth and no further; a group of equal
windows is then exactly a repeated passage.

Dealing every suffix would move many times the input, so a first pass leaves
out what cannot repeat.  Of each window's ``DIGIT``-byte strings the one with the
least hash stands for it (equal windows choose alike), which leaves one place in
about thirteen.  A string that only one text holds cannot lie in a repeated
window, and its windows drop out; hashes only ever keep too much here.

The second pass deals what is left, the bytes around each such place, by that
string.  A bucket orders the windows in them digit by digit (eight bytes, most
significant first), goes on only with groups of more than one, and ends at
``LENGTH`` bytes: windows are compared byte by byte.  In a group of equal
windows every one but those of the smallest doc_id is marked.

Documents travel as compressed chunks, strings and contexts as packed arrays per
chunk and bucket, and answers as bits in the same order.  A chunk sends equal
contexts once, so a passage that many documents share costs its bucket one entry
for each chunk.  Texts equal to that of a smaller doc_id (128-bit BLAKE2) are
settled as a whole.  Each pass starts from a written table.

Results for odd input: null text counts as empty; texts shorter than the
window lose nothing; rows with the same doc_id are not smaller than each other;
a null doc_id counts as larger than all others; very long texts are chunks of
their own and cost linear time; an empty table gives no rows.
"""

from __future__ import annotations

import ctypes
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, texts

LENGTH = 50
DIGIT = 24
#: Bytes of text in a chunk, positions hashed at a time, strings aimed at in a bucket of the first pass.
CHUNK, SEGMENT, BUCKET = 1 << 20, 1 << 17, 1 << 20
#: Buckets of the second pass for each of the first.
FINER = 8
_LAST = np.iinfo(np.int64).max
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Hasher:
    """Polynomial hashes, modulo 2**64, of any window of a segment."""

    def __init__(self, length: int, digit: int):
        rng = np.random.default_rng(20_240_601)
        self.length, self.digit = length, digit
        n = SEGMENT + length + 1
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        one = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
        self.power, self.back = one(base), one(inverse)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def strings(self, x: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from each position."""
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.table[x] * self.power[: len(x)], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self.back[: len(x) - size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def segments(self, x: np.ndarray, ends: np.ndarray):
        """(keys, places, lo, hi) per segment: the sampled strings' hashes and
        places and, for each, the first and last start of the windows it stands for."""
        length, digit = self.length, self.digit
        width = length - digit + 1
        for o in range(0, max(0, len(x) - length + 1), SEGMENT):
            part = x[o : o + SEGMENT + length - 1]
            n = len(part) - length + 1
            h = self.strings(part, digit)
            mask = np.uint64((1 << 18) - 1)
            low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
            size = 1
            while size * 2 <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if width > size:
                low = np.minimum(low[: n], low[width - size : width - size + n])
            spot = (low[:n] & mask).astype(np.int64)
            good = np.ones(n, bool)
            for e in ends[np.searchsorted(ends, o, "right") : np.searchsorted(ends, o + n + length, "left")].tolist():
                good[max(0, e - length + 1 - o) : max(0, e - o)] = False
            edge = np.flatnonzero((spot[1:] != spot[:-1]) | (good[1:] != good[:-1])) + 1
            lo = np.concatenate([[0], edge])
            hi = np.concatenate([edge, [n]]) - 1
            keep = good[lo]
            lo, hi = lo[keep], hi[keep]
            yield h[spot[lo]], spot[lo] + o, lo + o, hi + o


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, ids, sizes, blob (compressed bytes), size: whole documents together."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def out():
            nonlocal ids, held, size, made
            row = pa.RecordBatch.from_arrays([pa.array([(part << 31) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in held]], pa.list_(pa.int64())), pa.array([zlib.compress(b"".join(held), 1)], pa.binary()), pa.array([size], pa.int64())], names=["chunk", "ids", "sizes", "blob", "size"])
            ids, held, size, made = [], [], 0, made + 1
            return row

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = t.as_py().encode("utf-8", "replace")
                if held and size + len(raw) > CHUNK:
                    yield out()
                ids.append(i)
                held.append(raw)
                size += len(raw)
        if held:
            yield out()

    return texts(docs).mapInArrow(run, "chunk long, ids array<long>, sizes array<long>, blob binary, size long")


class Chunk:
    """A chunk unpacked: bytes, document ends, ids and text hashes."""

    def __init__(self, ids, sizes, blob):
        raw = zlib.decompress(blob)
        self.raw, self.x = raw, np.frombuffer(raw, np.uint8)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)
        digests = [hashlib.blake2b(raw[e - s : e], digest_size=16).digest() for s, e in zip(self.sizes.tolist(), self.ends.tolist())]
        self.text = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2) if digests else np.empty((0, 2), np.uint64)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def pack_groups(bucket: np.ndarray, group: np.ndarray, key: np.ndarray):
    """(bucket, blob) for items sorted by (bucket, group): keys, groups and run lengths."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(bucket)]]).tolist()):
        if a == b:
            continue
        g = group[a:b]
        cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
        runs = np.diff(np.concatenate([cut, [b - a]]))
        head = np.array([b - a, len(cut)], np.int64).tobytes()
        yield int(bucket[a]), head + key[a:b].tobytes() + g[cut].tobytes() + runs.astype(np.int32).tobytes()


def unpack_groups(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(keys, groups) of a blob of :func:`pack_groups`."""
    n, m = np.frombuffer(blob, np.int64, 2)
    size = kind.itemsize
    key = np.frombuffer(blob, kind, n, 16)
    group = np.frombuffer(blob, np.int64, m, 16 + n * size)
    return key, np.repeat(group, np.frombuffer(blob, np.int32, m, 16 + n * size + 8 * m))


class Digits:
    """First pass over a chunk: its distinct strings in the order they are sent."""

    def __init__(self, chunk: Chunk, hasher: Hasher, buckets: int):
        parts = list(hasher.segments(chunk.x, chunk.ends))
        keys = np.concatenate([np.empty(0, np.uint64), *[p[0] for p in parts]])
        self.at, self.lo, self.hi = (np.concatenate([np.empty(0, np.int64), *[p[k] for p in parts]]) for k in (1, 2, 3))
        self.doc = chunk.doc_of(self.lo)
        text = chunk.text[self.doc, 0].view(np.int64) if len(self.doc) else np.empty(0, np.int64)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        owner = text[first]
        mixed = np.zeros(len(unique), bool)
        mixed[inverse[text != owner[inverse]]] = True
        # Zero stands for a string that several texts of this chunk hold.
        owner = np.where(mixed, 0, owner | 1)
        fine = ((unique >> np.uint64(40)) % np.uint64(buckets * FINER)).astype(np.int64)
        order = np.lexsort((owner, fine // FINER))
        self.bucket, self.owner, self.key = fine[order] // FINER, owner[order], (unique[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_place = place[inverse]
        self.fine = fine[inverse]


class Contexts:
    """Second pass over a chunk: the bytes around the open places, each different
    context once, in the order they are sent."""

    def __init__(self, chunk: Chunk, digits: Digits, shared: np.ndarray, copy: np.ndarray, length: int):
        open_ = np.flatnonzero(shared[digits.of_place] & ~copy[digits.doc])
        self.lo, windows = digits.lo[open_], (digits.hi - digits.lo)[open_] + 1
        before, fine = (digits.at[open_] - self.lo).tolist(), digits.fine[open_].tolist()
        self.doc = chunk.ids[digits.doc[open_]]
        known: dict[tuple, int] = {}
        raw = chunk.raw
        number = [known.setdefault((f, b, raw[s : s + n + length - 1]), len(known)) for f, b, s, n in zip(fine, before, self.lo.tolist(), windows.tolist())]
        names = list(known)
        order = sorted(range(len(names)), key=lambda i: names[i][0])
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        self.of = place[np.array(number, np.int64)]
        self.least = np.full(len(names), _LAST, np.int64)
        np.minimum.at(self.least, self.of, self.doc)
        self.names = [names[i] for i in order]
        self.bucket = np.array([f for f, _, _ in self.names], np.int64)
        self.windows = np.array([len(t) - length + 1 for _, _, t in self.names], np.int64)
        self.begin = np.cumsum(self.windows) - self.windows

    def packed(self):
        """(bucket, blob) of what is sent."""
        edges = np.flatnonzero(np.diff(self.bucket)) + 1
        for a, z in zip(np.concatenate([[0], edges]).tolist(), np.concatenate([edges, [len(self.bucket)]]).tolist()):
            if a < z:
                part = self.names[a:z]
                sizes = np.array([len(t) for _, _, t in part], np.uint16).tobytes()
                yield int(self.bucket[a]), np.int64(z - a).tobytes() + self.least[a:z].tobytes() + sizes + np.array([b for _, b, _ in part], np.uint16).tobytes() + b"".join(t for _, _, t in part)

    def beaten(self, bits: list[dict] | None) -> np.ndarray:
        """Starts of the windows that a smaller doc_id holds too."""
        back = answer(bits, np.repeat(self.bucket, self.windows))
        n = self.windows[self.of]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = back[np.repeat(self.begin[self.of], n) + step] | np.repeat(self.doc > self.least[self.of], n)
        return (np.repeat(self.lo, n) + step)[hit]


def radix_groups(raw: bytes, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``at`` whose ``depth`` bytes stand there more than once, in the
    order of those bytes, and the first place of each group among them.

    Digits are eight bytes, most significant first; only groups of more than one
    go on to the next digit."""
    x = np.frombuffer(raw + bytes(8), np.uint8)
    digits = np.ndarray(max(0, len(x) - 7), ">u8", x.data, strides=(1,)) if len(x) > 7 else np.empty(0, ">u8")
    active, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for k in range(0, depth, 8):
        digit = digits[at[active] + k].astype(np.uint64)
        if depth - k < 8:
            digit >>= np.uint64(8 * (8 - depth + k))
        order = np.lexsort((digit, group)) if k else np.argsort(digit, kind="stable")
        digit, group, active = digit[order], group[order], active[order]
        new = np.ones(len(digit), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.empty(0, bool)
        active, group = active[several], group[several]
    return active, np.flatnonzero(np.diff(group, prepend=-1))


def settle_contexts(blobs: list[bytes], length: int, digit: int) -> list[np.ndarray]:
    """For each blob of :meth:`Contexts.packed`, which of its windows a smaller doc_id holds."""
    known: dict[bytes, int] = {}
    places: list[int] = []
    sent = []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        doc, sizes, before = np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.uint16, n, 8 + 8 * n).astype(np.int64), np.frombuffer(blob, np.uint16, n, 8 + 10 * n)
        ends = 8 + 12 * n + np.cumsum(sizes)
        number = []
        for s, e, b in zip((ends - sizes).tolist(), ends.tolist(), before.tolist()):
            text = blob[s:e]
            i = known.setdefault(text, len(known))
            if i == len(places):
                places.append(b)
            number.append(i)
        sent.append((doc, np.array(number, np.int64)))
    texts_ = list(known)
    sizes = np.array([len(t) for t in texts_], np.int64)
    least = np.full(len(texts_), _LAST, np.int64)
    for doc, number in sent:
        np.minimum.at(least, number, doc)
    windows = sizes - length + 1
    begin = np.cumsum(windows) - windows
    low = np.repeat(least, windows)
    # A context whose string stands in no other context meets no other window.
    held: dict[bytes, int] = {}
    string = np.array([held.setdefault(t[b : b + digit], len(held)) for t, b in zip(texts_, places)], np.int64)
    meets = (np.bincount(string, minlength=1)[string] > 1) if len(string) else np.empty(0, bool)
    step = np.arange(len(low)) - np.repeat(begin, windows)
    at = (np.repeat(np.cumsum(sizes) - sizes, windows) + step)[np.repeat(meets, windows)]
    spot = np.flatnonzero(np.repeat(meets, windows))
    active, cut = radix_groups(b"".join(texts_), at, length)
    if len(cut):
        spot = spot[active]
        low[spot] = np.repeat(np.minimum.reduceat(low[spot], cut), np.diff(np.append(cut, len(spot))))
    out = []
    for doc, number in sent:
        n = windows[number]
        here = np.repeat(begin[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(low[here] < np.repeat(doc, n))
    return out


def answer(bits: list[dict] | None, bucket: np.ndarray) -> np.ndarray:
    """The bits of every bucket, in the order in which the items were sent."""
    out = np.zeros(len(bucket), bool)
    for b in bits or []:
        a, z = np.searchsorted(bucket, [b["bucket"], b["bucket"] + 1])
        out[a:z] = np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=int(z - a)).astype(bool)
    return out


_SENT = "family int, bucket long, chunk long, blob binary"
_BACK = "family int, bucket long, chunk long, bits binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    f, b, c, x = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(x, pa.binary())], names=["family", "bucket", "chunk", "blob"])


def settle(family: int, blobs: list[bytes]) -> list[np.ndarray]:
    """For each blob of a bucket, which of its strings (family 0) several texts hold
    or which of its texts (family 1) a smaller doc_id has."""
    got = [unpack_groups(b, np.dtype(np.uint32) if family == 0 else np.dtype((np.uint64, 2))) for b in blobs]
    key, group = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((group, key) if family == 0 else (group, key[:, 0], key[:, 1]))
    k, g = key[order], group[order]
    start = np.ones(len(k), bool)
    start[1:] = k[1:] != k[:-1] if family == 0 else (k[1:] != k[:-1]).any(axis=1)
    number = np.cumsum(start) - 1
    first = g[start][number]
    if family == 0:
        several = np.zeros(number[-1] + 1, bool)
        several[number[(g != first) | (g == 0)]] = True
        hit = several[number]
    else:
        hit = g > first
    bits = np.empty(len(key), bool)
    bits[order] = hit
    return np.split(bits, np.cumsum([len(k) for k, _ in got])[:-1])


def _settled(length: int, digit: int):
    """Answers of one bucket, as a function of its table."""

    def run(table: pa.Table) -> pa.Table:
        family = table.column("family")[0].as_py()
        blobs = [b.as_py() for b in table.column("blob")]
        bits = settle_contexts(blobs, length, digit) if family == 2 else settle(family, blobs)
        back = pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())
        trim()
        return pa.table({"family": table.column("family"), "bucket": table.column("bucket"), "chunk": table.column("chunk"), "bits": back})

    return run


def _answers(sent: DataFrame, length: int, digit: int) -> DataFrame:
    """chunk, back: the answers to a chunk."""
    back = sent.groupBy("family", "bucket").applyInArrow(_settled(length, digit), _BACK)
    return back.groupBy("chunk").agg(F.collect_list(F.struct("family", "bucket", "bits")).alias("back"))


def _unpack(batch: pa.RecordBatch, k: int) -> Chunk:
    return Chunk(batch.column("ids")[k].as_py(), batch.column("sizes")[k].as_py(), batch.column("blob")[k].as_py())


def trim() -> None:
    """Give freed memory back, so that idle workers hold little."""
    ctypes.CDLL(None).malloc_trim(0)


def repeated(docs: DataFrame, length: int = LENGTH, digit: int = DIGIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (flat byte spans)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = spark.conf.get(_BATCH)
    try:
        return _repeated(docs, length, min(digit, length))
    finally:
        spark.conf.set(_BATCH, rows)


def _repeated(docs: DataFrame, length: int, digit: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    table = scratch.write(chunks(docs), "chunks")
    total = table.agg(F.sum("size")).first()[0] or 0
    buckets = max(24, int(total / 13 / BUCKET) + 1)
    spark.conf.set(_BATCH, "4")

    def deal_digits(batches):
        hasher = Hasher(length, digit)
        for batch in batches:
            for k in range(batch.num_rows):
                name, chunk = batch.column("chunk")[k].as_py(), _unpack(batch, k)
                d = Digits(chunk, hasher, buckets)
                sent = [(0, b, name, x) for b, x in pack_groups(d.bucket, d.owner, d.key)]
                at, order = _texts_sent(chunk, buckets)
                sent += [(1, b, name, x) for b, x in pack_groups(at, chunk.ids[order], chunk.text[order])]
                yield _sent(sent)
                trim()

    cut = table.select("chunk", "ids", "sizes", "blob")
    first = scratch.write(_answers(cut.mapInArrow(deal_digits, _SENT), length, digit), "digits")

    def opened(batch, k, hasher):
        chunk = _unpack(batch, k)
        d = Digits(chunk, hasher, buckets)
        back = batch.column("back")[k].as_py() or []
        shared = answer([b for b in back if b["family"] == 0], d.bucket)
        at, order = _texts_sent(chunk, buckets)
        copy = np.zeros(len(chunk.ids), bool)
        copy[order] = answer([b for b in back if b["family"] == 1], at)
        return chunk, copy, Contexts(chunk, d, shared, copy, length)

    def deal_contexts(batches):
        hasher = Hasher(length, digit)
        for batch in batches:
            for k in range(batch.num_rows):
                c = opened(batch, k, hasher)[2]
                yield _sent([(2, b, batch.column("chunk")[k].as_py(), x) for b, x in c.packed()])
                trim()

    asked = cut.join(first, "chunk")
    second = scratch.write(_answers(asked.mapInArrow(deal_contexts, _SENT), length, digit).withColumnRenamed("back", "last"), "contexts")

    def finish(batches):
        hasher = Hasher(length, digit)
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, copy, c = opened(batch, k, hasher)
                hit = c.beaten(batch.column("last")[k].as_py())
                depth = np.zeros(len(chunk.x) + 1, np.int32)
                np.add.at(depth, hit, 1)
                np.add.at(depth, hit + length, -1)
                gone = np.cumsum(depth[:-1]) > 0
                out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")}
                for j, (s, e) in enumerate(zip((chunk.ends - chunk.sizes).tolist(), chunk.ends.tolist())):
                    g = np.full(e - s, e - s >= length) if copy[j] else gone[s:e]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                    out["doc_id"].append(None if chunk.ids[j] == _LAST else int(chunk.ids[j]))
                    out["n_bytes"].append(e - s)
                    out["n_removed"].append(int(np.count_nonzero(g)))
                    out["n_spans"].append(len(edge) // 2)
                    out["kept_sha256"].append(hashlib.sha256(chunk.x[s:e][~g].tobytes()).hexdigest())
                    out["removed"].append(edge.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if n == "kept_sha256" else pa.list_(pa.int64()) if n == "removed" else pa.int64()) for n, v in out.items()], names=list(out))
                trim()

    both = asked.join(second, "chunk", "left")
    out = scratch.write(both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"), "spans")
    scratch.drop(table, first, second)
    return out


def _texts_sent(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a chunk's texts and the order in which they are sent."""
    bucket = ((chunk.text[:, 0] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((chunk.ids, bucket))
    return bucket[order], order
