"""SimHash near duplicates by vantage-point trees.

Fingerprints are 64-bit.  Two that differ in at most ``MAX_BITS`` bits agree to
within ``MAX_BITS // BLOCKS`` bits on at least one of ``BLOCKS`` disjoint blocks
of bits, and on so short a block the triangle bound prunes well where on all 64
bits it cannot.  So there is one vantage-point tree per block.  Its upper levels
come from a bounded sample and name the shards: every distinct fingerprint is
held by its home shard and asked of each shard that its ball overlaps.  In a
shard the tree is grown further and the leaves compare all 64 bits, so the
pairs are exact.

Equal fingerprints count once throughout.  A shard sends back spanning stars,
never its pairs, so a group of n near copies costs n rows.  Shards that a group
of near copies makes large hold their members in salted parts, each asked by
all of the shard's queries.

Results for odd input: null text counts as empty; texts without words have
fingerprint zero and link like any other; repeated ids are separate rows; rows
with a null id are fingerprinted and can join components, whose id is the
smallest id that is not null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, own_names, texts
from .components import connected_components, local_forest

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints from which the upper levels of the trees are built.
SAMPLE = 4096
#: Members of a shard, and of one salted part of a larger one.
SHARD = 20_000
#: Comparisons of one leaf, in pairs.
LEAF = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for a in range(0, n, 65_536):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + 65_536], stops[a : a + 65_536])], np.uint64)
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the signed 64-bit ``__fp``; a narrow pass."""
    arrow_rows(docs.sparkSession)
    schema = docs.select("*", F.lit(0).cast("long").alias("__fp")).schema

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or "") for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "__fp"])

    return docs.mapInArrow(run, schema)


def blocks(max_bits: int) -> tuple[list[int], int]:
    """Masks of the bit blocks and the radius to search in each."""
    n = max(1, (max_bits + 2) // 2)
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])], max_bits // n


def distance(x: np.ndarray, v: int, mask: int) -> np.ndarray:
    """Differing bits of ``x`` and ``v`` under ``mask``."""
    return np.bitwise_count((x ^ np.uint64(v)) & np.uint64(mask))


def grow(sample: np.ndarray, mask: int, depth: int) -> tuple | None:
    """Upper levels of a tree: (vantage, radius, inside, outside), None at a leaf."""
    if depth == 0 or len(sample) < 8:
        return None
    v = int(sample[len(sample) // 2])
    d = distance(sample, v, mask)
    radius = int(np.median(d))
    inside = d <= radius
    if inside.all():
        radius -= 1
        inside = d <= radius
        if radius < 0 or not inside.any():
            return None
    return v, radius, grow(sample[inside], mask, depth - 1), grow(sample[~inside], mask, depth - 1)


def descend(tree: tuple | None, x: np.ndarray, rows: np.ndarray, mask: int, reach: int, path: int, out: list) -> None:
    """Collect (leaf, rows) of every leaf within ``reach`` of each fingerprint."""
    if not len(rows):
        return
    if tree is None:
        out.append((path, rows))
        return
    v, radius, inside, outside = tree
    d = distance(x[rows], v, mask).astype(np.int64)
    descend(inside, x, rows[d <= radius + reach], mask, reach, path * 2, out)
    descend(outside, x, rows[d > radius - reach], mask, reach, path * 2 + 1, out)


def close_pairs(held: np.ndarray, asked: np.ndarray, mask: int, reach: int, most: int, level: int = 0):
    """Pairs (u, v) of ``held`` x ``asked`` within ``most`` bits, leaf by leaf."""
    if not len(held) or not len(asked):
        return
    if len(held) * len(asked) > LEAF and level < 48:
        v = int(held[(len(held) * 7 + level) // 13 % len(held)])
        d = distance(held, v, mask).astype(np.int64)
        radius = int(np.median(d))
        if (d <= radius).all():
            radius -= 1
        inside = d <= radius
        if inside.any() and not inside.all():
            q = distance(asked, v, mask).astype(np.int64)
            yield from close_pairs(held[inside], asked[q <= radius + reach], mask, reach, most, level + 1)
            yield from close_pairs(held[~inside], asked[q > radius - reach], mask, reach, most, level + 1)
            return
    step = max(1, LEAF // len(held))
    for a in range(0, len(asked), step):
        part = asked[a : a + step]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ held[None, :]) <= most)
        other = part[i] != held[j]
        if other.any():
            yield part[i][other], held[j][other]


def links(distinct: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """Edges (u, v) whose components are those of the pairs within ``max_bits``;
    ``distinct`` is a written table of distinct ``fp``."""
    spark = distinct.sparkSession
    masks, reach = blocks(max_bits)
    n = distinct.count()
    sample = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    depth = min(14, max(2, math.ceil(math.log2(max(1, n) / SHARD + 1))))
    trees = [grow(np.random.default_rng(k).permutation(sample), m, depth) for k, m in enumerate(masks)]
    shared = spark.sparkContext.broadcast(trees)

    def home(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(shared.value):
                out: list = []
                descend(tree, x, np.arange(len(x)), masks[k], 0, 1, out)
                yield pa.RecordBatch.from_arrays([pa.array([k * (1 << 20) + p for p, _ in out], pa.int64()), pa.array([len(r) for _, r in out], pa.int64())], names=["shard", "n"])

    sizes = {r.shard: r.n for r in distinct.mapInArrow(home, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    parts = spark.sparkContext.broadcast({s: -(-c // SHARD) for s, c in sizes.items()})

    def deal(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            salt = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for k, tree in enumerate(shared.value):
                own, near = [], []
                descend(tree, x, np.arange(len(x)), masks[k], 0, 1, own)
                descend(tree, x, np.arange(len(x)), masks[k], reach, 1, near)
                for held, leaves in ((True, own), (False, near)):
                    for p, rows in leaves:
                        shard = k * (1 << 20) + p
                        m = parts.value.get(shard, 0)
                        for s in range(1 if held else m):
                            number = (salt[rows] % np.uint64(max(1, m))).astype(np.int64) if held else np.full(len(rows), s)
                            yield pa.RecordBatch.from_arrays([pa.array(shard * 4096 + number), pa.array(x[rows].view(np.int64)), pa.array(np.full(len(rows), held))], names=["cell", "fp", "held"])

    def search(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        held = table.column("held").to_numpy(zero_copy_only=False)
        cell = table.column("cell")[0].as_py()
        us, vs, size = [], [], 0
        for u, v in close_pairs(fp[held], fp[~held], masks[cell // 4096 >> 20], reach, max_bits):
            us.append(u)
            vs.append(v)
            size += len(u)
            if size > LEAF:
                u, v = local_forest(np.concatenate(us), np.concatenate(vs))
                us, vs, size = [u], [v], 0
        u, v = local_forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.uint64),) * 2
        return pa.table({"u": u[u != v].view(np.int64), "v": v[u != v].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "cell long, fp long, held boolean")
    return dealt.groupBy("cell").applyInArrow(search, "u long, v long")


def classes(marked: DataFrame, max_bits: int, scratch: Scratch) -> DataFrame:
    """fp, component_id, row for each distinct ``__fp`` of a written (doc_id, __row, __fp):
    the component's smallest doc_id and the row that holds it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__row").alias("row")))
    distinct = scratch.write(marked.groupBy(F.col("__fp").alias("fp")).agg(first.alias("first")), "distinct")
    roots = connected_components(links(distinct, max_bits, scratch), scratch)
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("first"))
    return joined.select("fp", "root").join(least, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("row"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    numbered = fingerprints(texts(docs)).select("doc_id", F.monotonically_increasing_id().alias("__row"), "__fp")
    marked = scratch.write(numbered, "fingerprints")
    out = marked.join(classes(marked, max_bits, scratch).withColumnRenamed("fp", "__fp"), "__fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


@own_names
def keep_first(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest
    doc_id (one row of it, should the id repeat); columns as they were."""
    scratch = Scratch(docs.sparkSession, "simhash")
    names = docs.columns
    marked = scratch.write(fingerprints(docs).withColumn("__row", F.monotonically_increasing_id()), "fingerprints")
    kept = classes(marked.select(F.col("doc_id").cast("long").alias("doc_id"), "__row", "__fp"), max_bits, scratch)
    return marked.join(kept.select(F.col("row").alias("__row")).distinct(), "__row", "left_semi").select(*[F.col(f"`{c}`") for c in names])
