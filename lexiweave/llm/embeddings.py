"""Embedding near duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated onto the corpus' principal axes, computed from second
moments summed over all vectors.  Tiles are the cells of a tree of median cuts
along the leading axes.  Each vector is held by one tile and asked of every tile
whose cell comes within the distance that the cosine threshold allows.  Inside
a tile blocks of vectors accumulate their products from the leading dimensions
on; the rest of a product is at most the product of the two suffix norms, and
a block, or what is left of it, stops once no cosine in it can reach the
threshold.  What remains is compared over all dimensions in double precision.

A tile of many vectors is dealt in parts, each part of the held against each of
the asking ones.  Equal vectors are compared once and counted with their number.  Tiles send back
link counts and spanning stars, never pairs.

Results for odd input: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing and are their own component; vectors of
different lengths never link; repeated ids are separate vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components, local_forest

THRESHOLD = 0.95
#: Vectors of a tile, at least and at most, and tiles aimed at in between.
TILE, TILE_MOST, TILES = 4096, 32_768, 24
#: Vectors from which the cuts between tiles are chosen.
SAMPLE = 8192
#: Rows of a block, and shares of the dimensions after which bounds are tested.
BLOCK = 1024
STEPS = (0.125, 0.25, 0.5)


def unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    # Scaled first, so that squares of very small and very large components are finite.
    flat = flat / np.abs(flat).max(axis=1, initial=0)[:, None]
    return flat / np.linalg.norm(flat, axis=1)[:, None]


def axes(distinct: DataFrame, dim: int) -> np.ndarray:
    """Principal axes as columns, leading first."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = unit_rows(batch.column("embedding"))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    rows = distinct.select("embedding").mapInArrow(moments, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((dim, dim))
    for r in rows:
        total[r.i, r.j] = r.v
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def cuts(x: np.ndarray, depth: int, axis: int = 0):
    """Tree of median cuts, one axis after another: (axis, value, low, high)."""
    if depth == 0 or len(x) < 16:
        return None
    a = axis % x.shape[1]
    v = float(np.median(x[:, a]))
    low = x[:, a] <= v
    return (a, v, cuts(x[low], depth - 1, axis + 1), cuts(x[~low], depth - 1, axis + 1)) if not low.all() else None


def descend(tree, x: np.ndarray, rows: np.ndarray, reach: float, gaps: dict, path: int, out: list) -> None:
    """(tile, rows) of each tile whose cell lies within ``reach`` of the vectors."""
    if not len(rows):
        return
    if tree is None:
        out.append((path, rows))
        return
    a, v, low, high = tree
    off = x[rows, a] - v
    for side, child, here in ((0, low, off <= 0), (1, high, off > 0)):
        gap = gaps.get(a, np.zeros(len(x)))
        new = gap.copy()
        new[rows] = np.where(here, gap[rows], np.maximum(gap[rows], np.abs(off)))
        total = sum((g[rows] ** 2 for k, g in gaps.items() if k != a), new[rows] ** 2)
        # A vector on a cut is held on one side only.
        near = total <= reach * reach if reach else here & (total == 0)
        descend(child, x, rows[near], reach, {**gaps, a: new}, path * 2 + side, out)


def linked(q: np.ndarray, x: np.ndarray, threshold: float):
    """Index pairs (i, j) with q[i].x[j] >= threshold; rows are rotated unit vectors."""
    dim = x.shape[1]
    stops = sorted({min(dim, max(1, round(dim * s))) for s in STEPS}) + [dim]
    tail = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))
    tq, tx = (np.hstack([tail(m), np.zeros((len(m), 1))]) for m in (q, x))
    for a in range(0, len(q), BLOCK):
        for b in range(0, len(x), BLOCK):
            p, y = q[a : a + BLOCK], x[b : b + BLOCK]
            s, part = 0, np.zeros((len(p), len(y)))
            i = j = None
            for stop in stops:
                part += p[:, s:stop] @ y[:, s:stop].T
                s = stop
                open_ = part + tq[a : a + BLOCK, s][:, None] * tx[b : b + BLOCK, s][None, :] >= threshold - 1e-9
                n = np.count_nonzero(open_)
                if n == 0 or n * 20 < open_.size or s == dim:
                    i, j = np.nonzero(open_)
                    break
            if len(i):
                for c in range(0, len(i), 1 << 18):
                    ii, jj = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                    full = part[ii, jj] if s == dim else np.einsum("ij,ij->i", p[ii], y[jj])
                    good = full >= threshold
                    if good.any():
                        yield a + ii[good], b + jj[good]


def _parts(distinct: DataFrame, basis: np.ndarray, tree) -> dict[int, int]:
    """Parts of each tile that holds more than ``TILE_MOST`` vectors; the tree, built
    from a bounded sample, bounds their number."""

    def held(batches):
        counts: dict[int, int] = {}
        for batch in batches:
            own: list = []
            if batch.num_rows:
                descend(tree, unit_rows(batch.column("embedding")) @ basis, np.arange(batch.num_rows), 0.0, {}, 1, own)
            for tile, rows in own:
                counts[tile] = counts.get(tile, 0) + len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["tile", "n"])

    found = distinct.select("embedding").mapInArrow(held, "tile long, n long").groupBy("tile").agg(F.sum("n").alias("n"))
    return {r.tile: math.ceil(r.n / TILE_MOST) for r in found.where(F.col("n") > TILE_MOST).collect()}


def _one_length(distinct: DataFrame, dim: int, threshold: float, scratch: Scratch) -> DataFrame:
    """(rep, links, root) rows of the vectors of one length; several per rep."""
    spark = distinct.sparkSession
    n = distinct.count()
    basis = axes(distinct, dim)
    taken = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    sample = unit_rows(taken) @ basis
    size = min(TILE_MOST, max(TILE, n // TILES))
    depth = max(0, math.ceil(math.log2(max(1, n / size))))
    lead = max(1, min(dim, 16))
    tree = cuts(sample[:, :lead], depth)
    parts = _parts(distinct, basis[:, :lead], tree)
    shared = spark.sparkContext.broadcast((basis, tree, parts))
    kind = dict(distinct.dtypes)["embedding"]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def deal(batches):
        basis, tree, parts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (unit_rows(batch.column("embedding")) @ basis)[:, :lead]
            own, near = [], []
            descend(tree, x, np.arange(len(x)), 0.0, {}, 1, own)
            descend(tree, x, np.arange(len(x)), reach, {}, 1, near)
            for held, tiles in ((True, own), (False, near)):
                for tile, rows in tiles:
                    n = parts.get(tile, 1)
                    share = batch.column("rep").to_numpy()[rows] % n
                    for p in range(n):
                        mine = rows[share == p]
                        part = batch.take(pa.array(mine))
                        # A part of the held meets every part of the asking vectors.
                        for other in range(n if len(mine) else 0):
                            cell = (p * n + other) if held else (other * n + p)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), tile)), pa.array(np.full(len(mine), cell)), pa.array(np.full(len(mine), held)), *part.columns], names=["tile", "cell", "held", "rep", "mult", "embedding"])

    def compare(table: pa.Table) -> pa.Table:
        basis = shared.value[0]
        table = table.combine_chunks()
        rep, mult = table.column("rep").to_numpy(), table.column("mult").to_numpy()
        held = table.column("held").to_numpy(zero_copy_only=False)
        x = unit_rows(table.column("embedding").combine_chunks()) @ basis
        a, b = np.flatnonzero(~held), np.flatnonzero(held)
        count = np.zeros(len(a), np.int64)
        us, vs, open_ = [], [], 0
        for i, j in linked(x[a], x[b], threshold):
            u, v = rep[a[i]], rep[b[j]]
            other = u != v
            np.add.at(count, i[other], mult[b[j[other]]])
            us.append(u[other])
            vs.append(v[other])
            open_ += len(us[-1])
            if open_ > 1 << 20:
                u, v = local_forest(np.concatenate(us), np.concatenate(vs))
                us, vs, open_ = [u], [v], 0
        u, v = local_forest(np.concatenate(us), np.concatenate(vs)) if open_ else (np.empty(0, np.int64),) * 2
        some = count > 0
        return pa.table({"rep": np.concatenate([rep[a[some]], u]), "links": np.concatenate([count[some], np.zeros(len(u), np.int64)]), "root": pa.array(np.concatenate([rep[a[some]], v]))})

    return distinct.mapInArrow(deal, f"tile long, cell long, held boolean, rep long, mult long, embedding {kind}").groupBy("tile", "cell").applyInArrow(compare, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    finite = "embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < float('infinity')) and exists(embedding, v -> v <> 0)"
    # Components keep their own precision; products are in double precision.
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    base = scratch.write(base.withColumn("usable", F.coalesce(F.expr(finite), F.lit(False))), "vectors")
    # A row number stands for a vector, so repeated and null ids stay apart.
    distinct = base.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult"))
    distinct = scratch.write(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    lengths = [r.d for r in distinct.select(F.size("embedding").alias("d")).distinct().collect()]
    found = [_one_length(distinct.where(F.size("embedding") == d).select("rep", "mult", "embedding"), d, threshold, scratch) for d in sorted(lengths)]
    out = base.select("vec_id", "embedding", "usable")
    if not found:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = scratch.write(every, "links")
    roots = connected_components(every.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch)
    count = every.groupBy("rep").agg(F.sum("links").alias("links"))
    known = distinct.join(count, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    known = scratch.write(known, "known")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(least, "root").select("embedding", "n_links", "component_id")
    joined = out.where("usable").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = out.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
