"""Line dedup by an exact set-similarity join.

A line's tokens are its five-word shingles (a shorter line is one token), known
by 58-bit hashes.  Tokens are ordered by rarity: the power of two of their own
counts over every line of the corpus, from a count sketch of fixed size, then
by hash.  Of two similar lines the longer has a token of its probe prefix in
the index prefix of the shorter, so lines meet on those tokens alone; length
and positional filters leave the pairs whose Jaccard similarity is computed on
whole token sets.  A line goes if an earlier line, in order of doc_id and
position, is equal to it or has a similarity of ``SIMILARITY`` or more.

Equal lines (128-bit hash) are one line from the first shuffle on.  The join
goes in two rounds, so that a group of near copies is never paired with itself:
first each line meets the first line of each token it shares; only those that
this leaves unmatched meet the rest.  Tokens that one line alone holds drop out by
count: a broadcast bit set of the others' hashes is looked up before any shuffle
of lines.  Pairs must also differ in no more bits of the sets' parities than the
similarity allows, so whole sets are cut for lines of the pairs left alone.

All of it is DataFrame functions.

Results for odd input: null text counts as empty and stays null; blank lines
always stay; lines are compared lower-cased and trimmed, words end at spaces, so
very long texts and lines cost linear time; rows that repeat an id and a text
keep the same lines, places of one id and position are not earlier than each
other; a null doc_id counts as larger than all others; an empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, own_names, texts

SIMILARITY = 0.8
SHINGLE = 5
#: Cells of the count sketch, as a power of two; its size is fixed.
SKETCH_BITS = 16
#: Bits of the broadcast bit sets, as powers of two: hashes of tokens and of documents.
TOKEN_BITS, DOCUMENT_BITS = 26, 24
#: Different tokens from which on a line has a second word of parities.
LONG = 40
_LAST = (1 << 63) - 1
#: Bits of a token in a prefix: a meeting by chance costs a pair, which whole sets settle.
_HEAD = (1 << 40) - 1


def _text_lines(text: Column) -> Column:
    """The lower-cased lines of a text."""
    return F.split(F.lower(text), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _words(line: Column) -> Column:
    """Hashes of the words of a trimmed line."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


def _shingle(i: Column) -> Column:
    """Hash of the shingle at a place of ``words``: two pairs and the fifth word."""
    w = [F.col("words")[i + k] for k in range(SHINGLE)]
    return _pair(_pair(_pair(w[0], w[1]), _pair(w[2], w[3])), w[4])


def _shingles(df: DataFrame) -> DataFrame:
    """``df`` with ``h``, the hashes of all shingles of ``words``, in its place: whole arrays
    are paired, which costs less than five look-ups for each place."""
    size = F.greatest(F.size("words") - (SHINGLE - 1), F.lit(0))
    at = lambda c, start, more=0: F.slice(c, F.lit(start), F.col("_size") + more)
    pairs = df.withColumn("_size", size).withColumn("_two", F.zip_with(at("words", 1, 2), at("words", 2, 2), _pair))
    out = pairs.withColumn("h", F.zip_with(F.zip_with(at("_two", 1), at("_two", 3), _pair), at("words", 5), _pair))
    return out.drop("words", "_size", "_two")


def _sketch(docs: DataFrame) -> Column:
    """Class of rarity of each cell: the power of two of its count, over all lines, as the
    highest bits of a token."""
    words = docs.select(F.explode(_text_lines(F.col("text"))).alias("line")).select(_words(_trimmed(F.col("line"))).alias("words"))
    # No filter on the number of words: it would go below the cut, and lines would be cut twice.
    at = words.select("words", F.explode(F.when(F.size("words") >= SHINGLE, F.sequence(F.lit(0), F.size("words") - SHINGLE))).alias("i"))
    found = at.groupBy(F.shiftrightunsigned(_shingle(F.col("i")), 64 - SKETCH_BITS).alias("cell")).count()
    classes = ["0"] * (1 << SKETCH_BITS)
    for r in found.collect():
        classes[r["cell"]] = str(min(int(math.log2(r["count"])), 31) << 58)
    return F.split(F.lit(",".join(classes)), ",").cast("array<bigint>")


def _lines(docs: DataFrame, classes: Column, t: float) -> DataFrame:
    """id, k1, k2 (hash of a line), d, th (of its text), p, n (different tokens), s1, s2
    (parities of all and of half of their hashes) and heads (its probe prefix, rarest first); a line of
    fewer words than a shingle is like none but its copies and has an empty prefix."""
    line = docs.select("d", "th", F.posexplode(_text_lines(F.col("text"))).alias("p", "line")).withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    cut = _shingles(line.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "d", "th", "p", _words(F.col("line")).alias("words")))
    # Never null, so arrays sort as plain numbers.
    order = lambda h: F.coalesce(classes[F.shiftrightunsigned(h, 64 - SKETCH_BITS)], F.lit(0).cast("long")).bitwiseOR(F.shiftrightunsigned(h, 6))
    sets = cut.withColumn("h", F.sort_array(F.array_distinct(F.transform("h", order)))).withColumn("n", F.size("h"))
    parity = lambda one: F.aggregate("h", F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(F.call_function("shiftleft", one(h), F.hash(h))))
    all_ones, half = lambda h: F.lit(1).cast("long"), lambda h: h.bitwiseAND(F.lit(1).cast("long"))
    size = F.when(F.col("n") > 0, F.col("n") - F.ceil(t * F.col("n") - 1e-9).cast("int") + 1).otherwise(0)
    heads = F.transform(F.slice("h", F.lit(1), size), lambda h: h.bitwiseAND(F.lit(_HEAD)))
    return sets.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "d", "th", "p", "n", parity(all_ones).alias("s1"), F.when(F.col("n") >= LONG, parity(half)).otherwise(F.lit(0).cast("long")).alias("s2"), heads.alias("heads"))


def _bit(x: Column) -> Column:
    """The bit that the low six bits of a number name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))


def _bits(cells: DataFrame, bits: int) -> DataFrame:
    """word, set: a bit set of a column ``cell``, of which the low ``bits`` bits count."""
    low = F.col("cell").bitwiseAND(F.lit((1 << bits) - 1))
    return cells.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(_bit(F.col("cell"))).alias("set"))


def _among(df: DataFrame, cell: Column, words: DataFrame, bits: int, inside: bool = True) -> DataFrame:
    """Rows whose cell is in a bit set (others of its cell come along), or the rest of the rows."""
    low = F.shiftright(cell.bitwiseAND(F.lit((1 << bits) - 1)), 6)
    hit = F.coalesce(F.col("set").bitwiseAND(_bit(cell)) != 0, F.lit(False))
    return df.join(F.broadcast(words), low == F.col("word"), "inner" if inside else "left").where(hit if inside else ~hit).select(*df.columns)


def _sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """id, h (all tokens) of the wanted lines: (id, d, th, p)."""
    key = F.xxhash64("d", "th")
    asked = scratch.write(wanted.groupBy("d", "th").agg(F.collect_list(F.struct("p", "id")).alias("asked")), "asked")
    some = _among(docs, key, _bits(asked.select(key.alias("cell")), DOCUMENT_BITS), DOCUMENT_BITS)
    rows = some.join(asked, ["d", "th"]).select(_text_lines(F.col("text")).alias("lines"), F.explode("asked").alias("a"))
    # Rows that repeat an id and a text give a line again.
    line = rows.select("a.id", F.col("lines")[F.col("a.p")].alias("line")).dropDuplicates(["id"])
    cut = _shingles(line.select("id", _words(_trimmed(F.col("line"))).alias("words")))
    return cut.select("id", F.array_distinct("h").alias("h"))


def _need(t: float, a: str, b: str) -> str:
    """Common tokens that two sets of sizes a and b need."""
    return f"ceil({t / (1 + t)!r} * ({a} + {b}) - 1e-9)"


def removals(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """d (doc_id, null as the largest), th (hash of the text) and drop (positions
    of the lines that go, ascending) for each document that loses a line."""
    t = similarity
    base = texts(docs).select(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("th"), "text")
    lines = scratch.write(_lines(base, _sketch(base), t), "lines")
    # One row for each different line, standing for its first place; lines whose hash comes once are that as they are.
    again = scratch.write(_bits(lines.groupBy("k1").count().where("count > 1").select(F.col("k1").alias("cell")), TOKEN_BITS), "again")
    repeated = _among(lines, F.col("k1"), again, TOKEN_BITS).groupBy("k1", "k2")
    first = repeated.agg(F.min(F.struct("d", "p", "th", "id")).alias("at"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "s1", "s2", "heads")])
    first = scratch.write(first.select("at.id", "k1", "k2", "at.d", "at.th", "at.p", "n", "s1", "s2", "heads", "copies"), "first")
    different = _among(lines, F.col("k1"), again, TOKEN_BITS, inside=False).withColumn("copies", F.lit(1).cast("long")).unionByName(first)
    tokens = different.select("id", "n", "s1", "s2", "d", "p", F.posexplode("heads").alias("i", "token"))
    # Of two lines the shorter holds the common token in its index prefix.
    index = lambda n, i: f"{i} <= {n} - {_need(t, n, n)}"
    held = tokens.select("token", F.expr(index("n", "i")).alias("own")).groupBy("token").agg(F.count("*").alias("held"), F.bool_or("own").alias("own"))
    common = scratch.write(_bits(held.where("held > 1 and own").select(F.col("token").alias("cell")), TOKEN_BITS), "common")
    shared = scratch.write(_among(tokens, F.col("token"), common, TOKEN_BITS), "shared")
    fits = f"""least(x.n, y.n) >= {t!r} * greatest(x.n, y.n) - 1e-9
        and 1 + least(x.n - 1 - x.i, y.n - 1 - y.i) >= {_need(t, 'x.n', 'y.n')}
        and if(x.n >= {LONG} and y.n >= {LONG}, bit_count(x.s2 ^ y.s2) + bit_count(x.s1 ^ x.s2 ^ y.s1 ^ y.s2), bit_count(x.s1 ^ y.s1))
            <= x.n + y.n - 2 * {_need(t, 'x.n', 'y.n')}"""
    earlier = "(y.d < x.d or y.d = x.d and y.p < x.p)"

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """id of the later line x of each similar pair (x, y)."""
        near = scratch.write(pairs.distinct(), f"{name}-pairs")
        wanted = near.select(F.explode(F.array("x", "y")).alias("id")).distinct()
        sets = scratch.write(_sets(base, different.join(wanted, "id").select("id", "d", "th", "p"), scratch), f"{name}-sets")
        a, b = sets.toDF("x", "x_h"), sets.toDF("y", "y_h")
        enough = f"size(array_intersect(x_h, y_h)) >= {_need(t, 'size(x_h)', 'size(y_h)')}"
        out = scratch.write(near.join(a, "x").join(b, "y").where(enough).select(F.col("x").alias("id")).distinct(), name)
        scratch.drop(near, sets)
        return out

    pair = [F.col("x.id").alias("x"), F.col("y.id").alias("y")]
    lead = shared.groupBy("token").agg(F.min(F.struct("d", "p", "id", "n", "i", "s1", "s2")).alias("f")).select("token", "f.*")
    matched = similar(shared.alias("x").join(lead.alias("y"), "token").where(earlier).where(fits).select(*pair), "leading")
    left = shared.join(matched, "id", "left_anti")
    # The shorter one's place is one of its index prefix.
    meets = f"if(y.n <= x.n, {index('y.n', 'y.i')}, {index('x.n', 'x.i')})"
    rest = similar(left.alias("x").join(shared.alias("y"), "token").where(meets).where(earlier).where(fits).select(*pair), "rest")
    scratch.drop(shared, common)
    near = matched.union(rest).withColumn("near", F.lit(True))
    flagged = different.select("id", "k1", "k2", F.struct("d", "p").alias("at"), "copies").join(near, "id", "left").where("near or copies > 1").select("k1", "k2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    flagged = scratch.write(flagged, "flagged")
    gone = lines.select("k1", "k2", "d", "th", "p").join(flagged, ["k1", "k2"]).where("near or not (at.d = d and at.p = p)")
    out = scratch.write(gone.groupBy("d", "th").agg(F.sort_array(F.collect_set("p")).alias("drop")), "drop")
    scratch.drop(lines, first, again, matched, rest, flagged)
    return out


def _kept(docs: DataFrame, similarity: float) -> DataFrame:
    """row (a row of ``docs`` as it is), drop, and kept (its text without those lines)."""
    scratch = Scratch(docs.sparkSession, "lines")
    gone = removals(docs, scratch, similarity)
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("d", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST))).withColumn("th", F.xxhash64(text))
    df = rows.join(gone, ["d", "th"], "left")
    # The pieces between the lines that go, joined again.
    kept = """transform(array(split(row.text, '\\n', -1)), l -> transform(array(concat(array(-1), drop, array(size(l)))),
        e -> array_join(flatten(transform(sequence(0, size(e) - 2), i -> slice(l, e[i] + 2, e[i + 1] - e[i] - 1))), '\\n'))[0])[0]"""
    return df.select("row", "drop", F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.expr(kept)).alias("kept"))


@own_names
def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the lines that repeat or nearly repeat an earlier one."""
    out = _kept(docs, similarity)
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for each document."""
    out = _kept(docs.select("doc_id", "text"), similarity)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.size(F.split(F.coalesce("row.text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
