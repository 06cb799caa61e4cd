"""Personal data: fixed rules, then bootstrapped contextual extraction.

Everything here is DataFrame and SQL functions.  The rules' hits are seeds.  The
two tokens in front of a seed, words or single marks, are a lexical pattern; a
value that goes on the word before it has none.  Patterns and the values
that follow them form a graph whose scores are computed in turn: a pattern's
score is the share of all its occurrences in the corpus that lead to a value,
weighted by the value's score; a value that no rule knows scores as the chance
that one of its patterns is right.  After ``ROUNDS`` rounds the patterns above
``CONFIDENT`` mark the next token behind them, whatever its shape, kind ``id``.

Match positions come from splitting the text at the matches and summing lengths
in code points.  Quantifiers are possessive where that cannot change a match,
so long runs cost linear time and no stack.

Results for odd input: null text counts as empty and has no span; repeated rows
are scanned each; a corpus without seeds has rule spans only (none).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, texts

#: Distinct values a pattern needs; rounds of scoring; score of a trusted pattern.
LEAST_VALUES = 5
ROUNDS = 3
CONFIDENT = 0.8
#: Bits (as a power of two) of the table that tells pairs which no pattern holds; its size is fixed.
CELL_BITS = 18
#: Code points before a value in which its two context tokens are sought first; if
#: they do not lie there whole, all of the text before is read.
CONTEXT = 64

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: An identifier that no rule knows and that patterns learn from: letters, then five or more digits, letters and dashes.
UNKNOWN = r"(?<![A-Za-z0-9@._+-])[A-Za-z]*+-?[0-9][A-Za-z0-9-]{4,}+(?![@_]|\.[A-Za-z0-9@_-])"
#: What a trusted pattern marks: the next token, whatever its shape, without closing marks.
NEXT = r"\A[+#-]?[\p{L}\p{N}_](?:[^\s\x22\x27<>()\[\]{},;]*[\p{L}\p{M}\p{N}_])?"
#: Tokens of patterns: words and single marks.
WORD = r"\p{L}\p{M}\p{N}_"
TOKEN = rf"[{WORD}]++|[^\s{WORD}]"
KINDS = ("email", "ip", "card", "phone", "id")

_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "struct<start:bigint,kind:int,stop:bigint,value:string>"


def _luhn(digits: str) -> str:
    """SQL for the Luhn test of a string of digits."""
    return f"""aggregate(sequence(1, length({digits})), 0L, (a, i) -> a + (
        (cast(substring({digits}, length({digits}) + 1 - i, 1) as int) * (2 - i % 2)) div 10
        + (cast(substring({digits}, length({digits}) + 1 - i, 1) as int) * (2 - i % 2)) % 10)) % 10 = 0"""


#: Filters of each kind over x.value (a match).
_TESTS = {
    "email": "true",
    "ip": f"x.value rlike '^({_BYTE}[.]){{3}}{_BYTE}$'",
    "card": "length(regexp_replace(x.value, '[^0-9]', '')) between 12 and 19 and " + _luhn("regexp_replace(x.value, '[^0-9]', '')"),
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) between 9 and 15",
    "id": "true",
}


def _located(kind: int, found: str, between: str) -> Column:
    """Spans from the matches of a rule and the pieces between them."""
    step = f"""named_struct('at', a.at + length({between}[i]) + length({found}[i]), 'out', array_append(a.out,
        named_struct('start', a.at + length({between}[i]), 'kind', {kind}, 'stop', a.at + length({between}[i]) + length({found}[i]), 'value', {found}[i])))"""
    walk = f"""aggregate(sequence(0, size({found}) - 1), cast(named_struct('at', 0L, 'out', array()) as struct<at:bigint,out:array<{_SPAN}>>),
        (a, i) -> cast({step} as struct<at:bigint,out:array<{_SPAN}>>), a -> a.out)"""
    return F.expr(f"if(size({found}) = 0, cast(array() as array<{_SPAN}>), filter({walk}, x -> {_TESTS[KINDS[kind]]}))")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, base (spans of the rules) and unknown (other identifiers); narrow."""
    rules = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, UNKNOWN)))
    df = texts(docs)
    df = df.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(r), F.lit(0)).alias(f"m_{k}") for k, r in rules.items()])
    df = df.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", r, -1)).alias(f"p_{k}") for k, r in rules.items()])
    df = df.select("doc_id", "text", *[_located(n, f"m_{k}", f"p_{k}").alias(k) for n, k in enumerate(KINDS)])
    df = df.select("doc_id", "text", F.array_sort(F.concat(*KINDS[:4])).alias("base"), F.col("id").alias("free"))
    apart = "filter(free, x -> not exists(base, b -> b.start < x.stop and x.start < b.stop))"
    return df.select("doc_id", "text", "base", F.expr(apart).alias("unknown"))


def _contexts(of: str) -> Column:
    """pattern, value, start, stop of each span: the pattern is its two tokens in front."""
    near = f"substring(text, cast(greatest(x.start - {CONTEXT}, 0) as int) + 1, cast(least(x.start, {CONTEXT}) as int))"
    words = lambda t: f"regexp_extract_all({t}, r'{TOKEN}', 0)"
    whole = f"transform({of}, x -> named_struct('x', x, 'near', {near}, 'w', {words(near)}))"
    # The first token of a window inside the text may be the rest of a longer one.
    whole = f"transform({whole}, c -> if(size(c.w) < 3 and c.x.start > {CONTEXT}, named_struct('x', c.x, 'near', c.near, 'w', {words('substring(text, 1, cast(c.x.start as int))')}), c))"
    glued = rf"c.near rlike r'[{WORD}]\z' and c.x.value rlike r'\A[{WORD}]'"
    pattern = f"if(size(c.w) < 2 or ({glued}), '', lower(array_join(slice(c.w, -2, 2), ' ')))"
    return F.expr(f"transform({whole}, c -> named_struct('pattern', {pattern}, 'value', lower(c.x.value), 'start', c.x.start, 'stop', c.x.stop))")


def _digest(column: str) -> Column:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    return F.expr(f"array_join(transform({column}, s -> concat_ws(':', {names}, s.start, s.stop)), ',')")


def _pairs() -> Column:
    """The patterns at each place of a text, in order."""
    return F.expr("zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> lower(concat(a, ' ', b)))")


def _occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often each pattern occurs in the whole corpus.

    Pairs that share no cell of a fixed bit table with a pattern drop out before
    they are counted; the counts meet the patterns once they are aggregated."""
    cell = F.shiftrightunsigned(F.xxhash64("pattern"), 64 - CELL_BITS)
    bits = [0] * (1 << CELL_BITS - 5)
    for r in patterns.select(cell.cast("int").alias("cell")).distinct().collect():
        bits[r["cell"] >> 5] |= 1 << (r["cell"] & 31)
    held = F.getbit(F.get(F.lit(np.array(bits, np.int64)), F.shiftright(cell, 5).cast("int")), cell.bitwiseAND(F.lit(31)).cast("int"))
    words = texts(docs).select(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(_pairs()).alias("pattern")).where(held == 1)
    return pairs.groupBy("pattern").agg(F.count("*").alias("total")).join(patterns, "pattern")


def _trusted(docs: DataFrame, found: DataFrame, scratch: Scratch, least_values: int) -> DataFrame:
    """The patterns whose score after the last round is above CONFIDENT."""
    seeds = found.select(F.explode("seeds").alias("c")).select("c.pattern", "c.value", F.lit(1.0).alias("seed"))
    others = found.select(F.explode("others").alias("c")).select("c.pattern", "c.value", F.lit(0.0).alias("seed"))
    edges = seeds.union(others).where("pattern <> ''").groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = scratch.write(edges, "edges")
    wide = scratch.write(edges.groupBy("pattern").agg(F.count("*").alias("values")).where(F.col("values") >= least_values).select("pattern"), "patterns")
    if wide.isEmpty():
        return wide
    total = scratch.write(_occurrences(docs, wide), "totals")
    edges = scratch.write(edges.join(total, "pattern"), "graph")
    values = edges.groupBy("value").agg(F.max("seed").alias("score"))
    for k in range(ROUNDS):
        scored = edges.join(values, "value").groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + 1)).alias("trust"))
        scored = scratch.write(scored, "scores")
        back = edges.join(scored, "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))).alias("miss"))
        values = scratch.write(back.select("value", F.greatest("seed", 1 - F.exp("miss")).alias("score")), "values")
    return scored.where(F.col("trust") >= CONFIDENT).select("pattern")


def _marked(found: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """row, added: the tokens behind trusted patterns that no rule's span meets."""
    places = found.select("row", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("w")).select("row", F.posexplode(_pairs()).alias("at", "pattern"))
    places = places.join(trusted, "pattern", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"))
    df = scratch.write(places, "places").join(found.select("row", "text", "base"), "row")
    pieces = F.regexp_extract_all("text", F.lit(rf"(?:{TOKEN})\s*+"), F.lit(0))
    df = df.withColumn("pieces", pieces).withColumn("lead", F.length(F.regexp_extract("text", r"\A\s*+", 0)).cast("long"))
    # The token behind place k starts where its first k + 2 pieces end.
    step = """named_struct('done', k + 2, 'off', a.off + length(array_join(slice(pieces, a.done + 1, k + 2 - a.done), '')),
        'out', array_append(a.out, a.off + length(array_join(slice(pieces, a.done + 1, k + 2 - a.done), ''))))"""
    kind = "struct<done:int,off:bigint,out:array<bigint>>"
    walk = f"aggregate(at, cast(named_struct('done', 0, 'off', lead, 'out', array()) as {kind}), (a, k) -> cast({step} as {kind}), a -> a.out)"
    spans = f"transform({walk}, o -> named_struct('start', o, 'kind', 4, 'stop', o + length(regexp_extract(substring(text, cast(o as int) + 1), r'{NEXT}', 0))))"
    df = df.select("row", "base", F.expr(spans).alias("s"))
    apart = """filter(s, x -> x.stop > x.start and not exists(base, b -> b.start < x.stop and x.start < b.stop)
        and not exists(s, y -> y.start < x.start and x.start < y.stop))"""
    return df.select("row", F.expr(apart).alias("added"))


def scan(docs: DataFrame, least_values: int = LEAST_VALUES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans for each
    document.  A pattern is learned from if ``least_values`` different values follow it."""
    scratch = Scratch(docs.sparkSession, "pii")
    df = spans(docs)
    plain = "transform(base, x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop))"
    df = df.select("doc_id", "text", F.expr(plain).alias("base"), _contexts("base").alias("seeds"), _contexts("unknown").alias("others"))
    found = scratch.write(df.withColumn("row", F.monotonically_increasing_id()), "spans")
    trusted = _trusted(docs, found, scratch, least_values)
    added = scratch.write(_marked(found, trusted, scratch), "added")
    empty = F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint>>)")
    out = found.select("row", "doc_id", "base").join(added, "row", "left").withColumn("added", F.coalesce("added", empty))
    out = out.withColumn("every", F.array_sort(F.concat("base", "added")))
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[count(k) for k in range(4)], F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("every").alias("spans"), F.size("added").cast("long").alias("n_id"), F.size("every").cast("long").alias("n_spans"))
