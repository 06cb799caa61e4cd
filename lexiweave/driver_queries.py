"""Registered queries of the conversion engine and their SQL.

Latin lexicons run over the driver's tables; literal rows carry what these
tables do not hold (description sequences, astral characters, lexicon texts).
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, derive, lookup
from .operators.convert import convert, inspect, segment
from .plans.model import SHORT_CIRCUIT, UNION, Converter, Group, Leaf
from .sources import container, corpus, lexicon, sinks

CHAR = {"é": "e", "è": "e", "ê": "e", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ñ": "n", "ó": "o", "í": "i", "ç": "c"}
PHRASE = {"tion": "ZION", "tions": "ZIONS", "ment": "MNT", "ció": "CIO", "sch": "SH"}
OTHER = {"ti": "T1", "tionally": "T2", "en": "N"}
SINGLE = {k: v for k, v in CHAR.items() if len(v) == 1}
SECOND = {"ZION": "X"}


def _leaf(entries: dict[str, str]) -> Leaf:
    return Leaf({k: [v] for k, v in entries.items()})


LX_CHAR, LX_PHR, LX_ALT, LX_ONE, LX_TWO = map(_leaf, (CHAR, PHRASE, OTHER, SINGLE, SECOND))
SC = Group([LX_ALT, LX_PHR], SHORT_CIRCUIT)
UN = Group([LX_ALT, LX_PHR], UNION)
NESTED = Group([Group([LX_PHR, LX_ALT], UNION), LX_CHAR], SHORT_CIRCUIT)
CHAIN = Converter((LX_PHR, LX_TWO))
SEGMENTED = Converter((LX_ALT, LX_CHAR), LX_PHR)
FULL = Converter((LX_PHR, LX_TWO), LX_PHR, (LX_CHAR,))


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _converted(table: str, key: str, plan):
    return lambda s, d: _table(s, d, table).select(key, convert("text", plan).alias("output"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents converted in two stages, counted by language."""
    docs = _table(spark, sf, "documents").select("lang", "text", convert("text", CHAIN).alias("output"))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("output").cast("long")).alias("chars"), F.sum((F.col("text") != F.col("output")).cast("long")).alias("changed"))


def _segments(s, d):
    cut = _table(s, d, "benchmark").select("item_id", segment("text", LX_PHR).alias("segs"))
    return cut.select("item_id", F.posexplode("segs").alias("pos", "seg")).select("item_id", F.col("pos").cast("long").alias("pos"), "seg")


def _inspected(s, d):
    got = _table(s, d, "benchmark").select("item_id", inspect("text", FULL).alias("i"))
    stage = lambda name: got.select("item_id", F.lit(name).alias("kind"), F.explode(f"i.{name}").alias("t")).select("item_id", "kind", F.col("t.index").cast("long").alias("stage"), F.array_join("t.segments", "|").alias("joined"))
    plain = got.select("item_id", F.lit("segments").alias("kind"), F.lit(0).cast("long").alias("stage"), F.array_join("i.segments", "|").alias("joined"))
    output = got.select("item_id", F.lit("output").alias("kind"), F.lit(0).cast("long").alias("stage"), F.col("i.output").alias("joined"))
    return stage("normalization_stages").union(plain).union(stage("stages")).union(output)


def _tofu(include: bool):
    import json

    from .api import Options, create_from_config
    from .sources.lexicon import Resources

    inline = lambda e: {"type": "inline", "entries": e}
    flagged = {"type": "group", "match_policy": "union", "may_output_tofu": True, "dicts": [inline(OTHER)]}
    doc = {"conversion_chain": [{"dict": {"type": "group", "match_policy": "short_circuit", "dicts": [flagged, inline(PHRASE)]}}]}
    made = create_from_config(json.dumps(doc), Resources(), Options(include))
    return lambda s, d: _table(s, d, "documents").select("doc_id", made.column("text").alias("output"))


#: Literal description-sequence cases: input, plan, expected output, length of the sequence it begins with.
IDS_CASES = [("⿰ab", {"⿰a": "X"}, "Xb", 3), ("a⿾证", {"证": "證"}, "a⿾证", 0), ("x⿰钅只", {"只": "隻"}, "x⿰钅只", 0), ("⿰a", {"a": "A"}, "⿰A", 0), ("⿰ab猫", {"猫": "cat"}, "⿰abcat", 3), ("⿾" * 15 + "a", {"a": "A"}, "⿾" * 15 + "a", 16), ("⿾" * 16 + "a", {"a": "A"}, "⿾" + "⿾" * 15 + "a", 0), ("⿱⿰abc", {"c": "C"}, "⿱⿰abc", 5), ("𐈀a𐈀", {"a": "A"}, "𐈀A𐈀", 0)]


def _ids(s, d):
    from .functions.columns import ids_length

    parts = [s.createDataFrame([(n, t)], "n long, input string").select("n", "input", convert("input", _leaf(p)).alias("output"), ids_length("input").cast("long").alias("ids_length")) for n, (t, p, _, _) in enumerate(IDS_CASES)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


WORDS = [("blue", ["azul", "bleu"]), ("red", ["rojo"]), ("an", ["x"]), ("al", ["w"]), ("almond", ["y", "z"]), ("a", ["v"])]
MORE = [("blue", ["blau"]), ("green", ["vert"]), ("almo", ["q"])]


def _lex(s, name, rows, child=0):
    return s.createDataFrame([(name, k, v, child) for k, v in rows], "lexicon string, key string, candidates array<string>, child_ord int")


def _part_words(s, d):
    return _table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))


def _names(s, d):
    """Distinct part names as a lexicon."""
    return _table(s, d, "part").select(F.lit("parts").alias("lexicon"), F.col("p_name").alias("key")).distinct().withColumn("candidates", F.array("key"))


LEXICON_TEXT = "# colours\nblue\tazul bleu\r\n\nred\trojo\nwide\ta  b\ngone\t\n"


def _text_rows(s, d):
    got = lexicon.text_frame(s.createDataFrame([("t", LEXICON_TEXT)], "lexicon string, value string"))
    return got.select("lexicon", F.col("ord").cast("long").alias("ord"), "key", F.array_join("candidates", "|").alias("candidates"), F.size("candidates").cast("long").alias("n"))


def _source_rows(s, d):
    entries, _ = lexicon.parse_source(LEXICON_TEXT.replace("gone\t\n", ""))
    return s.createDataFrame([(k, "|".join(v), len(v)) for k, v in entries], "key string, candidates string, n long")


ORDER = ["\ue000", "𐈀", "z", "é", "中", "ab", "a"]


def _ordered(s, d):
    lex = s.createDataFrame([("o", k, ["v"]) for k in ORDER], "lexicon string, key string, candidates array<string>")
    keys = [r.key for r in lexicon.ordered(lex).collect()]
    return s.createDataFrame([(ord(k[0]), n) for n, k in enumerate(keys)], "code_point long, rn long").groupBy("code_point").agg(F.min("rn").alias("start"), F.count("*").alias("size"))


def _corpus(s, d):
    col = lambda t, c: _table(s, d, t).select(F.col(c).alias("input"))
    return corpus.united(col("benchmark", "text"), col("conversations", "text"), col("part", "p_name")).select("input")


def _nation_lexicon(s, d):
    n, r = _table(s, d, "nation"), _table(s, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.lit("nations").alias("lexicon"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("key"), F.array("r_name").alias("candidates"))


def _reversed(s, d):
    got = derive.reverse(_nation_lexicon(s, d))
    return got.select("key", F.array_join("candidates", "|").alias("candidates"))


TOFU_LINES = ["# @tofu-risk: u1", "后\t后 後", "干\t乾 干", "# @tofu-risk: u2", "发\t发发", "# note"]


def _tofu_lines(s, d):
    rows = s.createDataFrame([("f", n, t) for n, t in enumerate(TOFU_LINES)], "file string, line_no int, line string")
    return derive.tofu_risk(rows).select("key", F.array_join("candidates", "|").alias("candidates"))


def _regional(s, d):
    names = _table(s, d, "part").groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("ord"))
    return derive.regional(names, _leaf({"x": "x"})).select("key", F.array_join("candidates", "|").alias("candidates"))


def _closure(s, d):
    a = _table(s, d, "documents").select(F.col("doc_id").cast("string").alias("name"))
    return derive.closure(a, _table(s, d, "labels").select(F.col("doc_id").cast("string").alias("name")))


def _drift(s, d):
    rows = lambda name, mark, key, content: _table(s, d, name).select(F.concat(F.lit(mark), key).alias("path"), F.col(content).cast("string").alias("content"))
    expected = rows("supplier", "k", "s_suppkey", "s_nationkey").union(rows("nation", "n", "n_nationkey", "n_regionkey"))
    return sinks.drift(expected, rows("customer", "k", "c_custkey", "c_nationkey"))


def _stats(s, d):
    got = compare.stats(_names(s, d))
    return got.select("lexicon", "entries", "key_bytes", "starts", "largest_group", "largest_start", "astral_starts", "candidates", "most_candidates", "multi_candidates")


def _compared(s, d):
    docs = _table(s, d, "documents")
    run = lambda tier: docs.select(F.col("doc_id").alias("id"), convert("text", NESTED, tier).alias("output"))
    return compare.compare(run("native"), run("udf"))[0]


def _changes(s, d):
    docs = _table(s, d, "documents")
    tally, _ = compare.compare(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("output")), docs.select(F.col("doc_id").alias("id"), convert("text", CHAIN).alias("output")))
    return tally


def _verdicts(s, d):
    a = _table(s, d, "documents").where("lang = 'en'").select("doc_id")
    return compare.verdict_split(a, _table(s, d, "labels").select("doc_id"), ["doc_id"])


def _percentiles(s, d):
    return compare.percentiles(_table(s, d, "events"), ["event_type"])


def _round_trip(s, d):
    made = container.containers(_names(s, d))
    got = container.entries(made)
    return got.select("lexicon", F.col("ord").cast("long").alias("ord"), "key", F.array_join("candidates", "|").alias("candidates"))


def conformance_inputs() -> list[tuple[str, bytes]]:
    """One good container and one broken by each acceptance rule."""
    good = container.encode([("a", ["A"]), ("ab", ["AB", "b"]), ("中", ["C"])])
    put = lambda at, fmt, *v: good[:at] + struct.pack(fmt, *v) + good[at + struct.calcsize(fmt) :]
    keys, values, counts, blob = 32, 48, 64, 67
    return [
        ("good", good),
        ("empty", container.encode([])),
        ("V1", good[:31]),
        ("V2", put(0, "<4s", b"SOK2")),
        ("V3", put(4, "<I", 2)),
        ("V4", put(8, "<I", 1)),
        ("V5", put(16, "<I", 9)),
        ("V6", good + b"x"),
        ("V7", put(keys + 4, "<I", 0)),
        ("V8", put(blob, "<B", 0xFF)),
        ("V9", put(values + 4, "<I", 0)),
        ("V10", put(counts, "<B", 0)),
        ("V11", put(counts, "<B", 2)),
        ("V12", put(blob, "<B", ord("b"))),
    ]


def _conformance(s, d):
    return container.verdicts(s.createDataFrame([(i, bytearray(b)) for i, b in conformance_inputs()], "id string, bytes binary"))


def queries():
    """Name -> (spark, sf_dir) -> DataFrame."""
    docs = lambda plan: _converted("documents", "doc_id", plan)
    group = lambda s: _lex(s, "a", WORDS, 1).union(_lex(s, "b", MORE, 0))
    words = lambda s, d: _part_words(s, d).distinct()
    hit = lambda df: df.select("word", "length", "value")
    return {
        "flagship": flagship,
        "c1_convert_leaf": docs(LX_CHAR),
        "c1_translate": docs(LX_ONE),
        "p9_short_circuit": docs(SC),
        "p10_union": docs(UN),
        "p9_p10_nested": docs(NESTED),
        "c4_chain": docs(CHAIN),
        "c10_normalize": docs(Converter((LX_PHR,), None, (LX_CHAR,))),
        "c5_segmented_chain": _converted("benchmark", "item_id", SEGMENTED),
        "c6_segment": _segments,
        "c9_inspect": _inspected,
        "c12_tofu_off": _tofu(False),
        "c12_tofu_on": _tofu(True),
        "ids_values": _ids,
        "p1_exact": lambda s, d: lookup.exact(_part_words(s, d), "word", _lex(s, "a", WORDS)).groupBy("word").agg(F.count("*").alias("n"), F.first(F.array_join("candidates", "|")).alias("candidates")),
        "p2_prefix_join": lambda s, d: hit(lookup.longest_prefix(words(s, d), "word", _lex(s, "a", WORDS))),
        "p9_group_prefix": lambda s, d: hit(lookup.group_prefix(words(s, d), "word", group(s), SHORT_CIRCUIT)),
        "p10_group_prefix": lambda s, d: hit(lookup.group_prefix(words(s, d), "word", group(s), UNION)),
        "p5_semi": lambda s, d: lookup.starting(words(s, d), "word", _lex(s, "a", WORDS)),
        "p7_group_index": lambda s, d: lookup.group_index(_names(s, d)).select(F.col("code_point").cast("long").alias("code_point"), F.col("start").cast("long").alias("start"), "size"),
        "p8_max_key": lambda s, d: lookup.max_key_length(_names(s, d)),
        "p11_group_exact": lambda s, d: lookup.group_exact(words(s, d), "word", group(s)).select("word", F.array_join("candidates", "|").alias("candidates")),
        "q5_self_lookup": lambda s, d: lookup.self_lookup(_names(s, d)).agg(F.count("*").alias("missing")),
        "s2_text_parse": _text_rows,
        "s4_lexicon_parse": _source_rows,
        "s5_order": _ordered,
        "s17_corpus": _corpus,
        "k2_dump": lambda s, d: sinks.lexicon_lines(_names(s, d)),
        "g1_reverse": _reversed,
        "g2_tofu": _tofu_lines,
        "g3_regional": _regional,
        "g7_closure": _closure,
        "k5_drift": _drift,
        "q3_stats": _stats,
        "x1_compare": _compared,
        "x1_changes": _changes,
        "x4_verdict": _verdicts,
        "m1_percentiles": _percentiles,
        "k1_roundtrip": _round_trip,
        "v_conformance": _conformance,
    }


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(keys) -> str:
    return "(?s)" + "|".join(keys) + "|."


def _apply(text: str, pairs: list[tuple[str, str]]) -> str:
    """SQL that converts by an ordered alternation and a map."""
    keys, values = ", ".join(_q(k) for k, _ in pairs), ", ".join(_q(v) for _, v in pairs)
    return f"array_to_string(list_transform(regexp_extract_all({text}, {_q(_pattern(k for k, _ in pairs))}), lambda t: coalesce(MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in pairs)}}}[t], t)), '')" if keys and values else text


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    from .operators.convert import flattened

    longest = lambda e: sorted(e.items(), key=lambda x: (-len(x[0]), x[0]))
    docs = lambda pairs: f"SELECT doc_id, {_apply('text', pairs)} AS output FROM documents"
    phr, two, char = longest(PHRASE), longest(SECOND), longest(CHAR)
    nested = "text"
    for k, v in CHAR.items():
        nested = f"replace({nested}, {_q(k)}, {_q(v)})"
    one = f"translate(text, {_q(''.join(SINGLE))}, {_q(''.join(SINGLE.values()))})"
    chain = _apply(_apply("text", phr), two)
    lex = lambda rows: ", ".join(f"({_q(k)}, [{', '.join(map(_q, v))}])" for k, v in rows)
    lexicon_cte = f"lex(key, candidates) AS (VALUES {lex(WORDS)})"
    group_cte = f"grp(key, candidates, child_ord) AS (SELECT *, 1 FROM (VALUES {lex(WORDS)}) UNION ALL SELECT *, 0 FROM (VALUES {lex(MORE)}))"
    words = "w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"
    ranked = lambda order: f"WITH {words}, {group_cte}, r AS (SELECT word, length(key) AS length, candidates[1] AS value, row_number() OVER (PARTITION BY word ORDER BY {order}) AS n FROM w JOIN grp ON starts_with(word, key)) SELECT word, CAST(length AS BIGINT) AS length, value FROM r WHERE n = 1"
    tokens = f"""tok AS (SELECT item_id, unnest(regexp_extract_all(t, {_q(_pattern(k for k, _ in phr))})) AS tok, generate_subscripts(regexp_extract_all(t, {_q(_pattern(k for k, _ in phr))}), 1) AS i FROM src),
        flag AS (SELECT *, tok IN ({', '.join(_q(k) for k, _ in phr)}) AS hit FROM tok),
        brk AS (SELECT *, CASE WHEN hit OR coalesce(lag(hit) OVER (PARTITION BY item_id ORDER BY i), true) THEN 1 ELSE 0 END AS b FROM flag),
        grp AS (SELECT *, sum(b) OVER (PARTITION BY item_id ORDER BY i) AS g FROM brk),
        seg AS (SELECT item_id, CAST(g - 1 AS BIGINT) AS pos, string_agg(tok, '' ORDER BY i) AS seg FROM grp GROUP BY item_id, g)"""
    segmented = lambda text: f"WITH src AS (SELECT item_id, {text} AS t FROM benchmark), {tokens}"
    norm = _apply("text", char)
    stage1, stage2 = _apply("seg", phr), _apply(_apply("seg", phr), two)
    joined = lambda kind, n, e: f"SELECT item_id, '{kind}' AS kind, CAST({n} AS BIGINT) AS stage, string_agg({e}, '|' ORDER BY pos) AS joined FROM seg GROUP BY item_id"
    names = "(SELECT DISTINCT p_name AS key FROM part)"
    literal = "SELECT * FROM (VALUES "
    # The same conversion with runs of other characters taken at once.
    starts = "".join(sorted({k[0] for k in PHRASE | OTHER | CHAR}))
    runs = _apply("text", longest(PHRASE | OTHER) + char).replace("(?s)", f"(?s)[^{starts}]+|")
    text_rows = [("t", 2, "blue", "azul|bleu", 2), ("t", 4, "red", "rojo", 1), ("t", 5, "wide", "a||b", 3), ("t", 6, "gone", "", 1)]
    ids = ", ".join(f"({n}, {_q(t)}, {_q(o)}, {k})" for n, (t, _, o, k) in enumerate(IDS_CASES))
    return {
        "flagship": f"WITH c AS (SELECT lang, text, {chain} AS output FROM documents) SELECT lang, count(*) AS docs, CAST(sum(length(output)) AS BIGINT) AS chars, CAST(sum(CASE WHEN text <> output THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM c GROUP BY lang",
        "c1_convert_leaf": f"SELECT doc_id, {nested} AS output FROM documents",
        "c1_translate": f"SELECT doc_id, {one} AS output FROM documents",
        "p9_short_circuit": docs(longest(OTHER) + phr),
        "p10_union": docs(longest(PHRASE | OTHER)),
        "p9_p10_nested": docs(longest(PHRASE | OTHER) + char),
        "c4_chain": f"SELECT doc_id, {chain} AS output FROM documents",
        "c10_normalize": f"SELECT doc_id, {_apply(nested, phr)} AS output FROM documents",
        "c5_segmented_chain": f"{segmented('text')} SELECT b.item_id, coalesce(o.output, '') AS output FROM benchmark b LEFT JOIN (SELECT item_id, string_agg({_apply(_apply('seg', longest(OTHER)), char)}, '' ORDER BY pos) AS output FROM seg GROUP BY item_id) o USING (item_id)",
        "c6_segment": f"{segmented('text')} SELECT item_id, pos, seg FROM seg",
        "c9_inspect": f"{segmented(norm)} SELECT item_id, 'normalization_stages' AS kind, CAST(1 AS BIGINT) AS stage, t AS joined FROM src UNION ALL {joined('segments', 0, 'seg')} UNION ALL {joined('stages', 1, stage1)} UNION ALL {joined('stages', 2, stage2)} UNION ALL SELECT item_id, 'output', 0, string_agg({stage2}, '' ORDER BY pos) FROM seg GROUP BY item_id",
        "c12_tofu_off": docs(phr),
        "c12_tofu_on": docs(longest(OTHER) + phr),
        "ids_values": f"SELECT CAST(n AS BIGINT) AS n, input, output, CAST(k AS BIGINT) AS ids_length FROM (VALUES {ids}) t(n, input, output, k)",
        "p1_exact": f"WITH w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part), {lexicon_cte} SELECT word, count(*) AS n, any_value(array_to_string(candidates, '|')) AS candidates FROM w LEFT JOIN lex ON key = word GROUP BY word",
        "p2_prefix_join": f"WITH {words}, {lexicon_cte} SELECT word, CAST(max(length(key)) AS BIGINT) AS length, arg_max(candidates[1], length(key)) AS value FROM w JOIN lex ON starts_with(word, key) GROUP BY word",
        "p9_group_prefix": ranked("child_ord, length(key) DESC"),
        "p10_group_prefix": ranked("length(key) DESC, child_ord"),
        "p5_semi": f"WITH {words} SELECT word FROM w WHERE word <> '' AND substr(word, 1, 1) IN ({', '.join(sorted({_q(k[0]) for k, _ in WORDS}))})",
        "p7_group_index": f"SELECT CAST(unicode(key) AS BIGINT) AS code_point, min(rn) AS start, count(*) AS size FROM (SELECT key, row_number() OVER (ORDER BY encode(key)) - 1 AS rn FROM {names}) GROUP BY unicode(key)",
        "p8_max_key": f"SELECT 'parts' AS lexicon, CAST(max(length(key)) AS BIGINT) AS max_key_length FROM {names}",
        "p11_group_exact": f"WITH {words}, {group_cte} SELECT word, any_value(c) AS candidates FROM (SELECT word, (SELECT arg_min(array_to_string(candidates, '|'), child_ord) FROM grp WHERE key = word) AS c FROM w) GROUP BY word",
        "q5_self_lookup": f"SELECT count(*) AS missing FROM {names} a WHERE NOT EXISTS (SELECT 1 FROM {names} b WHERE b.key = a.key)",
        "s2_text_parse": literal + ", ".join(f"({_q(a)}, CAST({n} AS BIGINT), {_q(k)}, {_q(v)}, CAST({c} AS BIGINT))" for a, n, k, v, c in text_rows) + ") t(lexicon, ord, key, candidates, n)",
        "s4_lexicon_parse": literal + "('blue', 'azul|bleu', CAST(2 AS BIGINT)), ('red', 'rojo', 1), ('wide', 'a|b', 2)) t(key, candidates, n)",
        "s5_order": f"SELECT CAST(unicode(k) AS BIGINT) AS code_point, min(rn) AS start, count(*) AS size FROM (SELECT k, row_number() OVER (ORDER BY encode(k)) - 1 AS rn FROM (VALUES {', '.join(f'({_q(k)})' for k in ORDER)}) t(k)) GROUP BY unicode(k)",
        "s17_corpus": "SELECT DISTINCT input FROM (SELECT text AS input FROM benchmark UNION ALL SELECT text FROM conversations UNION ALL SELECT p_name FROM part) WHERE NOT regexp_matches(input, '[\\n\\r\\x00]')",
        "k2_dump": f"SELECT key || chr(9) || key AS value FROM {names}",
        "g1_reverse": "SELECT r_name AS key, string_agg(n_name, '|' ORDER BY n_nationkey) AS candidates FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
        "g2_tofu": literal + "('后', '後'), ('发', '发发')) t(key, candidates)",
        "g3_regional": f"SELECT key, key AS candidates FROM {names} WHERE length(key) >= 3",
        "g7_closure": "SELECT coalesce(CAST(d.doc_id AS VARCHAR), CAST(l.doc_id AS VARCHAR)) AS name, CASE WHEN l.doc_id IS NULL THEN 'not generated' ELSE 'not referenced' END AS state FROM (SELECT DISTINCT doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
        "k5_drift": "WITH e AS (SELECT 'k' || s_suppkey AS path, CAST(s_nationkey AS VARCHAR) AS content FROM supplier UNION ALL SELECT 'n' || n_nationkey, CAST(n_regionkey AS VARCHAR) FROM nation), f AS (SELECT 'k' || c_custkey AS path, CAST(c_nationkey AS VARCHAR) AS content FROM customer) SELECT coalesce(e.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'stale' ELSE 'different' END AS state FROM e FULL JOIN f ON e.path = f.path WHERE e.path IS NULL OR f.path IS NULL OR e.content <> f.content",
        "q3_stats": f"WITH k AS (SELECT key, unicode(key) AS cp FROM {names}), g AS (SELECT cp, count(*) AS n FROM k GROUP BY cp) SELECT 'parts' AS lexicon, (SELECT count(*) FROM k) AS entries, (SELECT CAST(sum(strlen(key)) AS BIGINT) FROM k) AS key_bytes, count(*) AS starts, max(n) AS largest_group, CAST((SELECT cp FROM g ORDER BY n DESC, cp LIMIT 1) AS BIGINT) AS largest_start, CAST(sum(CASE WHEN cp > 65535 THEN n ELSE 0 END) AS BIGINT) AS astral_starts, (SELECT count(*) FROM k) AS candidates, CAST(1 AS BIGINT) AS most_candidates, CAST(0 AS BIGINT) AS multi_candidates FROM g",
        "x1_compare": f"WITH t AS (SELECT {_apply('text', longest(PHRASE | OTHER) + char)} AS a, {runs} AS b FROM documents) SELECT count(*) AS comparisons, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS mismatches FROM t",
        "x1_changes": f"SELECT count(*) AS comparisons, CAST(sum(CASE WHEN text <> {chain} THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM documents",
        "x4_verdict": "WITH d AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en'), l AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unexpected' WHEN d.doc_id IS NULL THEN 'stale' ELSE 'registered' END AS state FROM d FULL OUTER JOIN l USING (doc_id)",
        "m1_percentiles": "SELECT event_type, v[1] AS min, v[1 + CAST(floor((len(v) - 1) * 0.5) AS INT)] AS p50, v[1 + CAST(floor((len(v) - 1) * 0.9) AS INT)] AS p90 FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)",
        "k1_roundtrip": f"SELECT 'parts' AS lexicon, row_number() OVER (ORDER BY encode(key)) - 1 AS ord, key, key AS candidates FROM {names}",
    }
