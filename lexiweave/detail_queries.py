"""Registered queries of the profiles, the facade, the text primitives and the tools.

Tables are read whole; literal rows carry what the tables do not hold
(configurations, byte strings, containers).  Literal lexicons stand in for those
that callers of the profiles supply.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import driver_queries as base
from .api import PROFILES, NORMALIZATION, Options, create, create_from_config, create_result, from_stem
from .errors import LexiconError
from .functions import columns
from .operators import compare, derive, lookup
from .operators.convert import candidates, convert, inspect
from .plans import config
from .plans.model import SHORT_CIRCUIT, UNION, Converter, Group, Leaf, key_starts, match_length, same_matches
from .sources import container, corpus, lexicon, sinks
from .sources.lexicon import Lexicons, Resources

#: Literal lexicons of the profile queries, under the file names that the profiles use.
LEXICONS = {
    NORMALIZATION: {"é": "e", "ö": "oe", "ñ": "n"},
    "STPhrases": {"ti": "TI", "ent": "ENT", "la": "LA"},
    "STPhrases_GeneratedFromRegionalPhrases": {"tion": "TION", "ti": "no", "en": "EN"},
    "STCharacters": {"s": "S", "r": "R"},
    "TSPhrases": {"er": "ER", "che": "CHE"},
    "TSCharactersExt": {"t": "+", "o": "O"},
    "TSCharacters": {"t": "T", "a": "A"},
    "TWVariantsPhrases": {"TION": "tian", "ENT": "nte"},
    "TWVariants": {"S": "Z", "o": "0"},
    "TWPhrases": {"de ": "of_", "ENT": "ant"},
    "HKVariantsPhrases": {"EN": "ne", "LA": "al"},
    "HKVariants": {"R": "rr", "u": "v"},
    "HKPhrases": {"un": "1", "EN": "nn"},
    "TWVariantsRevPhrases": {"on": "no", "ter": "ret"},
    "TWVariantsRev": {"e": "a", "n": "m"},
    "TWPhrasesRev": {"in": "er", "on": "che"},
    "HKVariantsRevPhrases": {"st": "ts", "an": "at"},
    "HKVariantsRev": {"i": "t", "d": "a"},
    "HKPhrasesRev": {"le": "che", "st": "er"},
    "JPShinjitaiPhrases": {"re": "RE", "res": "ser"},
    "JPShinjitaiCharacters": {"e": "3", "l": "1"},
    "JPShinjitaiCharactersRev": {"o": "0", "m": "n"},
}


def _resources() -> Resources:
    return Resources({f"dictionary/{name}.txt": "".join(f"{k}\t{v}\n" for k, v in held.items()).encode() for name, held in LEXICONS.items()})


def _profile(name: str, options: Options = Options()):
    made = create(name, _resources(), options, "text")
    return lambda s, d: base._table(s, d, "documents").select("doc_id", made.column("text").alias("output"))


def _rows(s, schema: str, rows):
    return s.createDataFrame(rows, schema)


def _outcome(call) -> str:
    try:
        return str(call())
    except LexiconError as e:
        return type(e).__name__


_INLINE = '{"type": "inline", "entries": {"a": "b"}}'
_CHAIN = '{"conversion_chain": [{"dict": %s}]}'
#: Literal configurations: id, document, outcome.
CONFIGS = [
    ("good", _CHAIN % _INLINE, "ok"),
    ("comments", '// c\n{"conversion_chain": [/* "x" */ {"dict": ' + _INLINE + "},],}", "ok"),
    ("first member wins", '{"conversion_chain": [{"dict": ' + _INLINE + '}], "conversion_chain": 1}', "ok"),
    ("no chain", "{}", "InvalidConfig"),
    ("no object", "[]", "InvalidConfig"),
    ("no JSON", "{", "InvalidConfig"),
    ("repeated key", _CHAIN % '{"type": "inline", "entries": {"a": "b", "a": "c"}}', "InvalidConfig"),
    ("flagged inline", _CHAIN % '{"type": "inline", "may_output_tofu": true, "entries": {"a": "b"}}', "InvalidFormat"),
    ("policy", _CHAIN % '{"type": "group", "match_policy": "best", "dicts": []}', "InvalidConfig"),
    ("foreign", _CHAIN % '{"type": "ocd2", "file": "x.ocd2"}', "Unsupported"),
    ("no file", _CHAIN % '{"type": "text", "file": "none.txt"}', "FileNotFound"),
    ("bad file", _CHAIN % '{"type": "text", "file": "bad.txt"}', "InvalidFormat"),
    ("bad container", _CHAIN % '{"type": "sok", "file": "bad.txt"}', "InvalidFormat"),
    ("segmentation", '{"segmentation": {"type": "crf"}, "conversion_chain": []}', "Unsupported"),
]


def _outcomes(s, d):
    files = Resources({"bad.txt": b"no tab\n"})
    return _rows(s, "id string, outcome string", [(i, _outcome(lambda: create_from_config(text, files) and "ok")) for i, text, _ in CONFIGS])


def _results(s, d):
    held, empty = _resources(), Resources()
    out = []
    for name in PROFILES:
        for which, files in (("held", held), ("empty", empty)):
            got = create_result(name, files, kind="text")
            out.append((name, which, got.ok, None if got.ok else type(got.error).__name__))
    return _rows(s, "profile string, files string, ok boolean, error string", out)


#: Literal stems and the profile they name.
STEMS = [("s2t", "s2t"), ("S2TWP", "s2twp"), ("t2jp.json", "t2jp"), ("HK2SP.json", "hk2sp"), ("s2t.JSON", "InvalidConfig"), ("x2y", "InvalidConfig"), ("", "InvalidConfig")]


def _stems(s, d):
    return _rows(s, "stem string, profile string", [(stem, _outcome(lambda: from_stem(stem))) for stem, _ in STEMS])


def _opened(s, d):
    """Readers by type, absent files, one decoding for each file."""
    held = Lexicons(Resources({"a.txt": "x\ty z\n".encode(), "a.sok": container.encode([("x", ["y"])]), "b.txt": b"x\n"}))
    held.readers["upper"] = lambda b, n: lexicon.parse_text(b.decode().upper(), n)
    cases = [("text", "a.txt"), ("sok", "a.sok"), ("upper", "a.txt"), ("text", "b.txt"), ("text", "none.txt"), ("ocd", "a.txt"), ("ocd2", "a.txt"), ("xml", "a.txt"), ("sok", "b.txt")]
    out = [(k, f, _outcome(lambda: "|".join(f"{a}={'/'.join(v)}" for a, v in held.open(k, f).entries.items()))) for k, f in cases]
    out.append(("text", "same", str(held.open("text", "a.txt") is held.open("text", "a.txt"))))
    return _rows(s, "kind string, file string, outcome string", out)


REWRITE = ('// c\n{"name": "x", "conversion_chain": [{"dict": {"type": "ocd2", "file": "a/b.ocd2"}}, {"dict": {"type": "text", "file": "c.txt"}}],}', '{\n  "name": "x",\n  "conversion_chain": [\n    {\n      "dict": {\n        "type": "sok",\n        "file": "dictionary/b.sok"\n      }\n    },\n    {\n      "dict": {\n        "type": "text",\n        "file": "c.txt"\n      }\n    }\n  ]\n}\n')


def _rewritten(s, d):
    once = config.rewrite(REWRITE[0])
    return _rows(s, "step string, document string", [("once", once), ("twice", config.rewrite(once))])


def _scanned(s, d):
    texts = ['{"a": "//", /* x */ "b": 1}', '{"a": 1, "a": 2}', '{"\\u0061": 1, "a": 2}', '[1, 2,]']
    stripped = [("strip", t, config.strip_comments(t)) for t in texts]
    read = [("read", t, _outcome(lambda: ",".join(f"{k}={v}" for k, v in config.read(t).items()))) for t in texts]
    return _rows(s, "step string, text string, got string", stripped + read)


def _referenced(s, d):
    out = []
    for name in PROFILES:
        out += [(name, n, k, f) for n, (k, f) in enumerate(config.referenced(config.read(_config(name))))]
    return _rows(s, "profile string, n long, kind string, file string", out).groupBy("kind", "file").agg(F.count("*").alias("n"), F.countDistinct("profile").alias("profiles"))


def _config(name: str) -> str:
    from .api import profile_config

    return profile_config(name, kind="text")


def _plan_names(plan) -> list[str]:
    return [plan] if isinstance(plan, str) else [x for p in plan[1:] for x in _plan_names(p)]


def _recipes(s, d):
    have = {"TWVariants", "HKVariants", "STPhrases"}
    names = ["TSCharactersExt", "STPhrases_GeneratedFromRegionalPhrases", "TWVariantsRev", "JPShinjitaiCharactersRev", "STPhrases", "Unknown"]
    return _rows(s, "name string, recipe string", [(n, _outcome(lambda: ":".join([derive.recipe(n, have)[0], *derive.recipe(n, have)[1]]))) for n in names])


def _plans(s, d):
    """Lengths of matches, first code points and sameness of plans."""
    plans = {"leaf": base.LX_ALT, "sc": base.SC, "union": base.UN}
    out = [(f"length {p} {t}", match_length(plan, t)) for p, plan in plans.items() for t in ("tionally x", "tions", "x", "", "schön")]
    out += [(f"starts {p}", len(key_starts(plan))) for p, plan in plans.items()]
    out += [(f"longest {p}", plan.max_key_length) for p, plan in plans.items()]
    twin = Group([base.LX_ALT, base.LX_PHR], SHORT_CIRCUIT)
    turned = Group([base.LX_PHR, base.LX_ALT], SHORT_CIRCUIT)
    out += [("same twin", int(same_matches(base.SC, twin))), ("same turned", int(same_matches(base.SC, turned))), ("same policy", int(same_matches(base.SC, base.UN))), ("same copy", int(same_matches(base.LX_ALT, base._leaf(base.OTHER))))]
    return _rows(s, "what string, n long", out)


#: Literal bytes: id, bytes, well-formed, text decoded leniently.
BYTES = [("ascii", b"ab", True, "ab"), ("two", b"\xc3\xa9", True, "é"), ("four", "𠀀".encode(), True, "𠀀"), ("lone", b"a\xff", False, "a�"), ("cut", b"a\xf0\xa0", False, "a��"), ("long form", b"\xc0\xaf", False, "��"), ("surrogate", b"\xed\xa0\x80z", False, "���z"), ("none", b"", True, "")]


def _bytes(s, d):
    rows = _rows(s, "id string, data binary", [(i, bytearray(b)) for i, b, _, _ in BYTES])
    return rows.select("id", columns.is_well_formed("data").alias("valid"), columns.decode_lenient("data").alias("decoded"))


def _measures(s, d):
    docs = base._table(s, d, "documents").withColumn("point", columns.first_code_point(F.col("text")))
    return docs.select("doc_id", F.col("point").cast("long").alias("point"), columns.char_count("point").cast("long").alias("units"), columns.utf16_length(F.col("text")).alias("utf16"), F.length("text").cast("long").alias("points"), (F.col("text") < F.lit("é")).alias("below"))


def _escaped(s, d):
    return base._table(s, d, "documents").select("doc_id", columns.escape("text").alias("line"))


def _fnv(s, d):
    return base._table(s, d, "conversations").select("conv_id", "turn", columns.fnv1a64(F.col("text").cast("binary")).alias("fnv"), F.lower(F.hex(F.col("text").cast("binary"))).alias("hex"), (F.unhex(F.hex(F.col("text").cast("binary"))) == F.col("text").cast("binary")).alias("back"))


def _hex_files(s, d):
    texts = base._table(s, d, "benchmark").select("text").union(base._table(s, d, "part").select("p_name"))
    return corpus.hex_lines(texts.select(F.col("text").cast("binary").alias("bytes")))


def _hex_corpus(s, d):
    return corpus.hex_corpus(_hex_files(s, d)).select("id", F.col("bytes").cast("string").alias("text"), "valid")


def _conformance_files(s):
    return _rows(s, "id string, bytes binary", [(i, bytearray(b)) for i, b in base.conformance_inputs()])


def _expected_lines(s, d):
    return container.expectation_lines(_conformance_files(s)).select("line")


def _expectations(s, d):
    got = corpus.expectations(_expected_lines(s, d).withColumnRenamed("line", "value"))
    return got.select("id", "verdict", F.col("entry_count").cast("long").alias("entry_count"), F.col("max_key_length").cast("long").alias("max_key_length"), "digest", "audit", "rule")


def _sets(s, d):
    points = F.array(*map(F.lit, sorted({ord(k[0]) for k, _ in base.WORDS})))
    at = columns.first_code_point(F.col("word"))
    words = base._part_words(s, d).distinct()
    return words.select("word", lookup.contains(points, at).alias("member"), lookup.index_of(points, at).cast("long").alias("rank"), F.size(lookup.union_points(points, F.array(at))).cast("long").alias("united"), lookup.stops_skip(at, points).alias("stops"))


def _starts(s, d):
    return lookup.key_starts(base._names(s, d)).select("lexicon", F.array_join("starts", ",").alias("starts"))


def _candidates(s, d):
    plan = Group([Leaf(dict(base.MORE)), Leaf(dict(base.WORDS))], SHORT_CIRCUIT)
    return base._part_words(s, d).distinct().select("word", F.array_join(candidates("word", plan), "|").alias("candidates"))


def _regional_text(s, d):
    return sinks.lexicon_text(base._nation_lexicon(s, d), sinks.REGIONAL_HEADER)


def _dump(s, d):
    items = base._table(s, d, "benchmark").select(F.lit("items").alias("lexicon"), F.col("text").alias("key")).distinct()
    return sinks.dump_lines(items.withColumn("candidates", F.array("key", F.lit("a\tb\\"))))


def _bench(s, d):
    counts = base._table(s, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    return sinks.bench_lines(counts)


def _set_check(s, d):
    names = lambda t, c: base._table(s, d, t).select(F.col(c).cast("string").alias("name")).distinct()
    return derive.set_check(names("labels", "doc_id"), names("documents", "doc_id"), names("conversations", "conv_id"))


LEFT, RIGHT = Converter((base.LX_PHR,), None, (base.LX_CHAR,)), Converter((base.LX_ALT,), None, (base.LX_ONE,))


def _differences(s, d):
    docs = base._table(s, d, "documents").select("doc_id", inspect("text", LEFT).alias("a"), inspect("text", RIGHT).alias("b"))
    return docs.select("doc_id", compare.first_difference(F.col("a"), F.col("b")).alias("first"))


def _outcome_pairs(s, d):
    side = lambda flag, other: F.struct((F.col(flag) == 1).alias("accepted"), F.col(other).cast("string").alias("outputs"), F.col(other).cast("string").alias("phase"), F.lit("c").alias("category"))
    return base._table(s, d, "labels").select("doc_id", compare.same_outcome(side("quality", "toxic"), side("toxic", "quality")).alias("same"))


def _golden_failures(s, d):
    docs = base._table(s, d, "documents")
    results = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("stem"), F.col("text").alias("expected"), convert("text", base.LX_CHAR).alias("output"))
    registered = base._table(s, d, "labels").select(F.col("doc_id").alias("id"), F.lit("en").alias("stem"))
    return compare.golden_failures(results, registered)


def _samples(s, d):
    samples = _rows(s, "id string", [(i,) for i in ("short", "medium", "long", "phrases", "twp", "hk")])
    return compare.samples_for(samples, _rows(s, "profile string", [(p,) for p in PROFILES])).select("profile", "id")


FUZZ = '"a"\n\n"\\u00e9\\n"\n"\\\\"\n'


def _fuzz(s, d):
    rows = [(n, t) for n, t in enumerate(corpus.parse_fuzz(FUZZ))]
    return _rows(s, "n long, input string", rows + [(9, _outcome(lambda: corpus.parse_fuzz("1\n")))])


def queries():
    """Name -> (spark, sf_dir) -> DataFrame."""
    out = {f"f{n}_{name}": _profile(name) for n, name in enumerate(PROFILES, 1)}
    return out | {
        "a1_a5_outcomes": _outcomes,
        "a2_results": _results,
        "a3_stems": _stems,
        "a4_tofu_t2s": _profile("t2s", Options(True)),
        "s6_s9_open": _opened,
        "s10_s11_scan": _scanned,
        "s13_fuzz": _fuzz,
        "s14_hex_corpus": _hex_corpus,
        "s15_expectations": _expectations,
        "s18_tokens": lambda s, d: corpus.token_lines(base._table(s, d, "documents").select(F.col("text").alias("input"))),
        "k3_regional_text": _regional_text,
        "k4_rewrite": _rewritten,
        "k6_dump": _dump,
        "k7_hex_lines": _hex_files,
        "k8_expectation_lines": _expected_lines,
        "k9_bench_lines": _bench,
        "p4_p12_p13_plans": _plans,
        "p6_key_starts": _starts,
        "p14_p15_sets": _sets,
        "c14_candidates": _candidates,
        "t1_t2_t5_t8_t9_measures": _measures,
        "t6_t7_bytes": _bytes,
        "t10_t11_fnv_hex": _fnv,
        "t12_escape": _escaped,
        "g4_recipe": _recipes,
        "g6_set_check": _set_check,
        "g8_referenced": _referenced,
        "x2_first_difference": _differences,
        "x3_same_outcome": _outcome_pairs,
        "x5_golden_failures": _golden_failures,
        "m4_samples": _samples,
    }


def _pairs(plan, include: bool) -> list[tuple[str, str]]:
    """Keys and values of a profile's plan in the order in which they are tried."""
    longest = lambda e: sorted(e.items(), key=lambda x: (-len(x[0]), x[0]))
    if isinstance(plan, str):
        return [] if plan.startswith("*") and not include else longest(LEXICONS[plan.removeprefix("*")])
    merged: dict[str, str] = {}
    for child in plan[1:]:
        for k, v in _pairs(child, include):
            merged.setdefault(k, v)
    return longest(merged) if plan[0] == UNION else list(merged.items())


def _profile_sql(name: str, include: bool = False) -> str:
    segmentation, chain = PROFILES[name]
    text = base._apply("text", _pairs(NORMALIZATION, include))

    def converted(e: str) -> str:
        for plan in chain:
            e = base._apply(e, _pairs(plan, include))
        return e

    if not segmentation:
        return f"SELECT doc_id, {converted(text)} AS output FROM documents"
    keys = [k for k, _ in _pairs(segmentation, True)]
    cut = f"regexp_extract_all(t, {base._q(base._pattern(keys))})"
    return f"""WITH src AS (SELECT doc_id, {text} AS t FROM documents),
        tok AS (SELECT doc_id, unnest({cut}) AS tok, generate_subscripts({cut}, 1) AS i FROM src),
        flag AS (SELECT *, tok IN ({', '.join(map(base._q, keys))}) AS hit FROM tok),
        brk AS (SELECT *, CASE WHEN hit OR coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY i), true) THEN 1 ELSE 0 END AS b FROM flag),
        grp AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM brk),
        seg AS (SELECT doc_id, g, string_agg(tok, '' ORDER BY i) AS seg FROM grp GROUP BY doc_id, g),
        done AS (SELECT doc_id, string_agg({converted('seg')}, '' ORDER BY g) AS output FROM seg GROUP BY doc_id)
        SELECT src.doc_id, CASE WHEN t IS NOT NULL THEN coalesce(output, '') END AS output FROM src LEFT JOIN done ON done.doc_id = src.doc_id"""


def _fnv_sql(hex_text: str) -> str:
    """FNV-1a 64 of hexadecimal digits, by its definition."""
    steps = f"list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all({hex_text}, '..'), lambda p: ('0x' || p)::INTEGER::HUGEINT))"
    return f"lpad(lower(hex(list_reduce({steps}, lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')"


def _value(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    return "NULL" if v is None else f"CAST({v} AS BIGINT)" if isinstance(v, int) else base._q(v)


def _values(names: str, rows) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + f") t({names})"


#: What the digest of the good container covers, by the format's description: counts, then each
#: key and candidate behind its length, little-endian.
GOOD_DIGEST = "03000000" "02000000" "01000000" "61" "01" "0100" "41" "02000000" "6162" "02" "0200" "4142" "0100" "62" "03000000" "e4b8ad" "01" "0100" "43"


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL with the same rows."""
    rules = [f"V{n}" for n in range(1, 13)]
    verdicts = f"""SELECT 'good' AS id, 'accept' AS verdict, CAST(3 AS INTEGER) AS entry_count, CAST(2 AS INTEGER) AS max_key_length, {_fnv_sql(base._q(GOOD_DIGEST))} AS digest, 'audit-ok' AS audit, CAST(NULL AS VARCHAR) AS rule
        UNION ALL SELECT 'empty', 'accept', 0, 0, {_fnv_sql(base._q('00' * 8))}, 'audit-ok', NULL
        UNION ALL SELECT rule, 'reject', NULL, NULL, NULL, NULL, rule FROM (VALUES {', '.join(f"('{r}')" for r in rules)}) t(rule)"""
    wide = verdicts.replace("INTEGER) AS entry", "BIGINT) AS entry").replace("INTEGER) AS max", "BIGINT) AS max")
    escaped = lambda e: f"replace(replace(replace(replace({e}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"
    hexed = "SELECT DISTINCT lower(hex(encode(text))) AS h FROM (SELECT text FROM benchmark UNION ALL SELECT p_name FROM part) WHERE strlen(text) <= 512"
    starts = sorted({ord(k[0]) for k, _ in base.WORDS})
    words = "(SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"
    point = "CASE WHEN word = '' THEN 0 ELSE unicode(word) END"
    cands: dict[str, str] = {}
    for k, v in base.MORE + base.WORDS:
        cands.setdefault(k, "|".join(v))
    files: dict[str, list[str]] = {}
    for name, (segmentation, chain) in PROFILES.items():
        for plan in [NORMALIZATION, *([segmentation] if segmentation else []), *chain]:
            for leaf in _plan_names(plan):
                files.setdefault(f"dictionary/{leaf.removeprefix('*')}.txt", []).append(name)
    phr, alt, one, char = (sorted(e.items(), key=lambda x: (-len(x[0]), x[0])) for e in (base.PHRASE, base.OTHER, base.SINGLE, base.CHAR))
    left, right = base._apply("text", char), base._apply("text", one)
    lengths = {"leaf": (8, 2, -1, -1, -1), "sc": (8, 2, -1, -1, 3), "union": (8, 5, -1, -1, 3)}
    plans = [(f"length {p} {t}", n) for p, ns in lengths.items() for t, n in zip(("tionally x", "tions", "x", "", "schön"), ns)]
    plans += [("starts leaf", 2), ("starts sc", 5), ("starts union", 5), ("longest leaf", 8), ("longest sc", 8), ("longest union", 8), ("same twin", 1), ("same turned", 0), ("same policy", 0), ("same copy", 0)]
    scans = ['{"a": "//", /* x */ "b": 1}', '{"a": 1, "a": 2}', '{"\\u0061": 1, "a": 2}', "[1, 2,]"]
    scanned = [("strip", scans[0], '{"a": "//",         "b": 1}'), *(("strip", t, t) for t in scans[1:]), ("read", scans[0], "a=//,b=1"), ("read", scans[1], "a=1"), ("read", scans[2], "a=1"), ("read", scans[3], "InvalidConfig")]
    opened = [("text", "a.txt", "x=y/z"), ("sok", "a.sok", "x=y"), ("upper", "a.txt", "X=Y/Z"), ("text", "b.txt", "InvalidFormat"), ("text", "none.txt", "FileNotFound"), ("ocd", "a.txt", "Unsupported"), ("ocd2", "a.txt", "Unsupported"), ("xml", "a.txt", "Unsupported"), ("sok", "b.txt", "InvalidFormat"), ("text", "same", "True")]
    recipes = [("TSCharactersExt", "tofu:TSCharacters"), ("STPhrases_GeneratedFromRegionalPhrases", "regional:HKPhrases:TWPhrases"), ("TWVariantsRev", "reverse:TWVariants"), ("JPShinjitaiCharactersRev", "reverse:JPShinjitaiCharacters"), ("STPhrases", "direct:STPhrases"), ("Unknown", "InvalidConfig")]
    samples = [(p, i) for p in PROFILES for i in ("medium", "long")] + [("s2t", "short"), ("s2t", "phrases"), ("s2twp", "twp"), ("s2hk", "hk")]
    results = [(p, "held", True, None) for p in PROFILES] + [(p, "empty", False, "FileNotFound") for p in PROFILES]
    name_set = lambda t, c: f"SELECT DISTINCT CAST({c} AS VARCHAR) AS name FROM {t}"
    wanted, found, known = name_set("labels", "doc_id"), name_set("documents", "doc_id"), name_set("conversations", "conv_id")
    differing = f"SELECT doc_id AS id, lang AS stem FROM documents WHERE text IS DISTINCT FROM {left}"
    return {f"f{n}_{name}": _profile_sql(name) for n, name in enumerate(PROFILES, 1)} | {
        "v_conformance": verdicts,
        "a1_a5_outcomes": _values("id, outcome", [(i, o) for i, _, o in CONFIGS]),
        "a2_results": _values("profile, files, ok, error", results),
        "a3_stems": _values("stem, profile", STEMS),
        "a4_tofu_t2s": _profile_sql("t2s", True),
        "s6_s9_open": _values("kind, file, outcome", opened),
        "s10_s11_scan": _values("step, text, got", scanned),
        "s13_fuzz": _values("n, input", [(0, "a"), (1, "é\n"), (2, "\\"), (9, "InvalidFormat")]),
        "s14_hex_corpus": f"SELECT {_fnv_sql('h')} AS id, decode(unhex(h)) AS text, true AS valid FROM ({hexed})",
        "s15_expectations": wide,
        "s18_tokens": "SELECT DISTINCT '\"' || regexp_replace(hex(encode(c)), '(..)', '\\x\\1', 'g') || '\"' AS value FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''".replace("'\\x\\1'", "'\\\\x\\1'"),
        "k3_regional_text": f"SELECT 'nations' AS lexicon, {base._q(sinks.REGIONAL_HEADER)} || chr(10) || string_agg(n_name || chr(9) || r_name, chr(10) ORDER BY encode(n_name)) || chr(10) AS text FROM nation JOIN region ON n_regionkey = r_regionkey",
        "k4_rewrite": _values("step, document", [("once", REWRITE[1]), ("twice", REWRITE[1])]),
        "k6_dump": f"SELECT {escaped('text')} || chr(9) || {escaped('text')} || chr(9) || 'a\\tb\\\\' AS value FROM (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL)",
        "k7_hex_lines": f"SELECT {_fnv_sql('h')} || chr(9) || h AS value FROM ({hexed})",
        "k8_expectation_lines": f"SELECT CASE WHEN verdict = 'accept' THEN concat_ws(chr(9), id, verdict, entry_count, max_key_length, digest, audit) ELSE concat_ws(chr(9), id, verdict, rule) END AS line FROM ({verdicts})",
        "k9_bench_lines": "SELECT '[bench] region=' || n_regionkey || ' n=' || count(*) AS value FROM nation GROUP BY n_regionkey",
        "p4_p12_p13_plans": _values("what, n", plans),
        "p6_key_starts": "SELECT 'parts' AS lexicon, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS starts FROM (SELECT DISTINCT unicode(p_name) AS p FROM part WHERE p_name <> '')",
        "p14_p15_sets": f"SELECT word, list_contains({starts}, p) AS member, CAST(coalesce(list_position({starts}, p), 0) - 1 AS BIGINT) AS rank, CAST(len(list_distinct(list_append({starts}, p))) AS BIGINT) AS united, list_contains({starts}, p) OR p BETWEEN 12272 AND 12287 AS stops FROM (SELECT word, {point} AS p FROM {words})",
        "c14_candidates": f"SELECT word, MAP {{{', '.join(f'{base._q(k)}: {base._q(v)}' for k, v in cands.items())}}}[word] AS candidates FROM {words}",
        "t1_t2_t5_t8_t9_measures": "SELECT doc_id, CAST(p AS BIGINT) AS point, CAST(CASE WHEN p > 65535 THEN 2 ELSE 1 END AS BIGINT) AS units, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS utf16, CAST(length(text) AS BIGINT) AS points, encode(text) < encode('é') AS below FROM (SELECT *, CASE WHEN text = '' THEN 0 ELSE unicode(text) END AS p FROM documents)",
        "t6_t7_bytes": _values("id, valid, decoded", [(i, v, t) for i, _, v, t in BYTES]),
        "t10_t11_fnv_hex": f"SELECT conv_id, turn, {_fnv_sql('hex')} AS fnv, hex, text IS NOT NULL AS back FROM (SELECT *, lower(hex(encode(text))) AS hex FROM conversations)",
        "t12_escape": f"SELECT doc_id, {escaped('text')} AS line FROM documents",
        "g4_recipe": _values("name, recipe", recipes),
        "g6_set_check": f"WITH w AS ({wanted}), f AS ({found}), r AS ({known}) SELECT name, 'missing' AS state FROM (FROM w EXCEPT FROM f) UNION ALL SELECT name, 'unregistered' FROM (FROM f EXCEPT (FROM w UNION FROM r)) UNION ALL SELECT name, 'stale' FROM (FROM r EXCEPT FROM f)",
        "g8_referenced": _values("kind, file, n, profiles", [("text", f, len(p), len(set(p))) for f, p in files.items()]),
        "x2_first_difference": f"SELECT doc_id, CASE WHEN {left} <> {right} THEN 'normalization_stages' WHEN {base._apply(left, phr)} <> {base._apply(right, alt)} THEN 'stages' END AS first FROM documents",
        "x3_same_outcome": "SELECT doc_id, (quality = 1) = (toxic = 1) AND toxic = quality AS same FROM labels",
        "x5_golden_failures": f"WITH d AS ({differing}), r AS (SELECT DISTINCT doc_id AS id, 'en' AS stem FROM labels) SELECT id, stem, 'unexpected' AS state FROM (FROM d EXCEPT FROM r) UNION ALL SELECT id, stem, 'stale' FROM (FROM r EXCEPT FROM d)",
        "m4_samples": _values("profile, id", samples),
    }
