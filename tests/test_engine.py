"""Scanner, plans, tiers and configuration against literal cases and brute force."""

import json
import random

import pytest

from lexiweave import api, errors
from lexiweave.functions import text as T
from lexiweave.operators.convert import candidates, convert, flattened, inspect, segment, tier
from lexiweave.plans import config
from lexiweave.plans.kernel import Program, Scanner
from lexiweave.plans.model import SHORT_CIRCUIT, UNION, Converter, Group, Leaf, key_starts, match_length, same_matches
from lexiweave.sources.lexicon import Lexicons, Resources


def leaf(**kw):
    return Leaf({k: v if isinstance(v, list) else [v] for k, v in kw.items()})


def run(plan, text):
    return Scanner(plan).convert(text)


@pytest.mark.parametrize(
    "plan, text, expected",
    [
        (leaf(发="發"), "发动", "發动"),
        (Group([leaf(发火="X"), leaf(发="發")], SHORT_CIRCUIT), "发火型", "X型"),
        (leaf(干=["幹", "干", "乾"]), "干", "幹"),
        (leaf(猫="cat"), "⿰ab猫", "⿰abcat"),
        (leaf(证="證"), "a⿾证", "a⿾证"),
        (leaf(只="隻"), "x⿰钅只", "x⿰钅只"),
        (Leaf({"⿰a": ["X"]}), "⿰ab", "Xb"),
        (leaf(a="A"), "𐈀a𐈀", "𐈀A𐈀"),
        (Group([leaf(ab="X"), leaf(abc="Y")], SHORT_CIRCUIT), "abc", "Xc"),
        (Group([leaf(ab="X"), leaf(abc="Y")], UNION), "abcd", "Yd"),
        (Leaf({"干": [""]}), "干燥", "燥"),
        (leaf(a="A"), "", ""),
    ],
)
def test_conversion(plan, text, expected):
    assert run(plan, text) == expected


@pytest.mark.parametrize(
    "keys, text, segments",
    [
        (["燕燕于飞"], "燕燕于飞", ["燕燕于飞"]),
        (["燕子"], "一只燕子飞", ["一只", "燕子", "飞"]),
        (["燕"], "hello 燕 world", ["hello ", "燕", " world"]),
        (["燕", "燕燕", "燕燕于飞"], "燕燕于飞来", ["燕燕于飞", "来"]),
        (["燕"], "", []),
        (["燕"], "什么都没匹配", ["什么都没匹配"]),
        (["燕"], "⿰ab燕", ["⿰ab", "燕"]),
        (["证"], "a⿾证", ["a⿾证"]),
        (["只"], "x⿰钅只", ["x⿰钅只"]),
    ],
)
def test_segmentation(keys, text, segments):
    assert Scanner(Leaf({k: [k] for k in keys})).segment(text) == segments


@pytest.mark.parametrize("text, n", [("⿰ab", 3), ("⿱⿰abc", 5), ("⿾a", 2), ("⿲abc", 4), ("ab", 0), ("中", 0), ("⿰a", 0), ("⿰", 0), ("⿰⿱ab", 0), ("⿰" * 17 + "a" * 18, 0), ("⿾" * 15 + "a", 16), ("⿾" * 16 + "a", 0), ("⿰" * 15 + "a" * 16, 31), ("⿰" * 16 + "a" * 17, 0)])
def test_ids(text, n):
    assert T.ids_length(text) == n


def test_chains_and_segments():
    assert Program(Converter((leaf(干="幹"), leaf(幹="乾")))).convert("干") == "乾"
    assert Program(Converter((leaf(发="發"), leaf(發型="HAIRSTYLE")))).convert("发型") == "HAIRSTYLE"
    p = Program(Converter((leaf(a="xy", c="z"), Leaf({"yz": ["!"], "x": ["X"]})), Leaf({"a": ["a"]})))
    assert p.convert("ac") == "Xyz"
    assert Program(Converter(())).convert("as is") == "as is"
    p = Program(Converter((Leaf({"干": ["乾"], "⿰": ["[op]"]}),), leaf(干="乾")))
    assert p.convert("⿰干发") == "[op]乾发"


def test_inspection():
    got = Program(Converter((leaf(A="X"),), leaf(A="A"), (leaf(a="A"),))).inspect("a")
    assert got == {"input": "a", "normalization_stages": [{"index": 1, "segments": ["A"]}], "segments": ["A"], "stages": [{"index": 1, "segments": ["X"]}], "output": "X"}
    assert Program(Converter((leaf(a="b"),))).inspect("")["segments"] == [""]
    assert Program(Converter((leaf(a="b"),), leaf(a="a"))).inspect("")["segments"] == []
    got = Program(Converter((leaf(燕燕于飞="飛", 燕="燕"),), leaf(燕燕于飞="x"))).inspect("燕燕于飞")
    assert got["segments"] == ["燕燕于飞"] and got["output"] == "飛"


ALPHABET = "abc⿰⿾𐈀\n"


def random_leaf(rng):
    return Leaf({"".join(rng.choice(ALPHABET[:6]) for _ in range(rng.randint(1, 3))): [rng.choice(["", "X", "yy", "a"])] for _ in range(rng.randint(1, 5))})


def random_plan(rng, depth=2):
    if depth == 0 or rng.random() < 0.4:
        return random_leaf(rng)
    return Group([random_plan(rng, depth - 1) for _ in range(rng.randint(1, 3))], rng.choice([SHORT_CIRCUIT, UNION]))


def slow_match(plan, text, at):
    if isinstance(plan, Leaf):
        hits = [k for k in plan.entries if text.startswith(k, at)]
        return max(((len(k), plan.entries[k][0]) for k in hits), default=None, key=lambda h: h[0])
    hits = [h for c in plan.children if (h := slow_match(c, text, at))]
    return None if not hits else hits[0] if plan.policy == SHORT_CIRCUIT else max(hits, key=lambda h: h[0])


def slow_convert(plan, text):
    out, at = "", 0
    while at < len(text):
        hit = slow_match(plan, text, at)
        size = hit[0] if hit else T.ids_length(text, at) or 1
        out += hit[1] if hit else text[at : at + size]
        at += size
    return out


def test_scanner_equals_a_slow_one():
    rng = random.Random(11)
    for _ in range(600):
        plan = random_plan(rng)
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 24)))
        assert run(plan, text) == slow_convert(plan, text)
        segments = Scanner(plan).segment(text)
        assert "".join(segments) == text
        chain = (plan, random_plan(rng))
        p = Program(Converter(chain, random_plan(rng), (random_leaf(rng),)))
        assert p.convert(text) == p.inspect(text)["output"] == p.convert(text)


def test_tiers_agree(spark):
    rng = random.Random(5)
    plans = [leaf(a="x", b="", c="é"), leaf(ab="X", a="-", b="+"), Group([leaf(ab="X"), leaf(abc="Y", c="Z")], SHORT_CIRCUIT), Group([leaf(ab="X"), leaf(abc="Y", c="Z")], UNION), Leaf({".": ["dot"], "a*": ["star"], "\\": ["/"], "]": ["["], "^-": ["~"]})]
    data = [(n, "".join(rng.choice("abc.*\\]^-é \n" + "⿰" * (n % 2)) for _ in range(20))) for n in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(data, "n long, t string")
    assert [tier(p) for p in plans] == ["translate", "regex", "regex", "regex", "regex"]
    assert flattened(Group([Group([leaf(a="1")], SHORT_CIRCUIT), leaf(ab="2")], UNION)) is None
    for plan in plans:
        for r in df.select("t", convert("t", plan).alias("best"), convert("t", plan, "udf").alias("udf"), segment("t", plan).alias("s"), inspect("t", plan).alias("i")).collect():
            want = None if r.t is None else run(plan, r.t)
            assert r.best == r.udf == want
            if r.t is None:
                assert r.s is None and r.i is None
            else:
                assert "".join(r.s) == r.t and r.i.output == want
    got = {r.t: r.c for r in spark.createDataFrame([("a",), ("z",)], "t string").select("t", candidates("t", leaf(a=["1", "2"])).alias("c")).collect()}
    assert got == {"a": ["1", "2"], "z": None}


def test_plan_properties():
    g = Group([leaf(ab="X"), Leaf({"𐈀c": ["Y"]})], UNION)
    assert g.max_key_length == 3 and key_starts(g) == T.CodePointSet([0x61, 0x10200])
    assert match_length(g, "𐈀cd") == 3 and match_length(g, "zz") == -1
    assert Group([leaf(a=["1", "2"]), leaf(a="3")], UNION).exact("a") == ("1", "2")
    a = leaf(a="1")
    assert same_matches(Group([a], UNION), Group([a], UNION)) and not same_matches(a, leaf(a="1"))
    s = T.CodePointSet([5, 1, 5])
    assert s.points == (1, 5) and s.index_of(5) == 1 and s.index_of(2) == -1 and 1 in s and s.union(T.CodePointSet([2])).points == (1, 2, 5)
    with pytest.raises(errors.InvalidFormat):
        Leaf({"": ["x"]})
    with pytest.raises(errors.InvalidFormat):
        Leaf.of([("a", "1"), ("a", "2")])


def make(doc, tofu=False, files=None):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return api.create_from_config(text, Resources({k: v.encode() for k, v in (files or {}).items()}), api.Options(tofu))


def inline(**entries):
    return {"type": "inline", "entries": entries}


def test_config_semantics():
    base = {"conversion_chain": [{"dict": inline(发="發", 动="動", 干="幹")}]}
    assert make(base).convert("发动干部") == "發動幹部"
    flagged = {"type": "text", "file": "t.txt", "may_output_tofu": True}
    chain = {"conversion_chain": [{"dict": {"type": "group", "match_policy": "short_circuit", "dicts": [flagged, inline(干="幹")]}}]}
    assert make(chain).convert("干") == "幹"
    assert make(chain, True, {"t.txt": "干\t乾\n"}).convert("干") == "乾"
    assert make('{"conversion_chain": [] // note\n, /* x */ "name": "a//b"}').convert("a") == "a"
    assert make('{"conversion_chain": [{"dict": {"type": "inline", "entries": {"a": "1"}}}], "conversion_chain": []}').convert("a") == "1"
    dropped = make({"normalization": [{"dict": flagged}], "conversion_chain": [{"dict": inline(a="b")}]})
    assert dropped.inspect("a")["normalization_stages"] == [] and dropped.convert("a") == "b"
    seg = {"segmentation": {"type": "mmseg", "dict": flagged}, "conversion_chain": []}
    assert make(seg, False, {"t.txt": "干燥\tx\n"}).inspect("很干燥")["segments"] == ["很", "干燥"]
    for bad, error in [
        ({"conversion_chain": [{"dict": {"type": "group", "match_policy": "best", "dicts": []}}]}, errors.InvalidConfig),
        ({"conversion_chain": [{"dict": {"type": "zip", "file": "x"}}]}, errors.InvalidConfig),
        ({"conversion_chain": [{"dict": {"type": "ocd2", "file": "x"}}]}, errors.Unsupported),
        ({"conversion_chain": [{"dict": {"type": "text", "file": "absent"}}]}, errors.FileNotFound),
        ({"conversion_chain": [{"dict": inline(a="")}]}, errors.InvalidConfig),
        ({"conversion_chain": [{"dict": {**inline(a="b"), "may_output_tofu": False}}]}, errors.InvalidFormat),
        ({"segmentation": {"type": "jieba"}, "conversion_chain": []}, errors.Unsupported),
        ('{"conversion_chain": [{"dict": {"type": "inline", "entries": {"a": "1", "a": "2"}}}]}', errors.InvalidConfig),
        ("{", errors.InvalidConfig),
        ({"conversion_chain": {}}, errors.InvalidConfig),
    ]:
        with pytest.raises(error):
            make(bad)
    ignored = {"type": "group", "match_policy": "best", "may_output_tofu": True, "dicts": []}
    assert make({"name": 3, "conversion_chain": ["x", {"dict": ignored}]}).convert("a") == "a"


def test_rewrite_is_strict_and_idempotent():
    text = '{"conversion_chain": [{"dict": {"type": "ocd2", "file": "data/A.b.ocd2"}}]} // end'
    once = config.rewrite(text)
    assert config.rewrite(once) == once
    assert config.read('{"a": [1, 2, ], /* x */ "b": ",]", }') == {"a": [1, 2], "b": ",]"}
    assert config.referenced(config.read(once)) == [("sok", "dictionary/A.b.sok")]


def test_profiles():
    assert len(api.PROFILES) == 16 and api.from_stem("S2TWP.json") == "s2twp"
    with pytest.raises(errors.InvalidConfig):
        api.from_stem("s2t.JSON")
    names = {f for p in api.PROFILES for _, f in config.referenced(config.read(api.profile_config(p)))}
    assert len(names) == 22
    files = {f.replace(".sok", ".txt"): b"" for f in names}
    files["dictionary/STCharacters.txt"] = "发\t發\n".encode()
    files["dictionary/STPhrases.txt"] = "头发\t頭髮\n".encode()
    lexicons = Lexicons(Resources(files))
    assert api.create("s2t", lexicons, kind="text").convert("发头发") == "發頭髮"
    assert api.create("s2tw", lexicons, kind="text").inspect("发头发")["segments"] == ["发", "头发"]
    got = api.create_result("t2s", Resources())
    assert not got.ok and isinstance(got.error, errors.FileNotFound)


def test_sql_function(spark):
    api.Conversion(Converter((leaf(a="A"),))).register(spark, "upper_a")
    assert spark.sql("SELECT upper_a('banana') AS x").first().x == "bAnAnA"


def test_text_primitives():
    assert T.utf16_length("𠀀a") == 3 and T.char_count(0x20000) == 2 and [T.ids_arity(p) for p in (0x2FF0, 0x2FF2, 0x2FFE, 0x2FFD, 0x61)] == [2, 3, 1, 2, 0]
    assert T.decode_lenient(b"a\xf0\xa0") == "a��" and T.decode_lenient("é中𠀀".encode()) == "é中𠀀"
    assert T.hex64(T.fnv1a64(b"")) == "cbf29ce484222325" and T.hex64(T.fnv1a64(b"a")) == "af63dc4c8601ec8c"
    assert T.escape("a\tb\\\x01") == "a\\tb\\\\\\u{1}" and T.is_well_formed("中".encode()) and not T.is_well_formed(b"\xff")
