"""Lexicon sources, the container format, corpora, derivation and comparison."""

import pytest
from pyspark.sql import functions as F

from lexiweave.errors import InvalidFormat
from lexiweave import driver_queries, errors
from lexiweave.operators import compare, derive, lookup
from lexiweave.plans.model import Leaf
from lexiweave.sources import container, corpus, lexicon, sinks


def test_text_lexicon_rules():
    got = lexicon.parse_text("﻿# c\n干\t乾  幹\r\n\n发\t髮 \nx\t\n\tempty\n")
    assert got.entries == {"x": ("",), "发": ("髮", ""), "干": ("乾", "", "幹")}
    for bad in ("a\t1\na\t2\n", "no tab\n", "\t1\n\t2\n"):
        with pytest.raises(errors.InvalidFormat):
            lexicon.parse_text(bad)
    assert lexicon.parse_text("").entries == {}


def test_source_lexicon_rules():
    entries, prefer = lexicon.parse_source("# @reverse-prefer: 么 幺\n# @reverse-prefer: 后\na\t1  2\nb\t3\n")
    assert entries == [("a", ["1", "2"]), ("b", ["3"])] and prefer == {"么": "幺", "后": "后"}
    for bad in ("a\t \n", "\t1\n", "a 1\n"):
        with pytest.raises(errors.InvalidFormat):
            lexicon.parse_source(bad)


def test_read_text(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes("a\t1 2\r\nb\t\na\t3\nbad\n".encode())
    got = lexicon.read_text(spark, f"{tmp_path}/one.txt")
    assert [(r.lexicon, r.ord, r.key, r.candidates) for r in got.orderBy("ord").collect()] == [("one", 1, "a", ["1", "2"]), ("one", 2, "b", [""]), ("one", 3, "a", ["3"]), ("one", 4, None, None)]
    assert sorted((r.ord, r.reason) for r in lexicon.rejected(got).collect()) == [(1, "duplicate key"), (3, "duplicate key"), (4, "no tab")]


@pytest.mark.parametrize(
    "entries, digest",
    [
        ([], "a8c7f832281a39c5"),
        ([("a", ["A"]), ("ab", ["AB"]), ("abc", ["ABC"])], "d48af38172a39280"),
        ([("z", ["Z"]), ("é", ["É", "e"]), ("中", ["中", "衆"]), ("中文", ["中文"]), ("�", ["?"]), ("𠀀", ["x", "y", "z"]), ("𠀀中", ["�"])], "257f553a9f91686e"),
        ([("k", [chr(ord("a") + i % 26) for i in range(255)])], "485b319d0ddcff85"),
    ],
)
def test_container_round_trip(entries, digest):
    data = container.encode(reversed(entries))
    got = container.decode(data)
    assert [(k.decode(), [v.decode() for v in vs]) for k, vs in got.entries] == entries
    assert got.digest() == digest and got.audit() == "audit-ok"


def test_container_rules(spark):
    got = {r.id: r for r in driver_queries.queries()["v_conformance"](spark, "").collect()}
    for name, r in got.items():
        assert (r.verdict, r.rule) == (("accept", None) if name in ("good", "empty") else ("reject", name))
    lines = {r.id: r.line for r in container.expectation_lines(spark.createDataFrame([(i, bytearray(b)) for i, b in driver_queries.conformance_inputs()], "id string, bytes binary")).collect()}
    assert lines["V4"] == "V4\treject\tV4" and lines["empty"] == "empty\taccept\t0\t0\ta8c7f832281a39c5\taudit-ok"
    parsed = corpus.expectations(spark.createDataFrame([(v,) for v in lines.values()], "value string")).where("id = 'V7'").first()
    assert parsed.verdict == "reject" and parsed.rule == "V7"


@pytest.mark.parametrize("entries", [[("", ["x"])], [("a", [])], [("a", [""])], [("a", ["x"] * 256)], [("a", ["x" * 65536])], [("a", ["1"]), ("a", ["2"])], [("\ud800", ["x"])]])
def test_encoder_rejects(entries):
    with pytest.raises(errors.InvalidFormat):
        container.encode(entries)


def test_container_files(spark, tmp_path):
    (tmp_path / "b.sok").write_bytes(container.encode([("a", ["A", "B"])]))
    (tmp_path / "a.sok").write_bytes(b"short")
    files = container.read(spark, str(tmp_path))
    assert [r.verdict for r in container.verdicts(files).orderBy("id").collect()] == ["reject", "accept"]
    assert [tuple(r) for r in container.entries(files).collect()] == [("b.sok", 0, "a", ["A", "B"])]
    res = lexicon.Resources(spark=spark, root=str(tmp_path))
    opened = lexicon.Lexicons(res)
    assert opened.open("sok", "b.sok") is opened.open("sok", "b.sok")
    with pytest.raises(errors.FileNotFound):
        opened.open("sok", "none.sok")
    with pytest.raises(errors.InvalidFormat, match="a.sok: V1"):
        opened.open("sok", "a.sok")


def lex(spark, rows, name="l"):
    return spark.createDataFrame([(name, n, k, v) for n, (k, v) in enumerate(rows)], "lexicon string, ord int, key string, candidates array<string>")


def pairs(df):
    return {r.key: r.candidates for r in df.collect()}


def test_reverse(spark):
    assert pairs(derive.reverse(lex(spark, [("a", ["X", "Y"]), ("b", ["Y"])]))) == {"X": ["a"], "Y": ["a", "b"]}
    prefer = spark.createDataFrame([("么", "幺")], "key string, preferred string")
    assert pairs(derive.reverse(lex(spark, [("麼", ["么"]), ("幺", ["么"])]), prefer)) == {"么": ["幺", "麼"]}
    with pytest.raises(Exception, match="no candidate"):
        pairs(derive.reverse(lex(spark, [("麼", ["么"])]), prefer))


def test_tofu_and_regional(spark):
    rows = lambda lines: spark.createDataFrame([("f", n, t) for n, t in enumerate(lines)], "file string, line_no int, line string")
    assert pairs(derive.tofu_risk(rows(driver_queries.TOFU_LINES))) == {"后": ["後"], "发": ["发发"]}
    for bad in (["# @tofu-risk: x"], ["# @tofu-risk: x", "# c"], ["# @tofu-risk: x", "a\ta"]):
        with pytest.raises(Exception, match="tofu-risk"):
            pairs(derive.tofu_risk(rows(bad)))
    keys = lex(spark, [("鼠標器", ["x"]), ("牛", ["x"]), ("軟體質", ["x"])])
    assert pairs(derive.regional(keys, Leaf({"q": ["q"]}))) == {"鼠標器": ["鼠標器"], "軟體質": ["軟體質"]}
    with pytest.raises(Exception, match="abc, abd"):
        pairs(derive.regional(lex(spark, [("abc", ["x"]), ("abd", ["x"])]), Leaf({"d": ["c"]})))


def test_generate(spark):
    doc = '{"conversion_chain": [{"dict": {"type": "ocd2", "file": "TWVariantsRev.ocd2"}}, {"dict": {"type": "ocd2", "file": "Plain.ocd2"}}]}'
    sources = lex(spark, [("a", ["b"])], "TWVariants").union(lex(spark, [("c", ["d"])], "Plain"))
    written, made = derive.generate(spark, {"x": doc}, sources)
    assert '"type": "sok"' in written["x"]
    assert sorted((r.lexicon, r.key, r.candidates) for r in made.collect()) == [("Plain", "c", ["d"]), ("TWVariantsRev", "b", ["a"])]
    with pytest.raises(errors.InvalidConfig):
        derive.recipe("Unknown", set())
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert sorted(map(tuple, derive.set_check(names("a", "b"), names("b", "c"), names("d")).collect())) == [("a", "missing"), ("c", "unregistered"), ("d", "stale")]
    assert sorted(map(tuple, derive.closure(names("a", "b"), names("b", "c")).collect())) == [("a", "not generated"), ("c", "not referenced")]


def test_lookup(spark):
    l = lex(spark, [("a", ["1"]), ("ab", ["2"]), ("𐈀b", ["3"])])
    t = spark.createDataFrame([("abc",), ("𐈀bz",), ("z",), ("",)], "t string")
    assert {r.t: (r.length, r.value) for r in lookup.longest_prefix(t, "t", l).collect()} == {"abc": (2, "2"), "𐈀bz": (3, "3")}
    assert {r.t for r in lookup.starting(t, "t", l).collect()} == {"abc", "𐈀bz"}
    assert lookup.key_starts(l).first().starts == [97, 0x10200] and lookup.max_key_length(l).first().max_key_length == 3
    assert lookup.self_lookup(l).count() == 0
    pts = F.array(*map(F.lit, (1, 5, 9)))
    row = spark.range(1).select(lookup.index_of(pts, F.lit(5)), lookup.index_of(pts, F.lit(4)), lookup.contains(pts, F.lit(9)), lookup.stops_skip(F.lit(0x2FF0), pts), lookup.union_points(pts, F.array(F.lit(2)))).first()
    assert tuple(row) == (1, -1, True, True, [1, 2, 5, 9])


def test_golden_corpora_are_strict(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text('{ // cases\n"cases": [{"id": "1", "input": "a,]", "expected": {"s2t": "A", "x": "B",},},], /* end */ }')
    cases = corpus.golden(spark, str(path))
    assert sorted(map(tuple, cases.collect())) == [("1", "a,]", "s2t", "A"), ("1", "a,]", "x", "B")]
    assert sorted(map(tuple, corpus.stem_states(cases, ["s2t"], []).collect())) == [("x", "unported")]
    assert sorted(map(tuple, corpus.stem_states(cases, ["s2t"], ["x", "s2t", "gone"]).collect())) == [("gone", "stale"), ("s2t", "stale")]
    for bad in ("no json", '{"cases": [{"id": 1, "input": "a", "expected": {}}]}', '{"cases": [{"input": "a"}]}', "[]"):
        path.write_text(bad)
        with pytest.raises(InvalidFormat):
            corpus.golden(spark, str(path))
    for bad in ("123", "{", '"a', '"a" x'):
        (tmp_path / "bad.jsonl").write_text(f'"fine"\n{bad}\n')
        with pytest.raises(Exception, match="not a JSON string"):
            corpus.fuzz(spark, str(tmp_path / "bad.jsonl")).collect()


def test_compare_counts_ids_on_one_side(spark):
    side = lambda rows: spark.createDataFrame(rows, "id string, output string")
    tally, first = compare.compare(side([("1", "a"), ("2", "b"), ("3", None), ("5", "")]), side([("1", "a"), ("3", None), ("4", "d"), ("5", None)]))
    assert tuple(tally.first()) == (5, 3)
    assert [tuple(r) for r in first.collect()] == [("2", "b", None), ("4", None, "d"), ("5", "", None)]


def test_corpora(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"cases": [{"id": "1", "input": "a", "expected": {"s2t": "A", "t2s": "B"}}]}')
    assert sorted(map(tuple, corpus.golden(spark, str(tmp_path / "g.json")).collect())) == [("1", "a", "s2t", "A"), ("1", "a", "t2s", "B")]
    (tmp_path / "f.jsonl").write_text('"a\\u0041"\n\n"b"\n')
    assert sorted(r.input for r in corpus.fuzz(spark, str(tmp_path / "f.jsonl")).collect()) == ["aA", "b"]
    assert corpus.parse_fuzz('"x"\n') == ["x"]
    files = spark.createDataFrame([(bytearray(b"ab"),), (bytearray(b"ab"),), (bytearray(b"x" * 600),)], "bytes binary")
    lines = corpus.hex_lines(files)
    assert [r.value for r in lines.collect()] == [f"{corpus.id_of(b'ab')}\t6162"]
    back = corpus.hex_corpus(lines.union(spark.createDataFrame([("0000000000000000\t61",), ("# c",)], "value string")))
    assert sorted((bytes(r.bytes), r.valid) for r in back.collect()) == [(b"a", False), (b"ab", True)]
    (tmp_path / "s.txt").write_text("text\n\n")
    assert corpus.sample(spark, str(tmp_path / "s.txt")).first().text == "text\n"
    inputs = spark.createDataFrame([("b",), ("a\n",), ("b",), ("é",)], "input string")
    assert sorted(r.input for r in corpus.united(inputs).collect()) == ["b", "é"]
    assert [r.value for r in corpus.token_lines(inputs.where("input = 'é'")).collect()] == ['"\\xC3\\xA9"']


def test_sinks(spark):
    l = lex(spark, [("b", ["1", "2"]), ("a\\", ["3\t"])])
    assert [r.value for r in sinks.lexicon_lines(l.where("key = 'b'")).collect()] == ["b\t1 2"]
    assert [r.value for r in sinks.dump_lines(l).collect()] == ["a\\\\\t3\\t", "b\t1\t2"]
    assert sinks.lexicon_text(l.where("key = 'b'"), sinks.REGIONAL_HEADER).first().text == sinks.REGIONAL_HEADER + "\nb\t1 2\n"
    bench = spark.createDataFrame([("s2t", 1.5)], "profile string, p50 double")
    assert sinks.bench_lines(bench).first().value == "[bench] profile=s2t p50=1.5"


def test_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, output string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "id long, output string")
    tally, first = compare.compare(a, b)
    assert tuple(tally.first()) == (3, 1) and [r.id for r in first.collect()] == [2]
    results = spark.createDataFrame([("1", "t2s", "a", "b"), ("2", "t2s", "a", "a")], "id string, stem string, expected string, output string")
    known = spark.createDataFrame([("1", "t2s"), ("2", "t2s")], "id string, stem string")
    assert [tuple(r) for r in compare.golden_failures(results, known).collect()] == [("2", "t2s", "stale")]
    assert compare.summarize([5, 1, 4, 2, 3]) == {"min": 1, "p50": 3, "p90": 4}
    s = spark.createDataFrame([("k", float(v)) for v in (5, 1, 4, 2, 3)], "k string, value double")
    assert tuple(compare.percentiles(s, ["k"]).first()) == ("k", 1.0, 3.0, 4.0)
    assert compare.measure(lambda: None, 10)["min"] >= 0 and compare.median_millis(lambda: None, 3) >= 0 and compare.retained_kib(lambda: [0] * 10_000) > 10
    kinds = "struct<accepted:boolean,outputs:array<string>,phase:string,category:string>"
    o = spark.createDataFrame([((True, ["a"], None, None), (True, ["a"], "x", None)), ((False, None, "p", "c"), (False, None, "p", "d"))], f"a {kinds}, b {kinds}")
    assert [r[0] for r in o.select(compare.same_outcome(F.col("a"), F.col("b"))).collect()] == [True, False]
    stage = "array<struct<index:int,segments:array<string>>>"
    kind = f"struct<normalization_stages:{stage},segments:array<string>,stages:{stage},output:string>"
    i = spark.createDataFrame([(([], ["a"], [], "a"), ([], ["b"], [], "c")), (([], [], [], ""), ([], [], [], ""))], f"a {kind}, b {kind}")
    assert [r[0] for r in i.select(compare.first_difference(F.col("a"), F.col("b"))).collect()] == ["segments", None]
    samples = spark.createDataFrame([(x, x) for x in ("short", "medium", "long", "phrases", "twp", "hk")], "id string, text string")
    got = compare.samples_for(samples, spark.createDataFrame([("s2t",), ("t2s",)], "profile string"))
    assert sorted((r.profile, r.id) for r in got.collect()) == [("s2t", "long"), ("s2t", "medium"), ("s2t", "phrases"), ("s2t", "short"), ("t2s", "long"), ("t2s", "medium")]
