"""Streams of whole texts and of chunks."""

import random

from lexiweave.plans.kernel import Scanner
from lexiweave.plans.model import UNION, Group, Leaf
from lexiweave.streaming.convert import ChunkedScanner, convert_chunks, convert_stream

PLAN = Group([Leaf({"abc": ["X"], "a": ["y"]}), Leaf({"bca": ["Z"], "⿰a": ["!"]})], UNION)


def test_chunks_equal_the_whole():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abc⿰⿾x") for _ in range(rng.randint(0, 60)))
        scanner, out, at = ChunkedScanner(PLAN), "", 0
        while at < len(text):
            n = rng.randint(1, 7)
            out += scanner.push(text[at : at + n])
            at += n
        assert out + scanner.finish() == Scanner(PLAN).convert(text)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("k", 0, "xa", False), ("k", 1, "bc", False), ("k", 2, "ab", True)], "key string, seq int, chunk string, last boolean").write.parquet(src)
    stream = spark.readStream.schema("key string, seq int, chunk string, last boolean").parquet(src)
    q = convert_stream(stream, "chunk", PLAN).writeStream.format("memory").queryName("whole").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.output for r in spark.table("whole").collect()) == ["bc", "xy", "yb"]
    q = convert_chunks(stream, PLAN).writeStream.format("memory").queryName("parts").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("parts").collect()] == [("k", "xXyb")]
