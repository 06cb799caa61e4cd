"""The pipeline stage by stage, and its queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lexiweave.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == names and out.count() <= count
            count, docs = out.count(), out
    total = out.groupBy("sequence_id").sum("length").collect()
    full = [r[1] for r in sorted(total)][:-1]
    assert all(n == 4096 for n in full)
    assert corpus_pipeline.run(spark, DATA).count() == out.count()


def test_odd_documents_pass_all_stages(spark, tmp_path):
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).selectExpr("doc_id", "text", "lang")
    odd = [(900001, None, None), (900002, "", "en"), (None, "a text without an id and some more words to fill the row", "en"), (900005, "tie tie tie tie", "en"), (900005, "tie tie tie tie", "en"), (None, None, None), (900006, "word " * 20000, "en")]
    clash = ["__fp", "__row", "__lang", "__runs", "__drop", "token", "id", "c0", "ids", "a b`c"]
    docs = real.union(spark.createDataFrame(odd, real.schema))
    for k, n in enumerate(clash):
        docs = docs.withColumn(n.replace("`", ""), F.lit(k))
    for start in (docs, docs.where("false")):
        start.write.mode("overwrite").parquet(f"{tmp_path}/start")
        held = spark.read.parquet(f"{tmp_path}/start")
        names, count = held.columns, held.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, held, DATA)
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
            if name != "packing":
                assert out.columns == names and out.count() <= count
                held, count = out, out.count()
                assert all(r[n.replace("`", "")] == k for r in held.collect() for k, n in enumerate(clash))
        ids = [r.doc_id for r in held.select("doc_id").collect()]
        plain = lambda i: -1 if i is None else i
        assert sorted(plain(r.doc_id) for r in out.where("start = 0").collect()) == sorted(map(plain, ids))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
