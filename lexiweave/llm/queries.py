"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, html, language, lines, packing, pii, secrets, simhash, substrings

#: Name of the vocabulary file that packing uses by default.
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Path of the default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator, over whole tables."""
    docs = lambda s, d: _table(s, d, "documents")
    return {
        "op1_secret_scan": lambda s, d: secrets.scan(docs(s, d)),
        "op2_embedding_near_dedup": lambda s, d: embeddings.near_duplicates(_table(s, d, "embeddings")),
        "op3_packing": lambda s, d: packing.pack(docs(s, d), tokenizer_path()),
        "op4_pii": lambda s, d: pii.scan(docs(s, d)),
        "op5_language_id": lambda s, d: language.predictions(docs(s, d)),
        "op6_line_dedup": lambda s, d: lines.report(docs(s, d)),
        "op7_simhash_near_dedup": lambda s, d: simhash.near_duplicates(docs(s, d)),
        "op8_html_extraction": lambda s, d: html.extract(_table(s, d, "pages")),
        "op9_suffix_array_dedup": lambda s, d: substrings.repeated(docs(s, d)).drop("removed"),
        "op10_benchmark_decontamination": lambda s, d: decontaminate.contamination(docs(s, d), _table(s, d, "benchmark")),
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
ns AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, item_id, s, dg.n AS n FROM dg JOIN bw ON dg.n = bw.n AND dg.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

_OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT DISTINCT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN k ON k.x = vec_id"""

_BLANK = "chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"

_OP6 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
l AS (SELECT *, trim(lower(line), {_BLANK}) AS norm FROM p),
u AS (SELECT norm, row_number() OVER (ORDER BY min((doc_id, pos))) AS id, min((doc_id, pos)) AS place FROM l WHERE norm <> '' GROUP BY norm),
t AS (SELECT DISTINCT id, array_to_string(w[s:s + 4], ' ') AS token FROM (
    SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM (SELECT id, string_split(norm, ' ') AS w FROM u))),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
c AS (SELECT x.id AS id, y.id AS other, count(*) AS c FROM t x JOIN t y ON x.token = y.token AND y.id < x.id GROUP BY ALL),
near AS (SELECT DISTINCT c.id FROM c JOIN n a ON a.id = c.id JOIN n b ON b.id = c.other WHERE 9 * c >= 4 * (a.n + b.n)),
g AS (SELECT l.doc_id, l.pos, l.line, l.norm <> '' AND ((l.doc_id, l.pos) <> u.place OR near.id IS NOT NULL) AS gone
    FROM l LEFT JOIN u ON u.norm = l.norm LEFT JOIN near ON near.id = u.id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM g GROUP BY doc_id"""

# Blocks of 1,000 windows first, as cutting each window out of a long text is quadratic.
_OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, c, substr(h, 2000 * c + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS c FROM d)),
w AS (SELECT doc_id, 1000 * c + s AS s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, c, h, unnest(range(0, len(h) // 2 - 49)) AS s FROM b WHERE len(h) >= 100)),
m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
hit AS (SELECT doc_id, s FROM w JOIN m ON m.g = w.g WHERE low < doc_id),
e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
i AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e),
r AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS z FROM i GROUP BY doc_id, k),
q AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM r),
o AS (SELECT d.doc_id, any_value(h) AS h, sum(z - a) AS removed, count(z) AS spans, coalesce(max(z), 0) AS rest,
    coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k), '') AS kept FROM d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
    sha256(unhex(kept || substr(h, 2 * rest + 1))) AS kept_sha256 FROM o"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {"op2_embedding_near_dedup": _OP2, "op6_line_dedup": _OP6, "op9_suffix_array_dedup": _OP9, "op10_benchmark_decontamination": _OP10}
