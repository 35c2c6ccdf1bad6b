"""The jobs as queries over the test tables: each runs its job twice into one new folder and reads the output back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import catalog

from . import evaluate_retrieval, ingest_documents


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; a temporary one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="jobs-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "ingest_documents")
    for _ in range(2):
        ingest_documents.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint")
    docs, chunks = (ingest_documents.read_back(spark, f"{folder}/output", t) for t in ("documents", "chunks"))
    cut = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chunk_chars"))
    out = docs.join(cut, "doc_id", "left")
    return out.select(
        "doc_id", "lang", "source", F.round("trust", 6).alias("trust"), F.round("quality", 6).alias("quality"), "status", "duplicate_of", "near_duplicate_of", "similarity", "n_tokens",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("chunk_chars", F.lit(0)).alias("chunk_chars"),
    )


def job2_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "evaluate_retrieval")
    for _ in range(2):
        evaluate_retrieval.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return evaluate_retrieval.read_back(spark, folder)


_TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_TOKENS = catalog.tok("text")

SQL = {
    "job1_ingest_documents": f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, {_TOKENS} AS t, [w for w in list_distinct({catalog.tok("source || ' ' || text")}) if w NOT IN ('the', 'and', 'for', 'with', 'this', 'that')] AS ws FROM d),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM t),
p AS (SELECT b.doc_id, a.doc_id AS other, count(*) / (a.n + b.n - count(*)) AS j FROM x a JOIN x b ON a.w = b.w AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.92 * greatest(a.n, b.n) GROUP BY b.doc_id, a.doc_id, a.n, b.n),
-- Texts without tokens are equal sets too.
z AS (SELECT doc_id, min(doc_id) OVER () AS other FROM t WHERE len(ws) = 0),
near AS (
  SELECT doc_id, min(other) AS near_duplicate_of, round(arg_min(j, other), 3) AS similarity FROM p WHERE j >= 0.92 GROUP BY doc_id
  UNION ALL SELECT doc_id, other, 1.0 FROM z WHERE other < doc_id),
marked AS (
  SELECT t.*, nullif(min(t.doc_id) OVER (PARTITION BY lower(source), text), t.doc_id) AS duplicate_of, near.near_duplicate_of, near.similarity
  FROM t LEFT JOIN near ON near.doc_id = t.doc_id),
s AS (SELECT *, CASE WHEN duplicate_of IS NOT NULL OR near_duplicate_of IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS status FROM marked),
w AS (
  SELECT doc_id, CASE WHEN len(t) <= 120 THEN {_TRIMMED} ELSE array_to_string(t[o + 1:o + 120], ' ') END AS piece
  FROM (SELECT *, unnest(CASE WHEN len(t) <= 120 THEN [0] ELSE range(0, CAST(ceil((len(t) - 120) / 96) * 96 AS BIGINT) + 1, 96) END) AS o FROM s WHERE status = 'kept')),
c AS (SELECT doc_id, count(*) AS n_chunks, sum(length(piece))::BIGINT AS chunk_chars FROM w GROUP BY doc_id)
SELECT s.doc_id, lang, source, round({catalog._TRUST.format(title="source")}, 6) AS trust, round({catalog._QUALITY.format(title="source")}, 6) AS quality, status, duplicate_of, near_duplicate_of, similarity,
  CAST(len(t) AS INTEGER) AS n_tokens, coalesce(n_chunks, 0) AS n_chunks, coalesce(chunk_chars, 0) AS chunk_chars
FROM s LEFT JOIN c ON c.doc_id = s.doc_id
""",
    "job2_evaluate_retrieval": f"""
WITH {catalog._BM25.strip()}, {catalog._bm25_sql("bm25", 16)}, {catalog._bm25_sql("flat", 16, 0.9, 0.0)},
fs AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM bm25 UNION ALL SELECT query_id, chunk_id, rank FROM flat) GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fs) WHERE rank <= 16),
hits AS (SELECT 'bm25' AS route, query_id, chunk_id AS doc_id, rank FROM bm25 UNION ALL SELECT 'flat', query_id, chunk_id, rank FROM flat UNION ALL SELECT 'fused', query_id, chunk_id, rank FROM fused),
qk AS (SELECT item_id AS query_id, {_TOKENS} AS t FROM benchmark), dk AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
qp AS (SELECT DISTINCT query_id, unnest([array_to_string(t[i:i + 7], ' ') for i in range(1, len(t) - 6)]) AS passage FROM qk),
dp AS (SELECT DISTINCT doc_id, passage FROM (SELECT doc_id, unnest([array_to_string(t[i:i + 7], ' ') for i in range(1, len(t) - 6)]) AS passage FROM dk) WHERE passage IN (SELECT passage FROM qp)),
sized AS (SELECT query_id, count(*) AS n FROM qp GROUP BY query_id),
judged AS (SELECT query_id, doc_id, CASE WHEN count(*) * 2 >= any_value(n) THEN 2 ELSE 1 END AS relevance FROM qp JOIN dp USING (passage) JOIN sized USING (query_id) GROUP BY query_id, doc_id),
best AS (
  SELECT query_id, count(*) AS n_rel, sum(CASE WHEN place <= 5 THEN (pow(2.0, relevance) - 1) / log2(place + 1.0) ELSE 0 END) AS ideal
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM judged) GROUP BY query_id),
got AS (
  SELECT route, query_id, count(relevance) FILTER (WHERE rank <= 5) AS found, count(*) FILTER (WHERE rank <= 5) AS shown, min(rank) FILTER (WHERE relevance > 0) AS first,
    coalesce(sum((pow(2.0, relevance) - 1) / log2(rank + 1.0)) FILTER (WHERE rank <= 5), 0) AS dcg
  FROM hits LEFT JOIN judged USING (query_id, doc_id) GROUP BY route, query_id),
m AS (
  SELECT r.route, CASE WHEN len(q.t) >= 40 THEN 'passage' ELSE 'lookup' END AS task, q.query_id, n_rel IS NOT NULL AS judged,
    coalesce(found / n_rel, 0) AS recall, coalesce(found / shown, 0) AS precision, coalesce(1.0 / first, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg
  FROM qk q CROSS JOIN (SELECT unnest(['bm25', 'flat', 'fused']) AS route) r LEFT JOIN got USING (route, query_id) LEFT JOIN best USING (query_id))
SELECT coalesce(route, 'all') AS route, task, query_id, CAST(3 - grouping(route) - grouping(task) - grouping(query_id) AS INTEGER) AS level, count(*) AS queries, round(avg(judged::INT), 6) AS judged_rate,
  round(avg(recall) FILTER (WHERE judged), 6) AS recall, round(avg(precision) FILTER (WHERE judged), 6) AS precision, round(avg(mrr) FILTER (WHERE judged), 6) AS mrr, round(avg(ndcg) FILTER (WHERE judged), 6) AS ndcg
FROM m GROUP BY ROLLUP (route, task, query_id)
""",
}

QUERIES = {f.__name__: f for f in (job1_ingest_documents, job2_evaluate_retrieval)}
