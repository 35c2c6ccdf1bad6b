"""Offline build (ingest, index) and the knowledge base that answers batches of queries from one snapshot."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import policy
from ..operators import answer, documents, evaluation, intent, retrieval, search
from ..operators.lineage import cut
from ..sources import files
from ..sources.snapshots import Workspace


def ingest(spark: SparkSession, roots: list[str], ws: Workspace) -> dict:
    """Stages documents, quarantine and chunks; the counts. Scored documents are written once and read again."""
    ws.init().remove("staged")
    docs = documents.exact_duplicates(files.load_documents(spark, roots))
    near = documents.near_duplicates(docs)
    docs = docs.join(near, "doc_id", "left")
    docs.write.mode("overwrite").parquet(ws.path("staged", "all_documents"))
    kept, out = documents.split_quarantine(spark.read.parquet(ws.path("staged", "all_documents")))
    kept.write.parquet(ws.path("staged", "documents"))
    out.write.parquet(ws.path("staged", "quarantine"))
    documents.chunk_documents(spark.read.parquet(ws.path("staged", "documents"))).write.parquet(ws.path("staged", "chunks"))
    side = [(root, files.read_side_tables(spark, f"{root}/structured")) for root in roots]
    for _, tables in side:
        for name, t in tables.items():
            t.write.mode("overwrite").parquet(ws.path("staged", "structured", name))
    ws.remove("staged", "all_documents")
    counts = {n: spark.read.parquet(ws.path("staged", n)).count() for n in ("documents", "quarantine", "chunks")}
    counts["structured"] = sorted({n for _, t in side for n in t})
    files.write_json(spark, ws.path("staged", "manifest.json"), counts)
    return counts


def index(spark: SparkSession, ws: Workspace) -> dict:
    """Stages the indexes: postings sorted by term, term counts, corpus statistics, vectors."""
    chunks = spark.read.parquet(ws.path("staged", "chunks"))
    i = search.bm25_index(chunks)
    i.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(ws.path("staged", "postings"))
    i.terms.write.mode("overwrite").parquet(ws.path("staged", "terms"))
    i.stats.write.mode("overwrite").parquet(ws.path("staged", "stats"))
    text = chunks.select("chunk_id", F.concat_ws(" ", "title", "text").alias("text"))
    search.hash_embed(text, "chunk_id").write.mode("overwrite").parquet(ws.path("staged", "vectors"))
    search.lsh_buckets(spark.read.parquet(ws.path("staged", "vectors")), "chunk_id", search.planes()).write.mode("overwrite").parquet(ws.path("staged", "buckets"))
    summary = files.read_json(spark, ws.path("staged", "manifest.json")) | {"index_summary": {"terms": spark.read.parquet(ws.path("staged", "terms")).count(), "vectors": spark.read.parquet(ws.path("staged", "vectors")).count()}}
    files.write_json(spark, ws.path("staged", "manifest.json"), summary)
    return summary


class KnowledgeBase:
    """Lazy tables of one snapshot. Queries are DataFrames (query_id, text, role, user_region, high_stakes)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @cached_property
    def planes(self) -> list:
        return search.planes()

    def structured(self, name: str) -> DataFrame:
        return self.table(f"structured/{name}")

    def queries(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "query_id string, text string, role string, user_region string, high_stakes boolean")

    def intents(self, queries: DataFrame) -> DataFrame:
        i = intent.with_user_note(intent.infer(queries), F.coalesce("user_region", F.lit("global")))
        return i.withColumn("allowed", policy.disclosures_of("role"))

    def retrieve(self, intents: DataFrame, route: str = "hybrid", k: int = fixed.TOP_K, m: int = fixed.TOP_M, use_ann: bool = False, strict_roles: bool = False) -> DataFrame:
        """Reranked hits with their chunks' fields."""
        chunks = self.table("chunks")
        visible = retrieval.visibility(intents, chunks, strict_roles)
        i = search.BM25(self.table("postings"), self.table("terms"), self.table("stats"))
        found = retrieval.first_pass(intents, chunks, i, self.table("vectors"), self.planes, visible, route, k or fixed.TOP_K, use_ann, self.table("buckets") if use_ann else None)
        q = intents.select("query_id", F.col("tokens").alias("q_tokens"), F.col("identifiers").alias("q_identifiers"), F.col("product").alias("q_product"), F.col("region").alias("q_region"))
        return retrieval.rerank(search.with_chunks(found, chunks).join(F.broadcast(q), "query_id"), m or fixed.TOP_M)  # a stated query set

    def answer(self, intents: DataFrame, route: str = "hybrid", budget: int = fixed.BUDGET, hits: DataFrame | None = None, careful: bool | str = True, **options) -> DataFrame:
        """query_id, answer_text, abstained, clarification, groundedness, claims, context, token_count. The hits, a few per
        query, feed several branches, so they are kept; pass them in to use those of an earlier retrieve."""
        hits = self.retrieve(intents, route, **options).persist() if hits is None else hits
        packed = retrieval.pack(hits, budget or fixed.BUDGET)
        used = hits.join(packed.select("query_id", F.explode("chunk_ids").alias("chunk_id")), ["query_id", "chunk_id"], "left_semi").withColumn("rank", F.col("final_rank"))
        out = answer.answers(intents, used, retrieval.conflicts(used), careful)
        return out.join(packed.select("query_id", "context", "token_count"), "query_id", "left")

    def follow(self, intents: DataFrame, hits: DataFrame, hops: int = 1) -> DataFrame:
        chunks = self.table("chunks")
        return retrieval.follow_references(hits, chunks, retrieval.visibility(intents, chunks), hops)

    def with_followed(self, intents: DataFrame, hits: DataFrame, hops: int = fixed.FOLLOW_HOPS) -> DataFrame:
        """hits and what they refer to, to pack and to cite together; pass it to answer as its hits."""
        hits = cut(hits)
        return cut(retrieval.with_followed(hits, self.follow(intents, hits, hops), self.table("chunks")))


def as_queries(rows: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Evaluation rows (query_id, query, user_id) as queries of their users; a user that is not known is taken for a role."""
    q = rows.select("query_id", F.col("query").alias("text"), "user_id")
    who = users.select("user_id", "role", F.col("region").alias("user_region"), "high_stakes") if users is not None else rows.sparkSession.createDataFrame([], "user_id string, role string, user_region string, high_stakes boolean")
    return q.join(who, "user_id", "left").withColumns({"role": F.coalesce("role", "user_id", F.lit("external")), "user_region": F.coalesce("user_region", F.lit("global")), "high_stakes": F.coalesce("high_stakes", F.lit(False))})


def evaluate(kb: KnowledgeBase, rows: DataFrame, users: DataFrame | None = None, route: str = "hybrid", k: int = 5) -> dict:
    """Macro means over evaluation rows (query_id, query, user_id, relevant_doc_ids, expected_fragments, needs_clarification)."""
    intents = kb.intents(as_queries(rows, users))
    hits = kb.retrieve(intents, route).persist()
    judged = rows.select("query_id", F.explode("relevant_doc_ids").alias("doc_id"), F.lit(1).alias("relevance"))
    ranking = evaluation.macro(evaluation.ranking_metrics(hits.select("query_id", "doc_id", F.col("final_rank").alias("rank")), judged, k)).first().asDict()
    answers = kb.answer(intents, route, hits=hits).persist()
    asked = answers.join(rows.select("query_id", F.coalesce("needs_clarification", F.lit(False)).alias("needed")), "query_id").select((F.col("clarification").isNotNull()).alias("asked"), "needed")
    fragments = evaluation.fragment_hit_rate(answers, rows.select("query_id", F.col("expected_fragments").alias("fragments")))
    rates = answers.agg(F.round(F.avg("groundedness"), 4).alias("groundedness"), F.round(F.avg(F.col("abstained").cast("int")), 4).alias("abstention_rate")).first().asDict()
    return ranking | rates | fragments.agg(F.round(F.avg("rate"), 4).alias("fragment_hit_rate")).first().asDict() | evaluation.clarification_scores(asked).first().asDict()
