"""Evaluation of retrieval routes over a set of questions: how well each finds the documents that hold a passage of
the question.

    python jobs/evaluate_retrieval.py --documents TABLE --questions TABLE --output FOLDER [--config FILE]

Reads documents (doc_id, text, source) and questions (item_id, text) as Parquet. A document is relevant if it holds
passage_tokens consecutive tokens of the question, and more so (2) if it holds at least half of these passages. Routes
are BM25 with the parameters in the configuration, and their fusion by rank. The output has

  report/route=R   level 3: a row per question; 2: means by task; 1: of the route; 0 (route=all): of everything
  hits/route=R     query_id, doc_id, rank, relevance: what was found, to look into

Questions of long_query_tokens or more are the task `passage`, others `lookup`. Each run replaces the routes that it
evaluates and leaves others: the same input gives the same files' rows. Doc ids and question ids are distinct."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptorium.functions import text  # noqa: E402
from scriptorium.operators import evaluation, search  # noqa: E402

log = logging.getLogger("evaluate_retrieval")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "evaluate_retrieval.json")
REPORT = "task string, query_id long, level int, queries long, judged_rate double, recall double, precision double, mrr double, ndcg double, route string"
HITS = "query_id long, doc_id long, rank int, relevance int, route string"


def load_config(path: str | None = None) -> dict:
    with open(path or CONFIG) as f:
        return json.load(f)


def passages(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, passage: each distinct run of n consecutive tokens, joined by spaces."""
    t = rows.select(key, text.tokenize("text").alias("t")).where(F.size("t") >= n)
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))
    return t.select(key, F.explode(F.array_distinct(runs)).alias("passage"))


def judgements(docs: DataFrame, questions: DataFrame, n: int, broadcast_passages: int) -> DataFrame:
    """query_id, doc_id, relevance."""
    asked = passages(questions, "query_id", n)
    size = asked.groupBy("query_id").agg(F.count("*").alias("of"))
    asked = F.broadcast(asked) if asked.count() <= broadcast_passages else asked
    held = passages(docs, "doc_id", n).join(asked, "passage").groupBy("query_id", "doc_id").agg(F.count("*").alias("held")).join(size, "query_id")
    return held.select("query_id", "doc_id", F.when(F.col("held") * 2 >= F.col("of"), 2).otherwise(1).alias("relevance"))


def run(spark: SparkSession, documents: str, questions: str, output: str, config: dict | None = None) -> None:
    """Evaluates all routes of the configuration."""
    config = config or load_config()
    docs = spark.read.parquet(documents).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("title"))
    q = spark.read.parquet(questions).select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text")).persist()
    log.info("read %d questions of %s", q.count(), questions)
    index = search.bm25_index(docs.withColumnRenamed("doc_id", "chunk_id"), only=search.query_terms(q))
    ranked = {name: search.bm25_search(q, index, config["depth"], p["k1"], p["b"]) for name, p in config["routes"].items()}
    if config.get("fused") and len(ranked) > 1:
        ranked[config["fused"]] = search.top_k(search.fuse(*ranked.values()), config["depth"])
    judged = judgements(docs, q, config["passage_tokens"], config["broadcast_passages"]).persist()
    rows, hits, kept = None, None, []
    task = F.when(F.size(text.tokenize("text")) >= config["long_query_tokens"], "passage").otherwise("lookup")
    known = q.select("query_id", task.alias("task")).join(judged.select("query_id").distinct().withColumn("judged", F.lit(True)), "query_id", "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    for name, found in ranked.items():
        found = found.select("query_id", F.col("chunk_id").alias("doc_id"), "rank").persist()
        kept.append(found)
        metrics = evaluation.ranking_metrics(found, judged, config["k"])
        own = known.join(metrics, "query_id", "left").select(F.lit(name).alias("route"), "task", "query_id", "judged", *(F.coalesce(m, F.lit(0.0)).alias(m) for m in evaluation.METRICS))
        shown = found.join(judged, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"), F.lit(name).alias("route"))
        rows, hits = (own, shown) if rows is None else (rows.unionByName(own), hits.unionByName(shown))
    report = evaluation.report(rows).withColumn("route", F.coalesce("route", F.lit("all")))
    for name, df in (("report", report), ("hits", hits)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route").parquet(f"{output}/{name}")
        log.info("wrote %d rows of %s below %s", read_back(spark, output, name).count(), name, output)
    for df in (q, judged, *kept):
        df.unpersist()


def read_back(spark: SparkSession, output: str, name: str = "report") -> DataFrame:
    return spark.read.schema({"report": REPORT, "hits": HITS}[name]).parquet(f"{output}/{name}")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "questions", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate_retrieval").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.documents, args.questions, args.output, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
