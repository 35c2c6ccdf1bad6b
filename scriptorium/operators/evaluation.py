"""Retrieval and answer metrics as aggregates over (query_id, doc_id, rank) hits and (query_id, doc_id, relevance) judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, judged: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg. Documents count once; repeats lower precision and gain nothing."""
    rel = judged.where("relevance > 0").select("query_id", "doc_id", F.col("relevance").cast("double").alias("relevance"))
    h = hits.select("query_id", "doc_id", "rank").join(rel, ["query_id", "doc_id"], "left")
    h = h.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) > 1)
    gain = (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("rank") + 1.0)
    top = F.col("rank") <= k
    got = h.groupBy("query_id").agg(
        F.count_distinct(F.when(top & F.col("relevance").isNotNull(), F.col("doc_id"))).alias("found"), F.count(F.when(top, 1)).alias("shown"), F.min(F.when(F.col("relevance").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(top & ~F.col("again"), F.coalesce(gain, F.lit(0.0))).otherwise(0.0)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id"))
    best = rel.withColumn("place", place).groupBy("query_id").agg(F.count("*").alias("n_rel"), F.sum(F.when(F.col("place") <= k, (F.pow(F.lit(2.0), "relevance") - 1) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("ideal"))
    out = got.join(best, "query_id", "left")
    safe = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(F.lit(0.0))
    return out.select("query_id", safe(F.col("found"), F.col("n_rel")).alias("recall"), safe(F.col("found"), F.col("shown")).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), safe(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def class_metrics(hits: DataFrame, queries: DataFrame, sizes: DataFrame, k: int = 5) -> DataFrame:
    """As ranking_metrics of judgements by which everything of a query's class has relevance 1, without a row per query and
    document of a class: hits (query_id, doc_id, rank, label), queries (query_id, label), sizes (label, n_rel)."""
    of = queries.select("query_id", F.col("label").alias("wanted"))
    h = hits.join(of, "query_id").withColumn("again", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")) > 1)
    top, right = F.col("rank") <= k, F.coalesce(F.col("label") == F.col("wanted"), F.lit(False))
    got = h.groupBy("query_id", "wanted").agg(
        F.count_distinct(F.when(top & right, F.col("doc_id"))).alias("found"), F.count(F.when(top, 1)).alias("shown"), F.min(F.when(right, F.col("rank"))).alias("first"),
        F.sum(F.when(top & right & ~F.col("again"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    out = got.join(sizes.withColumnRenamed("label", "wanted"), "wanted", "left")
    places = F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.greatest("n_rel", F.lit(1))).cast("int"))
    ideal = F.aggregate(places, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    safe = lambda a, b: F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(F.lit(0.0))
    ndcg = F.when(F.coalesce("n_rel", F.lit(0)) > 0, F.col("dcg") / ideal).otherwise(F.lit(0.0))
    return out.select("query_id", safe(F.col("found"), F.col("n_rel")).alias("recall"), safe(F.col("found"), F.col("shown")).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), ndcg.alias("ndcg"))


def clarification_scores(rows: DataFrame) -> DataFrame:
    """precision and recall of asking back, from rows (asked, needed)."""
    both = F.sum((F.col("asked") & F.col("needed")).cast("int"))
    ratio = lambda n: F.coalesce(both / F.nullif(n, F.lit(0)), F.lit(0.0))
    return rows.agg(ratio(F.sum(F.col("asked").cast("int"))).alias("clarification_precision"), ratio(F.sum(F.col("needed").cast("int"))).alias("clarification_recall"))


def retry_gain(pairs: DataFrame) -> DataFrame:
    """Mean of after - before; 0 without rows."""
    return pairs.agg(F.coalesce(F.avg(F.col("after") - F.col("before")), F.lit(0.0)).alias("retry_gain"))


def fragment_hit_rate(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, rate: the share of expected fragments in the lower-cased answer."""
    e = expected.select("query_id", F.explode("fragments").alias("f")).join(answers.select("query_id", F.lower("answer_text").alias("a")), "query_id")
    return e.groupBy("query_id").agg(F.avg(F.col("a").contains(F.lower("f")).cast("double")).alias("rate"))


def macro(metrics: DataFrame, places: int = 4) -> DataFrame:
    return metrics.agg(*(F.round(F.avg(c), places).alias(c) for c in metrics.columns if c != "query_id"))


METRICS = ("recall", "precision", "mrr", "ndcg")


def report(rows: DataFrame, by: tuple[str, ...] = ("route", "task", "query_id"), metrics: tuple[str, ...] = METRICS, places: int = 6) -> DataFrame:
    """Rows of each query, means by task of a route, by route, and of all, in one pass: by, level (how many of by
    are fixed), queries, judged_rate and the means of metrics over judged rows.

    rows has by, judged (whether the query has anything relevant) and metrics. Queries without count as queries, but
    not in the means, as a question that has no answer says nothing about the ranking."""
    of = lambda c: F.round(F.avg(F.when(F.col("judged"), F.col(c))), places).alias(c)
    level = sum((F.lit(1) - F.grouping(c).cast("int") for c in by), F.lit(0))
    return rows.rollup(*by).agg(level.cast("int").alias("level"), F.count("*").alias("queries"), F.round(F.avg(F.col("judged").cast("double")), places).alias("judged_rate"), *map(of, metrics))


RATES = ("groundedness", "fragment_hit", "abstained", "clarified", "escalated")


def run_report(rows: DataFrame, by: tuple[str, ...] = ("task", "query_id"), places: int = 4) -> DataFrame:
    """An evaluation run by query, by task and over all, in one pass: by, level (how many of by are fixed), queries,
    answers, the means of METRICS over queries and of RATES over answers, clarification_precision and clarification_recall.

    rows has by, METRICS, answered (false: only whether one had to ask back is judged), RATES (numbers or booleans), asked
    and needed. Means are 0 where nothing counts; a query whose metrics are null counts as 0 in them, nulls of the rest as
    false or 0. A null task is a task of its own."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    answered, asked, needed = (F.coalesce(c, F.lit(False)) for c in ("answered", "asked", "needed"))
    mean = lambda x: F.round(F.coalesce(F.avg(x), F.lit(0.0)), places)
    both = F.count(F.when(asked & needed, 1))
    share = lambda n: F.round(F.coalesce(both / F.nullif(n, F.lit(0)), F.lit(0.0)), places)
    level = sum((F.lit(1) - F.grouping(c).cast("int") for c in by), F.lit(0))
    return rows.rollup(*by).agg(
        level.cast("int").alias("level"), F.count("*").alias("queries"), F.count(F.when(answered, 1)).alias("answers"), *(mean(number(m)).alias(m) for m in METRICS), *(mean(F.when(answered, number(c))).alias(c) for c in RATES),
        share(F.count(F.when(asked, 1))).alias("clarification_precision"), share(F.count(F.when(needed, 1))).alias("clarification_recall"),
    )
