"""Spans from records of their starts, events and ends: the same plan over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "trace_id string, span_id string, parent_id string, name string, kind string, ts timestamp"


def close_spans(records: DataFrame, timeout: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """One row a span: trace_id, span_id, window_end, parent_id, name, started_at, ended_at, events, status, duration_ms.

    records (trace_id, span_id, parent_id, name, kind, ts) has kind start, event or end. A span's records belong together
    while no two neighbours are further apart than timeout; later ones of the same id make another row. status: closed
    (its last end is not before its first start), timed_out (no such end), or orphan (no start). Repeated starts count from the
    first, repeated ends to the last; parent and name are the greatest of the starts'. Rows without a time belong
    to nothing; null ids are an id. Other columns are ignored.

    Over a stream a row is given once the watermark, late behind the newest record, is past window_end; records
    that come later than that are dropped. The state holds the spans that may still go on, a row each."""
    r = records.select("trace_id", "span_id", "parent_id", "name", "kind", F.col("ts").cast("timestamp").alias("ts"))
    r = r.withWatermark("ts", late) if r.isStreaming else r
    at = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    s = r.groupBy("trace_id", "span_id", F.session_window("ts", timeout).alias("w")).agg(
        F.max(at("start", "parent_id")).alias("parent_id"), F.max(at("start", "name")).alias("name"), F.min(at("start", "ts")).alias("started_at"), F.max(at("end", "ts")).alias("last_end"),
        F.count(at("event", "kind")).alias("events"),
    )
    ends = F.col("last_end") >= F.col("started_at")
    s = s.withColumn("status", F.when(F.col("started_at").isNull(), "orphan").when(ends, "closed").otherwise("timed_out"))
    closed = F.col("status") == "closed"
    took = F.round((F.unix_micros("last_end") - F.unix_micros("started_at")) / 1000, 3)
    return s.select(
        "trace_id", "span_id", F.col("w.end").alias("window_end"), "parent_id", "name", "started_at", F.when(closed, F.col("last_end")).alias("ended_at"), "events", "status", F.when(closed, took).alias("duration_ms")
    )


def self_times(spans: DataFrame, salts: int = 16) -> DataFrame:
    """spans with children, children_ms and self_ms: what closed spans took without the closed spans that started in them.

    A child belongs to the row of its parent that it started in (an id may have several). The children of one parent meet
    it under salts, so that a parent with very many is no single task, and are summed up in parts. Children at one time
    may add up to more than their parent, and self_ms is then 0. Both are null for spans that are not closed. A null
    trace_id or span_id has no children."""
    closed = spans.where("status = 'closed'")
    parents = closed.select("trace_id", F.col("span_id").alias("parent_id"), F.col("started_at").alias("p_start"), F.col("ended_at").alias("p_end"), F.col("window_end").alias("p_window"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    kids = closed.where("parent_id is not null").select("trace_id", "parent_id", "started_at", "duration_ms", F.pmod(F.hash("span_id", "started_at"), F.lit(salts)).alias("salt"))
    within = (F.col("started_at") >= F.col("p_start")) & (F.col("started_at") <= F.col("p_end"))
    sums = kids.join(parents, ["trace_id", "parent_id", "salt"]).where(within).groupBy("trace_id", F.col("parent_id").alias("span_id"), F.col("p_window").alias("window_end"))
    sums = sums.agg(F.count("*").alias("children"), F.sum(F.col("duration_ms").cast("decimal(20,3)")).cast("double").alias("children_ms"))
    is_closed = F.col("status") == "closed"
    out = spans.join(sums, ["trace_id", "span_id", "window_end"], "left")
    total = F.coalesce("children_ms", F.lit(0.0))
    return out.withColumns({
        "children": F.coalesce("children", F.lit(0)).cast("long"), "children_ms": F.when(is_closed, total),
        "self_ms": F.when(is_closed, F.round(F.greatest(F.col("duration_ms") - total, F.lit(0.0)), 3)),
    })


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, timeout: str = "30 minutes", late: str = "10 minutes"):
    """Takes the new JSON files of records below folder and appends the spans that have ended since. A span that may
    still go on waits in the checkpoint's state for a later run."""
    records = spark.readStream.schema(RECORD).json(folder)
    return close_spans(records, timeout, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
