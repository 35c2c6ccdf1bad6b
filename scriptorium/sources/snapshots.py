"""Workspaces: staged tables, published snapshots, the live pointer, traces and sessions."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.memory import latest
from .files import exists, fs, read_json, write_json

FOLDERS = ("staged", "snapshots", "traces", "cache", "sessions")
TABLES = ("documents", "quarantine", "chunks", "postings", "terms", "stats", "vectors")
#: A row of a trace: a span, or an event with its time as started_at. parent_id is the span it happened in.
SPAN = "trace_id string, kind string, span_id int, parent_id int, name string, started_at double, ended_at double, input string, output string, diagnostics string, request_kind string, query string"
MEMORY = "session_id string, key string, value string, source string, scope string, confidence double, seq long, bucket int"
#: Folders of the session table; a session has one of them.
MEMORY_BUCKETS = 64


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def init(self) -> "Workspace":
        for name in FOLDERS:
            f, p = fs(self.spark, self.path(name))
            f.mkdirs(p)
        return self

    def remove(self, *parts: str) -> None:
        f, p = fs(self.spark, self.path(*parts))
        f.delete(p, True)

    def publish(self, note: str = "") -> str:
        """Copies the staged tables to a new snapshot and points live at it. Staging must be indexed."""
        if not exists(self.spark, self.path("staged", "postings")):
            raise ValueError("the staged snapshot has no indexes")
        name = f"snapshot-{datetime.now(UTC):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"
        util, conf = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, self.spark.sparkContext._jsc.hadoopConfiguration()
        (f, source), (_, target) = fs(self.spark, self.path("staged")), fs(self.spark, self.path("snapshots", name))
        util.copy(f, source, f, target, False, conf)
        write_json(self.spark, self.path("snapshots", name, "note.json"), {"note": note, "published_at": f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"})
        write_json(self.spark, self.path("live.json"), {"snapshot": name})
        return name

    def live(self) -> str:
        return self.path("snapshots", read_json(self.spark, self.path("live.json"))["snapshot"])

    def resolve(self, selector: str = "live") -> str:
        """The folder of 'live', 'staged', a snapshot's name or a path."""
        if selector == "live":
            return self.live()
        if selector == "staged":
            return self.path("staged")
        for p in (self.path("snapshots", selector), selector):
            if exists(self.spark, p):
                return p
        raise FileNotFoundError(selector)

    def snapshots(self) -> list[dict]:
        f, p = fs(self.spark, self.path("snapshots"))
        live = read_json(self.spark, self.path("live.json"), default={"snapshot": None})["snapshot"]
        names = sorted(s.getPath().getName() for s in f.listStatus(p)) if f.exists(p) else []
        return [{"snapshot": n, "live": n == live, **read_json(self.spark, self.path("snapshots", n, "note.json"), default={"note": ""})} for n in names]

    # ---- traces

    @contextmanager
    def trace(self, request_kind: str = "agent", query: str = ""):
        """A recorder whose spans and events are appended to the traces table at the end, also after an error, in the
        trace's own folder."""
        t = Trace()
        try:
            yield t
        finally:
            if t.rows:
                rows = [(t.id, *r, request_kind, query) for r in t.rows]
                self.spark.createDataFrame(rows, SPAN).coalesce(1).write.mode("append").partitionBy("trace_id").parquet(self.path("traces"))

    def trace_rows(self, trace_id: str | None = None) -> DataFrame:
        """Spans and events; empty before the first trace."""
        f, p = fs(self.spark, self.path("traces"))
        if not f.exists(p) or not len(f.listStatus(p)):
            return self.spark.createDataFrame([], SPAN)
        s = self.spark.read.schema(SPAN).parquet(self.path("traces")).select(*(c.split()[0] for c in SPAN.split(", ")))
        return s.where(F.col("trace_id") == trace_id) if trace_id else s

    def spans(self, trace_id: str | None = None) -> DataFrame:
        return self.trace_rows(trace_id).where("kind = 'span'")

    def events(self, trace_id: str | None = None) -> DataFrame:
        return self.trace_rows(trace_id).where("kind = 'event'").select("trace_id", "parent_id", "name", F.col("started_at").alias("at"), F.col("input").alias("payload"))

    # ---- sessions

    def save_memory(self, session_id: str, entries: list[tuple[str, str | None, str, str, float]]) -> None:
        """Appends (key, value, source, scope, confidence) entries; the last of a key counts on reading, and one
        without a value means that the key is forgotten."""
        rows = [(session_id, k, v, source, scope, float(c), time.time_ns() + i, None) for i, (k, v, source, scope, c) in enumerate(entries)]
        if rows:
            df = self.spark.createDataFrame(rows, MEMORY).withColumn("bucket", _bucket("session_id"))
            df.coalesce(1).write.mode("append").partitionBy("bucket").parquet(self.path("sessions"))

    def memory(self, session_id: str | None = None) -> DataFrame:
        """All entries ever saved or compacted, of one session from its bucket's files only."""
        f, p = fs(self.spark, self.path("sessions"))
        if not f.exists(p) or not len(f.listStatus(p)):
            return self.spark.createDataFrame([], MEMORY)
        m = self.spark.read.schema(MEMORY).parquet(self.path("sessions"))
        return m if session_id is None else m.where((F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))

    def load_memory(self, session_id: str) -> dict[str, str]:
        m = latest(self.memory(session_id), "session_id", "key").where("value is not null")
        return {r["key"]: r["value"] for r in m.collect()}

    def forget_memory(self, session_id: str, keep_scopes: tuple[str, ...] = ("profile",)) -> None:
        """Drops a session's entries of other scopes."""
        rows = latest(self.memory(session_id), "session_id", "key").where("value is not null").collect()
        self.save_memory(session_id, [(r["key"], None, "forget", r["scope"], 0.0) for r in rows if r["scope"] not in keep_scopes])

    def compact_memory(self) -> None:
        """Leaves the last entry of each key, a file a bucket. What counts is written down first and then replaces the
        buckets' files, so a run that broke off can be made again. To be run while nothing is saved. A forgotten key
        keeps its one row without a value, so that every bucket is replaced."""
        m = cut(latest(self.memory(), "session_id", "key"))
        if m.isEmpty():
            return
        columns = [c.split()[0] for c in MEMORY.split(", ")]
        m.select(*columns).repartition(MEMORY_BUCKETS, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path("sessions"))


def _bucket(session):
    return F.pmod(F.xxhash64(session), F.lit(MEMORY_BUCKETS)).cast("int")


class Trace:
    """Spans that may lie within one another, and events, in the order of their ends."""

    def __init__(self):
        self.id, self.rows, self._open, self._last = f"t{uuid.uuid4().hex[:16]}", [], [], 0

    @contextmanager
    def span(self, name: str, **given):
        self._last += 1
        number, parent, began, out, wrong = self._last, self._open[-1] if self._open else None, time.time(), {}, {}
        self._open.append(number)
        try:
            yield out
        except Exception as e:
            wrong["error"] = type(e).__name__
            raise
        finally:
            self._open.pop()
            self.rows.append(("span", number, parent, name, began, time.time(), *(json.dumps(x, default=str) for x in (given, out, wrong))))

    def event(self, name: str, **payload) -> None:
        self.rows.append(("event", None, self._open[-1] if self._open else None, name, time.time(), None, json.dumps(payload, default=str), "{}", "{}"))


def trace_tree(rows: DataFrame) -> list[str]:
    """The lines that show one trace (rows of Workspace.trace_rows, a request's few spans): spans below their parents in
    order of their start, and events where they happened."""
    rows = rows.orderBy("started_at", "span_id").collect()
    if not rows:
        return []
    below: dict = {}
    for r in rows:
        below.setdefault(r.parent_id, []).append(r)
    lines = [f"Trace {rows[0].trace_id} ({rows[0].request_kind}): {rows[0].query}"]

    def show(parent, depth: int) -> None:
        for r in below.get(parent, []):
            if r.kind == "event":
                lines.append(f"{'  ' * depth}* {r.name} {r.input}")
                continue
            took = "open" if r.ended_at is None else f"{(r.ended_at - r.started_at) * 1000:.3f} ms"
            lines.append(f"{'  ' * depth}- {r.name}: {took} | given {r.input} | found {r.output}" + (f" | {r.diagnostics}" if r.diagnostics != "{}" else ""))
            show(r.span_id, depth + 1)

    show(None, 1)
    return lines


def trace_summary(spans: DataFrame) -> DataFrame:
    """name, spans, open (not ended), total_ms, longest_ms, from spans with duration_ms or started_at and ended_at."""
    if "duration_ms" not in spans.columns:
        spans = spans.withColumn("duration_ms", F.round((F.col("ended_at") - F.col("started_at")) * 1000, 3))
    d = F.col("duration_ms")
    return spans.groupBy("name").agg(F.count("*").alias("spans"), F.count(F.when(d.isNull(), 1)).alias("open"), F.sum(d.cast("decimal(20,3)")).cast("double").alias("total_ms"), F.max(d).alias("longest_ms"))
