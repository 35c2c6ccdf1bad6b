"""Command line over the library: ingest, index, publish, snapshots, retrieve, answer, agent, evaluate, trace."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import answer as answers
from .operators import lineage
from .plans import agent, batch, knowledge
from .sources import files
from .sources.snapshots import Workspace, trace_summary, trace_tree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scriptorium")
    p.add_argument("--workspace", default=".workspace")
    p.add_argument("--json", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("ingest")
    v.add_argument("--source", action="append", required=True)
    verbs.add_parser("index")
    verbs.add_parser("publish").add_argument("--note", default="")
    verbs.add_parser("snapshots")
    for name in ("retrieve", "answer", "agent"):
        v = verbs.add_parser(name)
        v.add_argument("query")
        v.add_argument("--snapshot", default="live")
        v.add_argument("--route", choices=("sparse", "dense", "hybrid"), default="hybrid")
        v.add_argument("--top-k", type=int, default=8)
        v.add_argument("--rerank-top-m", type=int, default=5)
        v.add_argument("--ann", action="store_true", help="search vectors by LSH instead of exactly")
        v.add_argument("--no-ann", action="store_true", help="exact search, the default")
        v.add_argument("--mode", choices=("grounded", "closed_book"), default="grounded")
        v.add_argument("--user-id")
        v.add_argument("--users")
        v.add_argument("--user-role", default="field_support")
        v.add_argument("--region", default="global")
        v.add_argument("--high-stakes", action="store_true")
        v.add_argument("--assume", action="append", default=[], metavar="KEY=VALUE")
        v.add_argument("--session-id")
        v.add_argument("--multi-agent", action="store_true")
    v = verbs.add_parser("evaluate")
    v.add_argument("--snapshot", default="live")
    v.add_argument("--dataset", required=True)
    v.add_argument("--users")
    v.add_argument("--route", choices=("sparse", "dense", "hybrid"), default="hybrid")
    v.add_argument("--mode", choices=("answer", "agent"), help="report by query, task and over all")
    v.add_argument("--output", help="folder for the report's rows as JSON lines")
    verbs.add_parser("trace").add_argument("trace_id", nargs="?")
    return p


def _user(spark: SparkSession, a: argparse.Namespace) -> tuple[str, str, bool]:
    if not a.user_id:
        return a.user_role, a.region, a.high_stakes
    rows = spark.read.option("multiLine", "true").schema(files.SIDE_SCHEMAS["users"]).json(a.users).where(F.col("user_id") == a.user_id).collect() if a.users else []
    if not rows:
        raise KeyError(f"Unknown user profile: {a.user_id}")
    return rows[0].role, rows[0].region or "global", bool(rows[0].high_stakes)


def _run(a: argparse.Namespace):
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    ws = Workspace(spark, a.workspace)
    if a.verb == "ingest":
        return knowledge.ingest(spark, a.source, ws)
    if a.verb == "index":
        return knowledge.index(spark, ws)
    if a.verb == "publish":
        return {"snapshot": ws.publish(a.note)}
    if a.verb == "snapshots":
        return ws.snapshots()
    if a.verb == "trace":
        if a.trace_id and not a.json:
            return trace_tree(ws.trace_rows(a.trace_id))
        return [r.asDict() for r in trace_summary(ws.spans(a.trace_id)).orderBy("name").collect()]
    kb = knowledge.KnowledgeBase(spark, ws.resolve(a.snapshot))
    if a.verb == "evaluate":
        users = spark.read.option("multiLine", "true").schema(files.SIDE_SCHEMAS["users"]).json(a.users) if a.users else None
        rows = files.read_jsonl(spark, a.dataset, files.QUERY_SCHEMA)
        if not a.mode and not a.output:
            return knowledge.evaluate(kb, rows, users, a.route)
        report = lineage.cut(batch.evaluate_runs(kb, rows, users, mode=a.mode or "answer"))
        if a.output:
            files.write_jsonl(report, a.output)
        return [r.asDict() for r in report.where("level < 2").orderBy("level", "task").drop("query_id").collect()]
    role, region, high = _user(spark, a)
    if bad := [x for x in a.assume if not x.partition("=")[0].strip() or "=" not in x]:
        raise ValueError(f"--assume needs KEY=VALUE, not {bad[0]}")
    given = dict(x.partition("=")[::2] for x in a.assume)
    if a.verb == "agent":
        return agent.run(a.query, kb, ws, role, region, high, given, a.session_id, a.multi_agent)
    q = kb.queries([("q", a.query, role, region, high)])
    if a.verb == "answer" and a.mode == "closed_book":
        return answers.closed_book(q).select("answer_text", "abstained").first().asDict()
    i = kb.intents(q)
    options = {"k": a.top_k, "m": a.rerank_top_m, "use_ann": a.ann and not a.no_ann}
    if a.verb == "answer":
        return kb.answer(i, a.route, **options).first().asDict()
    return [r.asDict() for r in kb.retrieve(i, a.route, **options).orderBy("final_rank").select("final_rank", "chunk_id", "title", "section", "final_score", "reasons").collect()]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        out = _run(a)
    except (FileNotFoundError, ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130
    if a.json or not isinstance(out, list):
        print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    else:
        for row in out:
            print(row if isinstance(row, str) else "  ".join(f"{k}={v}" for k, v in row.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
