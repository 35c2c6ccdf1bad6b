"""A bounded controller over the knowledge base and its tools. Each step runs one distributed query and brings a
query's few hits to the driver; for batches, use plans.batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import policy
from ..operators import intent as I
from ..operators import memory
from ..sources.snapshots import Workspace
from .knowledge import KnowledgeBase

SEARCH = {"sparse_first": "sparse", "cheap_default": "sparse"}


@dataclass
class Tool:
    required: tuple[str, ...]
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    read_only: bool = True


#: The tools and their arguments.
TOOLS = {
    "search_documents": Tool(("query",), {"route": ("sparse", "dense", "hybrid")}),
    "get_runbook_steps": Tool(("environment", "procedure_name"), {"environment": ("sandbox", "staging", "production")}),
    "lookup_service_centers": Tool(("region", "model")),
    "get_document_metadata": Tool(("doc_id",)),
    "submit_ticket_update": Tool(("ticket_id", "note"), read_only=False),
}


#: What may be wrong with a call, in the order of the checks: for which argument of the tool, and how it is put.
CHECKS = (
    (lambda tool, given: [None] if tool is None else [], lambda name, _, __: f"There is no tool {name}."),
    (lambda tool, given: [k for k in tool.required if given.get(k) in (None, "")], lambda name, k, _: f"{name} needs the argument {k}."),
    (lambda tool, given: [k for k, allowed in tool.enums.items() if k in given and given[k] not in allowed], lambda name, k, tool: f"{k} has to be one of {', '.join(tool.enums[k])}."),
)


def service_centers(centers: DataFrame, region: str, model: str, warranty_program: str | None = None) -> DataFrame:
    """The centres (region, models, warranty_programs) of a region for a model, under a programme if one is named."""
    found = centers.where((F.col("region") == region) & F.array_contains("models", model))
    return found.where(F.array_contains("warranty_programs", warranty_program)) if warranty_program else found


class Tools:
    def __init__(self, kb: KnowledgeBase):
        self.kb = kb

    @staticmethod
    def validate(name: str, arguments: dict) -> str | None:
        """What is wrong with a call, None if nothing is."""
        tool = TOOLS.get(name)
        return next((say(name, k, tool) for found, say in CHECKS for k in found(tool, arguments)), None)

    def execute(self, name: str, arguments: dict, role: str, approved: bool = False) -> dict:
        if error := self.validate(name, arguments):
            return {"status": "validation_error", "payload": {}, "error": error}
        action = name if TOOLS[name].read_only else f"side_effect:{name}"
        allowed = policy.action_allowed(F.lit(action), F.lit(approved), F.lit(arguments.get("disclosure", "public")), F.lit(role))
        if not self.kb.spark.range(1).select(allowed.alias("ok")).first().ok:
            return {"status": "permission_denied", "payload": {}, "error": "The policy does not allow this call."}
        return getattr(self, f"_{name}")(arguments, role)

    def _search_documents(self, a: dict, role: str) -> dict:
        i = self.kb.intents(self.kb.queries([("q", str(a["query"]), role, "global", False)]))
        hits = self.kb.retrieve(i, a.get("route", "hybrid"), int(a.get("top_k", 5)))
        rows = hits.orderBy("final_rank").select("chunk_id", "doc_id", "title", F.round("final_score", 5).alias("score")).collect()
        return {"status": "ok", "payload": {"hits": [r.asDict() for r in rows]}, "error": None}

    def _get_runbook_steps(self, a: dict, role: str) -> dict:
        t = self.kb.structured("runbooks").where((F.col("environment") == a["environment"]) & F.lower("procedure_name").contains(str(a["procedure_name"]).lower()))
        rows = t.orderBy("procedure_name").limit(1).collect()
        return {"status": "ok", "payload": rows[0].asDict(), "error": None} if rows else {"status": "not_found", "payload": {}, "error": "No such procedure in this environment."}

    def _lookup_service_centers(self, a: dict, role: str) -> dict:
        t = service_centers(self.kb.structured("service_centers"), a["region"], a["model"], a.get("warranty_program"))
        return {"status": "ok", "payload": {"rows": [r.asDict() for r in t.orderBy("name").collect()]}, "error": None}

    def _get_document_metadata(self, a: dict, role: str) -> dict:
        rows = self.kb.table("documents").where(F.col("doc_id") == str(a["doc_id"])).select("doc_id", "title", "doc_type", "effective_date", "authority", "status", "disclosure", "references").limit(1).collect()
        return {"status": "ok", "payload": rows[0].asDict(), "error": None} if rows else {"status": "not_found", "payload": {}, "error": "There is no such document."}

    def _submit_ticket_update(self, a: dict, role: str) -> dict:
        return {"status": "blocked", "payload": dict(a), "error": "Side effects are not carried out."}


def run(query: str, kb: KnowledgeBase, ws: Workspace, role: str = "field_support", region: str = "global", high_stakes: bool = False, assumptions: dict | None = None, session_id: str | None = None, multi_agent: bool = False) -> dict:
    """One query through plan, tools, retrieval, retry, escalation or answer in at most MAX_STEPS steps."""
    tools = Tools(kb)
    with ws.trace("agent", query) as trace, trace.span("request", role=role, region=region):
        base = kb.intents(kb.queries([("q", query, role, region, high_stakes)]))
        if assumptions:
            base = I.assume(base.withColumn("assumptions", F.create_map(*(F.lit(x) for kv in assumptions.items() for x in kv))))
        # A region or product that was assumed, or named in the query, comes before what the session remembers.
        base = memory.recall(base.withColumn("session_id", F.lit(session_id)), ws.memory(session_id)) if session_id else base.withColumns({"remembered": F.array().cast("array<string>"), "conflict": F.lit(False)})
        seen = base.select("*", I.route(F.col("task_type"), F.col("identifiers"), F.lit(high_stakes), F.col("normalized")).alias("route"), I.plan(F.col("task_type"), F.col("missing_scope")).alias("plan")).first().asDict(recursive=True)
        # Filters that the query does not name are searched for, too.
        named = I.search_text(F.col("normalized"), *(F.lit((assumptions or {}).get(k) or seen[k]).cast("string") for k in ("region", "product", "disclosure")))
        base = base.withColumn("normalized", named)
        route, out = seen["route"], {"query": query, "plan": seen["plan"], "trace_id": trace.id, "steps": [], "structured": [], "notes": [f"remembered {x}" for x in seen["remembered"]]}
        if seen["remembered"]:
            trace.event("memory", filled=seen["remembered"])
        if seen["conflict"]:
            out["notes"].append("the query names another model than the session; only its profile is kept")
            trace.event("memory_conflict", product=seen["product"])
            ws.forget_memory(session_id)
        missing = [k for k in seen["missing_scope"] if not (assumptions or {}).get(k)]
        if missing:
            ask = f"{fixed.ASK_SCOPE}{', '.join(missing)}."
            options = f" Options: {', '.join(seen['ambiguous_options'])}." if seen["ambiguous_options"] else ""
            return out | {"status": "clarify", "answer_text": ask + options, "clarification": ask + options}
        base = base.withColumn("missing_scope", F.array().cast("array<string>"))
        learned, before, behind = [(k, seen[k], "query", "session", 1.0) for k in ("product", "region") if seen[k] and not seen["conflict"]], "", ""
        if seen["task_type"] == "structured":
            with trace.span("structured_lookup"):
                place = seen["region"] or (region if region != "global" else "EU")
                out["structured"] = tools.execute("lookup_service_centers", {"region": place, "model": seen["product"] or "V14"}, role)["payload"].get("rows", [])
            if out["structured"]:
                before = fixed.CENTERS_FOUND % ", ".join(r["name"] for r in out["structured"])
                # The policy is looked for by the first centre's programme, in the region that was looked up.
                if programs := out["structured"][0]["warranty_programs"]:
                    base = base.withColumn("normalized", F.concat("normalized", F.lit(f" warranty program {programs[0]}")))
                    learned.append(("warranty_program", programs[0], "structured_tool", "task", 0.95))
                base = base.withColumn("region", F.coalesce("region", F.lit(place)))
        if seen["task_type"] == "procedural":
            with trace.span("tool_lookup"):
                low = query.lower()
                place = next((e for e in ("production", "staging") if e in low), "sandbox")
                found = tools.execute("get_runbook_steps", {"environment": place, "procedure_name": "rotation"}, role)
                out["structured"] = [found["payload"]] if found["status"] == "ok" else []
                if out["structured"]:
                    lines = "; ".join(found["payload"]["steps"][:3])
                    behind = fixed.STEPS_FOUND % (place, lines)
                    learned.append(("runbook_steps", lines, "tool:get_runbook_steps", "task", 0.95))
        for step in range(fixed.MAX_STEPS):
            with trace.span("retrieve", route=route, step=step) as span:
                hits = kb.retrieve(base, SEARCH.get(route, "hybrid"), 5 if route == "structured_then_policy" else fixed.TOP_K).persist()
                rows = hits.orderBy("final_rank").select("chunk_id", "doc_id", "title", "status", "product", "region", "final_score").collect()
                span["hits"] = [r.chunk_id for r in rows]
            out["steps"].append({"route": route, "hits": [r.chunk_id for r in rows]})
            weak = not rows or rows[0].final_score < fixed.RETRY_UNDER
            after = "hybrid_plus_careful" if route in ("sparse_first", "cheap_default") else route
            # The same route would give the same hits again.
            if weak and after != route:
                trace.event("retry", under=fixed.RETRY_UNDER, before=route, after=after)
                route = after
                continue
            break
        if not rows:
            trace.event("escalate", reason="no evidence")
            return out | {"status": "escalate", "answer_text": fixed.NO_EVIDENCE, "escalation": "no evidence"}
        pairs: dict[tuple, set] = {}
        for r in rows:
            pairs.setdefault((r.product, r.region), set()).add(r.status)
        if high_stakes and any({"active", "superseded"} <= s for s in pairs.values()):
            trace.event("escalate", reason="conflicting sources")
            return out | {"status": "escalate", "answer_text": "Conflicting sources need a human review.", "escalation": "conflicting sources"}
        if seen["task_type"] == "multi_hop" or (seen["task_type"] == "procedural" and not behind):
            with trace.span("follow_reference") as span:
                every = kb.with_followed(base, hits)
                shown = {r.chunk_id for r in rows}
                out["followed"] = span["chunks"] = [r.chunk_id for r in every.orderBy("final_rank").select("chunk_id").collect() if r.chunk_id not in shown]
                hits = every
        with trace.span("synthesize"):
            careful = route in ("hybrid_plus_careful", "structured_then_policy") or seen["task_type"] in ("multi_hop", "procedural")
            a = kb.answer(base, SEARCH.get(route, "hybrid"), hits=hits, careful=careful).first().asDict()
        if multi_agent:
            out["notes"].append("verifier: claims need more support" if (a["groundedness"] or 0) < fixed.SUPPORTED else "verifier: claims are supported")
            if role == "distributor_support":
                out["notes"].append("policy guard: only partner-shareable evidence was used")
        if session_id:
            ws.save_memory(session_id, learned)
        return out | {"status": "answer", **a, "answer_text": before + a["answer_text"] + behind}
