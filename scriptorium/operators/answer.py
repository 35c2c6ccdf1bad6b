"""Extractive answers with claims, citations and support, over batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text
from . import retrieval


def support_score(claim: Column | str, support: Column | str) -> Column:
    """Share of the claim's terms found, and of its numbers (1 without numbers); 0 for an empty claim."""
    c, s = F.array_distinct(text.tokenize(claim)), F.array_distinct(text.tokenize(support))
    cn, sn = text.numbers(claim), text.numbers(support)
    overlap = F.size(F.array_intersect(c, s)) / F.greatest(F.lit(1), F.size(c))
    kept = F.when(F.size(cn) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(cn, sn)) / F.size(cn))
    return F.when(F.size(c) == 0, F.lit(0.0)).otherwise(fixed.SUPPORT_OVERLAP * overlap + fixed.SUPPORT_NUMBERS * kept)


def evidence_sentences(evidence: DataFrame) -> DataFrame:
    """evidence (query_id, rank, text, ...) with a row per sentence: sentence, pos."""
    return evidence.select("*", F.posexplode(text.split_sentences("text")).alias("pos", "sentence"))


def best_evidence(evidence: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, sentence, nth: the sentences with most query terms (0.5 more per query identifier), each text once."""
    s = evidence_sentences(evidence)
    bonus = F.size(F.filter(F.col("q_identifiers"), lambda i: F.lower("sentence").contains(F.lower(i)))) * 0.5
    s = s.withColumn("score", F.size(F.array_intersect(F.array_distinct("q_tokens"), text.tokenize("sentence"))) + bonus)
    order = [F.col("score").desc(), F.col("rank"), F.col("pos")]
    one = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "sentence").orderBy(*order))).where("r = 1")
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("nth") <= limit).select("query_id", "sentence", "nth", "score")


def cite(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (query_id, claim_no, claim) with the best supporting sentence above 0, the first on ties, and supported."""
    pairs = claims.join(evidence_sentences(evidence), "query_id").withColumn("support", F.round(support_score("claim", "sentence"), 9)).where("support > 0")
    w = Window.partitionBy("query_id", "claim_no").orderBy(F.col("support").desc(), "rank", "pos")
    best = pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", "claim_no", "chunk_id", "doc_id", "title", "section", F.col("sentence").alias("support_span"), "support")
    out = claims.join(best, ["query_id", "claim_no"], "left")
    return out.withColumn("supported", F.coalesce(F.col("support") >= fixed.SUPPORTED, F.lit(False))).withColumn("note", F.when(~F.col("supported"), fixed.LOW_SUPPORT))


def groundedness(cited: DataFrame) -> DataFrame:
    return cited.groupBy("query_id").agg((F.sum(F.col("supported").cast("int")) / F.greatest(F.lit(1), F.count("*"))).alias("groundedness"))


def comparison_claims(evidence: DataFrame) -> DataFrame:
    """Newest and oldest evidence by date as text, the first on ties."""
    first = F.get(text.split_sentences("text"), F.lit(0))
    e = evidence.withColumn("d", F.coalesce("effective_date", F.lit(""))).withColumn("s", F.struct("title", first.alias("first"), "doc_id"))
    one = e.groupBy("query_id").agg(F.max_by("s", F.struct("d", -F.col("rank"))).alias("new"), F.min_by("s", F.struct("d", "rank")).alias("old"))
    newest = F.struct(F.lit(1).alias("claim_no"), F.concat(F.lit(fixed.NEWEST), "new.title", F.lit(". "), "new.first").alias("claim"))
    oldest = F.struct(F.lit(2).alias("claim_no"), F.concat(F.lit(fixed.OLDER), "old.title", F.lit(". "), "old.first").alias("claim"))
    return one.select("query_id", F.explode(F.when(F.col("new.doc_id") != F.col("old.doc_id"), F.array(newest, oldest)).otherwise(F.array(newest))).alias("c")).select("query_id", "c.claim_no", "c.claim")


def claims_for(intents: DataFrame, evidence: DataFrame, conflicts: DataFrame | None = None, careful: bool | str = True) -> DataFrame:
    """query_id, claim_no, claim by task: comparison, procedural (two sentences and the sources), others (two sentences);
    then the conflicts, all for a comparison and the first for others, and where careful a note on several; careful
    can be the name of a boolean column of intents."""
    task = intents.select("query_id", "task_type")
    compare = comparison_claims(evidence.join(task.where("task_type = 'comparison'"), "query_id", "left_semi"))
    rest = evidence.join(task.where("task_type <> 'comparison'"), "query_id", "left_semi")
    best = best_evidence(rest, 2).select("query_id", F.col("nth").alias("claim_no"), F.col("sentence").alias("claim"))
    steps = rest.join(task.where("task_type = 'procedural'"), "query_id", "left_semi").where("rank <= 2")
    sources = steps.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"])).alias("t"))
    sources = sources.select("query_id", F.lit(3).alias("claim_no"), F.concat(F.lit(fixed.SOURCES), F.array_join("t", ", "), F.lit(".")).alias("claim"))
    out = compare.unionByName(best).unionByName(sources)
    if conflicts is None:
        return out
    note = conflicts.join(task, "query_id").withColumn("claim", F.concat(F.lit(fixed.CONFLICT_NOTE), retrieval.conflict_text()))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "product", "region"))
    note = note.withColumn("claim_no", place + 3).where("task_type = 'comparison' or claim_no = 4 and task_type <> 'procedural'")
    out = out.unionByName(note.select("query_id", "claim_no", "claim"))
    if careful:
        noted = intents.where(F.col(careful)).select("query_id") if isinstance(careful, str) else task
        many = conflicts.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").join(noted, "query_id", "left_semi")
        out = out.unionByName(many.select("query_id", (F.col("n") + 4).cast("int").alias("claim_no"), F.lit(fixed.MANY_CONFLICTS).alias("claim")))
    return out


CLAIMS = "array<struct<claim_no: int, claim: string, supported: boolean, support: double, chunk_id: string, support_span: string>>"


def answers(intents: DataFrame, evidence: DataFrame, conflicts: DataFrame | None = None, careful: bool | str = True) -> DataFrame:
    """query_id, answer_text, abstained, clarification, groundedness, claims (each with its citation) for each query.

    Without evidence or with missing scope the answer abstains; else it is the claims behind a lead."""
    cited = cite(claims_for(intents, evidence, conflicts, careful), evidence)
    listed = F.array_sort(F.collect_list(F.struct("claim_no", "claim", "supported", "support", F.col("chunk_id").cast("string").alias("chunk_id"), "support_span")))
    body = cited.groupBy("query_id").agg(listed.cast(CLAIMS).alias("found")).withColumn("body", F.array_join("found.claim", " ")).join(groundedness(cited), "query_id")
    out = intents.select("query_id", "normalized", "task_type", "missing_scope").join(body, "query_id", "left")
    tension = F.lit("")
    if conflicts is not None:
        out = out.join(conflicts.groupBy("query_id").agg(F.count("*").alias("n_conflicts")), "query_id", "left")
        tension = F.when(F.coalesce("n_conflicts", F.lit(0)) > 0, fixed.TENSION).otherwise("")
    ask = F.concat(F.lit(fixed.ASK_SCOPE), F.array_join("missing_scope", ", "), F.lit("."))
    lead = F.concat(F.when(F.col("task_type") == "comparison", fixed.COMPARISON_LEAD).otherwise(fixed.LEAD), F.rtrim(F.rtrim("normalized"), F.lit("?")), F.lit(". "))
    none, open_ = F.col("body").isNull(), F.size("missing_scope") > 0
    alone = lambda text_: F.array(F.struct(F.lit(1), text_, F.lit(False), F.lit(None), F.lit(None), F.lit(None))).cast(CLAIMS)
    return out.select(
        "query_id", F.when(none, fixed.NO_EVIDENCE).when(open_, ask).otherwise(F.concat(lead, "body", tension)).alias("answer_text"), (none | open_).alias("abstained"),
        F.when(~none & open_, ask).alias("clarification"), F.when(none | open_, F.lit(0.0)).otherwise(F.col("groundedness")).alias("groundedness"),
        F.when(none, alone(F.lit(fixed.NO_MATERIAL))).when(open_, alone(ask)).otherwise(F.col("found")).alias("claims"),
    )


def closed_book(queries: DataFrame, column: str = "text") -> DataFrame:
    """queries with the answer from a fixed list of facts, else abstaining."""
    key = F.rtrim(F.lower(F.btrim(column)), F.lit("?"))
    facts = F.create_map(*(F.lit(x) for kv in fixed.FACTS.items() for x in kv))
    return queries.withColumn("answer_text", F.try_element_at(facts, key)).withColumn("abstained", F.col("answer_text").isNull())
