"""Operators on small fixtures of our own."""

import csv
import hashlib
import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import answer, documents, evaluation, intent, memory, retrieval, search
from scriptorium.streaming import spans


def test_front_matter(spark):
    raw = ["---\na: 1\nb: x: y\na: 2\nnothing\nc:\n---\nbody\nmore", "no block", "---\r\nk: v\r\n---\r\nb"]
    got = documents.front_matter(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    assert got[0].metadata == {"a": "2", "b": "x: y", "c": ""} and got[0].body == "body\nmore"
    assert got[1].metadata == {} and got[1].body == "no block" and got[2].metadata == {"k": "v"}


def test_sections_tables_and_chunks(spark):
    body = "intro\n# One\ntext\n## Empty\n### Table\n| a | b |\n|---|---|\n| 1 | 2 |\n\n| only one |\n| 3 | 4 |\n####### seven\n"
    docs = spark.createDataFrame([("d", body), ("h", "# just a heading")], "doc_id string, text string")
    s = documents.sections(docs).orderBy("doc_id", "section_order").collect()
    assert [(x.doc_id, x.section) for x in s] == [("d", "Body"), ("d", "One"), ("d", "Table"), ("h", "Body")]
    t = documents.table_rows(documents.sections(docs)).orderBy("row_order").collect()
    assert [(x.section, x.body) for x in t] == [("Table table row", "a: 1; b: 2"), ("Table table row", "a: 3; b: 4")]


@pytest.mark.parametrize("n", [1, 120, 121, 216, 217, 500])
def test_token_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = documents.windows(spark.createDataFrame([(" ".join(words),)], "body string"), by_lines=False).orderBy("window_order").collect()
    starts, s = [], 0
    while True:
        starts.append(s)
        if s + 120 >= n:
            break
        s += 96
    assert [r.window.split() for r in df] == [words[s : s + 120] for s in starts]


def test_line_windows_against_all_lines(spark):
    """Also that a text's tokens are not copied to its windows."""
    r = random.Random(5)
    say = lambda n: " ".join(r.choice([f"w{r.randint(0, 300)}", f"N{k}", "ä-b:c", "—"]) for k in range(n))
    texts = [("\n" if k % 2 else "\r\n ").join(say(r.randint(0, 30)) for _ in range(r.choice([0, 3, 40, 90]))) for k in range(200)] + [None, "", "a" + " b" * 119, "a" + " b" * 120, "\n".join(["x y z"] * 500)]
    df = documents.windows(spark.createDataFrame(list(enumerate(texts)), "doc_id int, body string").coalesce(1)).select("doc_id", "window_order", "window")
    want, words = [], lambda x: [w.lower() for w in re.findall("[A-Za-z0-9][A-Za-z0-9._:/-]*", x)]
    for i, x in enumerate(texts):
        t, lines = words(x or ""), [s.strip() for s in (x or "").splitlines() if s.strip()]
        if len(t) <= 120:
            want.append((i, 0, None if x is None else x.strip()))
            continue
        for n, s in enumerate(range(0, math.ceil((len(t) - 120) / 96) * 96 + 1, 96)):
            mine = set(t[s : s + 120])
            want.append((i, n, " ".join([y for y in lines if mine & set(words(y))][:5])))
    assert sorted(map(tuple, df.collect())) == want and len(want) > 800
    plan = plan_of(df)
    assert "posexplode(_w" in plan and plan.count("ArrowEvalPython") == 1


def test_duplicates(spark):
    base = [f"t{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:-4] + ["x1", "x2"]), " ".join(base[:80]), "the and for", ""]
    docs = spark.createDataFrame([(f"d{i}", "T", "P", t, i) for i, t in enumerate(texts)], "doc_id string, title string, product string, text string, ordinal int")
    exact = {r.doc_id: r.duplicate_of for r in documents.exact_duplicates(docs).collect()}
    assert exact["d1"] == "d0" and all(v is None for k, v in exact.items() if k != "d1")
    near = {r.doc_id: (r.near_duplicate_of, r.similarity) for r in documents.near_duplicates(docs).collect()}
    assert near["d1"] == ("d0", 1.0) and near["d2"][0] == "d0" and "d3" not in near and near["d5"][0] == "d4"


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(rng.randint(5, 60))]
        for _ in range(4):
            words = [w for w in base if rng.random() > 0.04] + [f"r{rng.randint(0, 9)}"] * rng.randint(0, 2)
            rows.append((len(rows), "t", " ".join(words), len(rows)))
    docs = spark.createDataFrame(rows, "doc_id int, title string, text string, ordinal int")
    sets = {r[0]: set(r[2].split()) | {"t"} for r in rows}
    want = {}
    for b in sets:
        for a in range(b):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.92:
                want[b] = a
                break
    assert {r.doc_id: r.near_duplicate_of for r in documents.near_duplicates(docs).collect()} == want


def test_a_cluster_of_variants_gives_no_pairs(spark):
    n = 5000
    base = " ".join(f"word{k}" for k in range(60))
    docs = spark.range(n).select(F.format_string("d%05d", "id").alias("doc_id"), F.lit("t").alias("title"), F.concat(F.lit(base + " own"), F.col("id").cast("string")).alias("text"), F.col("id").alias("ordinal"))
    found = documents.near_duplicates(docs).collect()
    assert len(found) == n - 1 and {r.near_duplicate_of for r in found} == {"d00000"}


def test_index_of_a_query_sets_terms_alone(spark):
    chunks = spark.createDataFrame([(1, "T", "alpha beta beta"), (2, "U", "gamma alpha"), (3, "V", ""), (4, None, None)], "chunk_id long, title string, text string")
    q = spark.createDataFrame([("q", "beta gamma beta nothing")], "query_id string, text string")
    whole, part = (search.bm25_search(q, search.bm25_index(chunks, only=only), 5) for only in (None, search.query_terms(q)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, part.collect())) and part.count() == 2


def test_csv_rows(spark):
    docs = spark.createDataFrame([("c", 'a,b\n1,"x, y"\n\n2')], "doc_id string, text string")
    got = documents.csv_rows(docs).orderBy("nth").collect()
    assert [(r.nth, r.head, r.cells) for r in got] == [(1, ["a", "b"], ["1", "x, y"]), (2, ["a", "b"], ["2", None])]


def test_csv_records_against_the_csv_module(spark):
    r = random.Random(7)
    texts = ["".join(r.choice('ab",,""\n\n \r\'\\\t') for _ in range(r.randrange(0, 40))) for _ in range(1500)]
    texts += ["", None, 'a\n"', "h,h\n1", 'x,y\n"' + '""' * 20000 + 'end\n"' * 3 + ",2,3", "a\n" + "b," * 20000, "q\n" + '"z\n' * 5001]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = {(i, n): cells for i, t in enumerate(texts) for n, cells in enumerate(c for c in csv.reader((t or "").splitlines()) if c)}
    got = documents.csv_records(docs).collect()
    order = sorted((x.doc_id, x.record, x.cells) for x in got)
    numbered = {(i, n): cells for i, of in itertools.groupby(order, lambda x: x[0]) for n, (_, _, cells) in enumerate(of)}
    assert numbered == want
    named = {}
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").splitlines()]
        while lines and not lines[0]:
            lines = lines[1:]
        for n, row in enumerate(csv.DictReader(lines), 1):
            named[i, n] = "; ".join(f"{k}: {v}" for k, v in row.items())
    rows = documents.csv_rows(docs).select("doc_id", "nth", documents.csv_fields().alias("s")).collect()
    assert {(x.doc_id, x.nth): x.s for x in rows} == named



def test_ann_falls_back_to_exact_within_eligible(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 1.0])], "chunk_id int, vector array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, vector array<double>")
    members = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "chunk_id int, class_id string")
    only = search.Visible(members, spark.createDataFrame([("q", "b")], "query_id string, class_id string"))
    planes = [[[1.0, 0.0]]]
    assert [r.chunk_id for r in search.ann_search(q, v, 5, planes, 1, only, probes=1).collect()] == [2]
    none = search.Visible(members, spark.createDataFrame([], "query_id string, class_id string"))
    assert search.ann_search(q, v, 5, planes, 1, none).count() == 0


@pytest.mark.parametrize("names", ["long", "string"])
def test_dense_search_against_all_pairs(spark, names, monkeypatch):
    """Ties, zero vectors, nulls, repeated rows, more queries than a tile, visibility."""
    monkeypatch.setattr(search, "TILE", 7)
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    r = random.Random(3)
    vec = lambda: [r.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(4)]
    rows = [(k if names == "long" else f"é{k}", vec(), r.choice("abc")) for k in range(150)] + [(900 if names == "long" else "z", None, "a")]
    queries = [(k, vec()) for k in range(30)] + [(31, [0.0] * 4), (32, None)]
    seen = [(k, c) for k, _ in queries for c in "abc" if r.random() < 0.5]
    df = spark.createDataFrame(rows, f"chunk_id {names}, vector array<double>, class_id string").repartition(4)
    q = spark.createDataFrame(queries, "query_id int, vector array<double>")
    visible = search.Visible(df.select("chunk_id", "class_id"), spark.createDataFrame(seen, "query_id int, class_id string"))

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    for allowed in (None, set(seen)):
        want = set()
        for i, a in queries:
            found = sorted((-cosine(a, b), name) for name, b, c in rows if a and b and (allowed is None or (i, c) in allowed))
            want |= {(i, name, rank, -s + 0.0) for rank, (s, name) in enumerate(found[:6], 1)}
        out = search.dense_search(q, df.select("chunk_id", "vector"), 6, None if allowed is None else visible)
        assert {(x.query_id, x.chunk_id, x.rank, round(x.score, 9) + 0.0) for x in out.collect()} == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert search.dense_search(q.limit(0), df.select("chunk_id", "vector"), 6).count() == 0


def test_probes_go_to_the_nearest_buckets(spark):
    r = random.Random(9)
    planes = [[[r.uniform(-1, 1) for _ in range(3)] for _ in range(4)] for _ in range(2)]
    vec = lambda: [r.uniform(-1, 1) for _ in range(3)]
    rows, queries = [(k, vec()) for k in range(60)], [(k, vec()) for k in range(5)]
    side = lambda p, v: sum(x * y for x, y in zip(p, v)) / sum(x * x for x in p) ** 0.5
    want = set()
    for i, a in queries:
        for table in planes:
            near = sorted((round(sum(side(p, a) ** 2 for j, p in enumerate(table) if m >> (3 - j) & 1), 9), m) for m in range(16))[:5]
            own = sum((side(p, a) >= 0) << (3 - j) for j, p in enumerate(table))
            buckets = {own ^ m for _, m in near}
            want |= {(i, k) for k, b in rows if sum((side(p, b) >= 0) << (3 - j) for j, p in enumerate(table)) in buckets}
    got = search.lsh_candidates(spark.createDataFrame(queries, "query_id int, vector array<double>"), spark.createDataFrame(rows, "chunk_id int, vector array<double>"), planes, 2, 5)
    assert {tuple(x) for x in got.collect()} == want


def test_visibility_has_a_row_per_class(spark):
    n = 3000
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int"))
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), pick("public", "internal").alias("disclosure"), (F.col("id") % 7 / 7).alias("trust_score"), pick("", "V14", None).alias("product"), pick("EU", "global").alias("region"), F.lit("").alias("effective_date"), F.array(F.lit("x")).alias("allowed_roles"))
    queries = spark.range(10_000).select(F.col("id").alias("query_id"), F.array(F.lit("public")).alias("allowed"), F.lit("external").alias("role"), pick("V14", "X12").alias("product"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("disclosure"), F.lit(None).cast("string").alias("after_date"))
    visible = retrieval.visibility(queries, chunks)
    assert visible.seen.count() <= 10_000 * 24
    found = spark.createDataFrame([(0, k) for k in range(n)] + [(1, k) for k in range(n)], "query_id long, chunk_id long")
    got = {tuple(r) for r in visible.only(found).collect()}
    assert got == {(i, k) for i in (0, 1) for k in range(n) if k % 2 == 0 and k % 7 / 7 >= 0.4 and (k % 3 != 1 or i == 0)}


def test_pack_is_first_fit(spark):
    sizes = [300, 200, 100]
    rows = [("q", i + 1, f"c{i}", "d", "s", " ".join(["w"] * (n - 2)) + ".", ["w"]) for i, n in enumerate(sizes)]
    hits = spark.createDataFrame(rows, "query_id string, final_rank int, chunk_id string, doc_id string, section string, text string, q_tokens array<string>")
    p = retrieval.pack(hits).first()
    assert p.chunk_ids == ["c0", "c2"] and p.token_count == 400


def test_rerank_equals_a_walk(spark):
    rng = random.Random(1)
    rows = [("q", i, f"d{rng.randint(0, 3)}", round(rng.uniform(0, 0.4), 3)) for i in range(30)]
    hits = spark.createDataFrame([(*r, "none", ["x"], [], None, None, "p", "r", "reference", "active", 1.0, 1.0) for r in rows], "query_id string, chunk_id int, doc_id string, score double, text string, q_tokens array<string>, q_identifiers array<string>, q_product string, q_region string, product string, region string, authority string, status string, quality_score double, trust_score double")
    seen, want = set(), []
    for _, i, d, s in sorted(rows, key=lambda r: (-r[3], r[1])):
        s -= 0.15 * (d in seen)
        if s >= 0:
            want.append((i, pytest.approx(s)))
            seen.add(d)
    got = [(r.chunk_id, r.final_score) for r in retrieval.rerank(hits).orderBy("final_rank").collect()]
    assert got == want[:5]


def test_intents(spark):
    q = ["Where is the rollback procedure for X12?", "Compare the V14 seal bulletin and the latest policy in Poland after May 2024", "why did it fail and which supplier", "What are the latest distributor warranty terms?", "phoenix"]
    got = intent.infer(spark.createDataFrame([(i, x) for i, x in enumerate(q)], "query_id int, text string")).orderBy("query_id").collect()
    assert [r.task_type for r in got] == ["procedural", "comparison", "multi_hop", "lookup", "lookup"]
    assert got[0].product == "X12" and got[0].expansions[0] == "credential recovery"
    assert got[1].region == "Poland" and got[1].after_date == "2024-05-01" and len(got[1].subqueries) == 2 and got[1].missing_scope == []
    assert got[3].missing_scope == ["region", "policy family"] and len(got[3].ambiguous_options) == 3 and len(got[4].ambiguous_options) == 3


def test_support_and_citation(spark):
    df = spark.createDataFrame([("torque is 0.48 now", "the torque is 0.48 now"), ("torque is 0.48", "torque is 0.52"), ("", "x")], "c string, s string")
    a, b, c = (r[0] for r in df.select(answer.support_score("c", "s")).collect())
    assert a == pytest.approx(1.0) and b == pytest.approx(0.7 * 2 / 3) and c == 0.0
    ev = spark.createDataFrame([("q", 1, "c1", "d1", "T", "S", "Nothing here. Torque is 0.48 now.")], "query_id string, rank int, chunk_id string, doc_id string, title string, section string, text string")
    claims = spark.createDataFrame([("q", 1, "Torque is 0.48 now."), ("q", 2, "unrelated zebra 7")], "query_id string, claim_no int, claim string")
    one, two = answer.cite(claims, ev).orderBy("claim_no").collect()
    assert one.supported and one.support_span == "Torque is 0.48 now." and not two.supported and two.note


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("q", "x", 4)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", "b", 1), ("q", "c", 1)], "query_id string, doc_id string, relevance int")
    m = evaluation.ranking_metrics(hits, rel).first()
    assert m.recall == 0.5 and m.precision == 0.25 and m.mrr == pytest.approx(1 / 3) and m.ndcg == pytest.approx(0.5 / (1 + 1 / 1.584962500721156))


def test_memory(spark):
    m = spark.createDataFrame([("s", "product", "V14", 1), ("s", "product", "X12", 2), ("t", "region", "EU", 1)], "session_id string, key string, value string, seq int")
    i = spark.createDataFrame([("s", None, "EU"), ("u", None, None)], "session_id string, product string, region string")
    assert {(r.session_id, r.product, r.region) for r in memory.apply_to(i, m).collect()} == {("s", "X12", "EU"), ("u", None, None)}
    assert memory.upsert(m, spark.createDataFrame([("t", "region", "PL", 9)], m.schema)).count() == 2


def test_rules_reach_every_branch(spark):
    """The fixtures of the registered rule queries are not all alike in any column."""
    from scriptorium import rules

    d = "/root/testdata/sf0.001"
    texts = rules.text_rules(spark, d).collect()
    assert len({r.trust for r in texts}) > 3 and len({r.quality for r in texts}) > 3 and len({r.reason for r in texts}) > 4 and {r.kept for r in texts} == {True, False}
    asked = rules.question_rules(spark, d).collect()
    assert {r.route for r in asked} == {"structured_then_policy", "sparse_first", "hybrid_plus_careful", "cheap_default"}
    assert {r.task_type for r in asked} == {"comparison", "procedural", "structured", "multi_hop", "lookup"} and len({r.plan for r in asked}) == 6
    for c in ("region", "product", "disclosure", "after_date", "expansions", "ambiguous_options", "missing_scope", "subqueries", "notes"):
        assert len({r[c] for r in asked}) > 1


def test_ann_recall(spark):
    from scriptorium import catalog

    r = catalog.queries()["ann_recall"](spark, "/root/testdata/sf0.01").first()
    assert r.recall >= 0.9 and r.wanted == 250


def test_equal_texts_of_a_hot_class(spark):
    rows = [(i, "T", "p", "same" if i % 3 else f"t{i}", i) for i in range(4500)]
    got = documents.exact_duplicates(spark.createDataFrame(rows, "doc_id int, title string, product string, text string, ordinal int")).collect()
    assert len(got) == 4500 and {r.doc_id: r.duplicate_of for r in got} == {i: 1 if i % 3 and i > 1 else None for i in range(4500)}


def test_following_ends_in_circles_and_at_hidden_documents(spark):
    docs = {"IR-1": ["IR-2"], "IR-2": ["IR-3", "IR-9"], "IR-3": ["IR-1", "IR-4"], "IR-4": ["IR-5"], "IR-5": [], "IR-9": ["IR-8"], "IR-8": []}
    chunks = spark.createDataFrame([(f"{i}:{n}", i, refs if n == 0 else None, "see IR-7" if i == "IR-5" else "") for i, refs in docs.items() for n in (0, 1)], "chunk_id string, doc_id string, references array<string>, text string")
    seen = search.Visible(chunks.select("chunk_id", F.when(F.col("doc_id") == "IR-9", "hidden").otherwise("all").alias("class_id")), spark.createDataFrame([("q", "all"), ("r", "all"), ("r", "hidden")], "query_id string, class_id string"))
    hits = chunks.where("chunk_id = 'IR-1:0'").withColumn("query_id", F.explode(F.array(F.lit("q"), F.lit("r"))))
    got = {(r.query_id, r.chunk_id): r.hop for r in retrieval.follow_references(hits, chunks, seen, 3).collect()}
    for_all = {"IR-2": 1, "IR-3": 2, "IR-1": 3, "IR-4": 3}
    want = {(q, f"{i}:{n}"): h for q in "qr" for i, h in for_all.items() for n in (0, 1)} | {("r", f"{i}:{n}"): h for i, h in {"IR-9": 2, "IR-8": 3}.items() for n in (0, 1)}
    assert got == want
    ranked = hits.withColumns({"final_rank": F.lit(1), "final_score": F.lit(0.5), "q_tokens": F.array(F.lit("t")), "reasons": F.array().cast("array<string>")})
    every = retrieval.with_followed(ranked, retrieval.follow_references(hits, chunks, seen, 3), chunks).where("query_id = 'r'").orderBy("final_rank").collect()
    assert [(r.final_rank, r.chunk_id, r.q_tokens) for r in every] == [(1, "IR-1:0", ["t"]), (2, "IR-2:0", ["t"]), (3, "IR-2:1", ["t"]), (4, "IR-3:0", ["t"])]


def test_memory_recall_and_forgetting(spark):
    m = spark.createDataFrame(
        [("s", "product", "V14", "session", 1), ("s", "region", "EU", "profile", 1), ("t", "product", "X12", "task", 1), ("t", "region", "PL", "task", 2), ("t", "tone", "short", "profile", 1), ("u", "product", "V14", "task", 1), ("u", "product", None, "task", 2), (None, "product", "V14", "task", 1)],
        "session_id string, key string, value string, scope string, seq int",
    )
    i = spark.createDataFrame(
        [(1, "s", "Torque of the V14?", None, None), (2, "t", "Torque of the r-12?", None, None), (3, "t", "Torque of the r-12?", "R-12", "EU"), (4, "u", "x12", None, None), (5, None, "x12", None, None), (6, "t", None, None, None)],
        "n int, session_id string, normalized string, product string, region string",
    )
    got = memory.recall(i, m)
    rows = {r.n: (r.product, r.region, r.remembered, r.conflict) for r in got.collect()}
    # A region of the profile is not taken; a forgotten product and a null session give nothing.
    assert rows == {1: ("V14", None, ["product=V14"], False), 2: ("X12", "PL", ["product=X12", "region=PL"], True), 3: ("R-12", "EU", [], False), 4: (None, None, [], False), 5: (None, None, [], False), 6: ("X12", "PL", ["product=X12", "region=PL"], False)}
    left = memory.forget(m, got.where("conflict"))
    assert {(r.session_id, r.key) for r in left.collect()} == {("s", "product"), ("s", "region"), ("t", "tone"), (None, "product")}
    assert memory.recall(i.limit(0), m).count() == 0 and memory.recall(i, m.limit(0)).where("size(remembered) > 0").count() == 0


def test_spans_close_time_out_and_nest(spark):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    rows = [
        ("a", "1", None, "request", "start", at(0)), ("a", "2", "1", "search", "start", at(1)), ("a", "2", "1", "search", "event", at(2)), ("a", "2", "1", "search", "end", at(4)), ("a", "3", "1", "answer", "start", at(5)),
        ("a", "3", "1", "answer", "end", at(6)), ("a", "1", None, "request", "end", at(10)), ("a", "3", "1", "answer", "start", at(200)), ("b", "1", None, "request", "start", at(0)), ("b", "1", None, "request", "end", at(60)),
        ("b", "1", None, "request", "end", None), (None, "1", None, "odd", "end", at(3)), (None, "1", None, "odd", "start", at(4)), ("c", "1", None, "tie", "start", at(7)), ("c", "1", None, "tie", "end", at(7)),
    ]
    r = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, kind string, t string").select("*", F.to_timestamp("t").alias("ts"), F.lit(1).alias("salt"), F.lit(2).alias("w"))
    got = spans.self_times(spans.close_spans(r, "30 minutes"))
    assert got.count() == 8
    by = {(x.trace_id, x.span_id, x.started_at and x.started_at.hour * 60 + x.started_at.minute): (x.status, x.duration_ms, x.events, x.children, x.self_ms) for x in got.collect()}
    minute = 60000.0
    assert by["a", "1", 0] == ("closed", 10 * minute, 0, 2, 6 * minute) and by["a", "2", 1] == ("closed", 3 * minute, 1, 0, 3 * minute) and by["a", "3", 5] == ("closed", minute, 0, 0, minute)
    # Later records of an id are another row; an end after the timeout has lost its start.
    assert by["a", "3", 200] == ("timed_out", None, 0, 0, None) and by["b", "1", 0][0] == "timed_out" and by["b", "1", None][0] == "orphan"
    assert by[None, "1", 4][0] == "timed_out" and by["c", "1", 7][:2] == ("closed", 0.0)
    assert spans.self_times(spans.close_spans(r.limit(0))).count() == 0


def test_spans_of_a_hot_parent(spark):
    s = "2024-01-01 00:00:00"
    kids = spark.range(4000).select(F.lit("a").alias("trace_id"), F.concat(F.lit("k"), "id").alias("span_id"), F.lit("p").alias("parent_id"), F.lit("n").alias("name"), F.expr(f"timestamp'{s}' + make_dt_interval(0, 0, 0, id / 1000)").alias("at"))
    rows = kids.select("trace_id", "span_id", "parent_id", "name", F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("at").alias("ts")), F.struct(F.lit("end").alias("kind"), (F.col("at") + F.expr("interval 1 millisecond")).alias("ts")))).alias("e")).select("trace_id", "span_id", "parent_id", "name", "e.*")
    parent = spark.sql(f"SELECT 'a' AS trace_id, 'p' AS span_id, CAST(NULL AS STRING) AS parent_id, 'n' AS name, kind, timestamp'{s}' + make_dt_interval(0, 0, 0, n) AS ts FROM VALUES ('start', 0), ('end', 10) AS v(kind, n)")
    top = spans.self_times(spans.close_spans(rows.unionByName(parent))).where("span_id = 'p'").first()
    assert (top.children, top.children_ms, top.self_ms) == (4000, 4000.0, 6000.0)


def test_spans_over_growing_input(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def add(name, rows):
        (src / name).write_text("\n".join(json.dumps(dict(zip(("trace_id", "span_id", "name", "kind", "ts"), r))) for r in rows))
        spans.start(spark, str(src), out, str(tmp_path / "ck")).awaitTermination()
        return {(r.trace_id, r.span_id, r.status, r.duration_ms) for r in spark.read.parquet(out).collect()}

    first = add("1.json", [("a", "1", "n", "start", "2024-01-01T00:00:00Z"), ("b", "1", "n", "start", "2024-01-01T00:05:00Z")])
    assert first == set()
    # The end of a comes with the second run, b never ends, c may still go on.
    second = add("2.json", [("a", "1", "n", "end", "2024-01-01T00:10:00Z"), ("c", "1", "n", "start", "2024-01-01T05:00:00Z")])
    assert second == {("a", "1", "closed", 600000.0), ("b", "1", "timed_out", None)}
    assert add("3.json", [("d", "1", "n", "start", "2024-01-01T05:01:00Z")]) == second


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_vectors_are_made_without_a_shuffle(spark):
    """The features counted one by one; a term that is a trigram too counts with it."""
    texts = ["the cat and the hat", "A é ß – x  y\n\n\n\nz the", "", None, "aa " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = search.hash_embed(df, "k")
    assert "Exchange" not in plan_of(out)
    features = {r.k: (r.t or []) + (r.g or []) for r in df.select("k", text.tokenize("text").alias("t"), text.char_ngrams("text").alias("g")).collect()}
    for r in out.collect():
        want = [0.0] * 192
        for f in set(features[r.k]):
            h = int(hashlib.sha256(f.encode()).hexdigest(), 16)
            want[h % 192] += (-1 if h & 256 else 1) * (1 + math.log(features[r.k].count(f)))
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert r.vector == pytest.approx([x / norm for x in want], abs=1e-12)


def test_search_of_a_known_query_set_shuffles_no_pairs(spark, monkeypatch):
    """Frequent and rare terms, several tiles and blocks, classes: as by joining the postings, with one row of each query
    and task shuffled."""
    for name, value in {"TILE": 7, "ROWS": 11, "QUERY_BLOCK": 20, "HEAVY": 3}.items():
        monkeypatch.setattr(search, name, value)
    r = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    say = lambda n: " ".join(words[min(int(r.expovariate(0.15)), 39)] for _ in range(n))
    chunks = spark.createDataFrame([(f"c{k}", "T", say(r.randint(0, 30))) for k in range(120)], "chunk_id string, title string, text string").repartition(3)
    q = spark.createDataFrame([(k, say(r.randint(1, 8))) for k in range(50)] + [(77, "none of these")], "query_id int, text string")
    visible = search.Visible(chunks.select("chunk_id", F.substring("chunk_id", 2, 1).alias("class_id")), q.selectExpr("query_id", "string(query_id % 9) AS class_id"))
    whole, part = search.bm25_index(chunks), search.bm25_index(chunks, only=search.query_terms(q))
    for eligible in (None, visible):
        want, got = (search.bm25_search(q, i, 4, eligible=eligible) for i in (whole, part))
        rounded = lambda df: sorted((x.query_id, x.chunk_id, x["rank"], round(x.score, 8)) for x in df.collect())
        assert rounded(got) == rounded(want) != []
    assert plan_of(search.bm25_search(q.limit(10), part, 4)).count("Exchange") <= 1


def test_a_query_set_of_many_terms_is_not_joined_with_postings(spark, monkeypatch):
    """As with few terms: a row of each query and task is shuffled, and tasks do not grow in number with the chunks."""
    for name, value in {"TILE": 7, "ROWS": 11, "QUERY_BLOCK": 20, "HEAVY": 3, "TERMS_BROADCAST": 9, "TERMS_BLOCK": 60, "READERS": 1}.items():
        monkeypatch.setattr(search, name, value, raising=False)
    r = random.Random(8)
    words = [f"W{k}" for k in range(60)]
    say = lambda n: " ".join(words[min(int(r.expovariate(0.1)), 59)] for _ in range(n))
    chunks = spark.createDataFrame([(k, "T", say(r.randint(0, 30)) + f" only{k}") for k in range(120)] + [(130, None, None), (131, "", "")], "chunk_id long, title string, text string").repartition(13)
    q = spark.createDataFrame([(f"q{k}", say(r.randint(1, 8))) for k in range(50)] + [("none", "none of these"), ("empty", "")], "query_id string, text string")
    visible = search.Visible(chunks.select("chunk_id", (F.col("chunk_id") % 10).alias("class_id")), q.selectExpr("query_id", "hash(query_id) % 9 AS class_id"))
    whole, part = search.bm25_index(chunks), search.bm25_index(chunks, only=search.query_terms(q))
    assert part.postings is None and part.packed.count() == 122
    rounded = lambda df: sorted((x.query_id, x.chunk_id, x["rank"], round(x.score, 8)) for x in df.collect())
    for eligible in (None, visible):
        want, got = (search.bm25_search(q, i, 4, eligible=eligible) for i in (whole, part))
        assert rounded(got) == rounded(want) != []
    found = search.bm25_search(q, part, 4)
    assert plan_of(found).count("Exchange") == 1 and "Join" not in plan_of(found) and "Coalesce" in plan_of(found)


def test_chunks_of_few_hits_are_not_shuffled(spark):
    chunks = spark.createDataFrame([(k, "T", f"alpha w{k} ÀB Beta-{k}", f"d{k}", ["d2"]) for k in range(9)], "chunk_id long, title string, text string, doc_id string, references array<string>")
    q = spark.createDataFrame([("q", "W3 beta-3 àb nothing"), ("r", "ALPHA")], "query_id string, text string")
    found = search.bm25_search(q, search.bm25_index(chunks, only=search.query_terms(q)), 2)
    hits = search.with_chunks(found, chunks)
    everyone = search.Visible(chunks.select("chunk_id", F.lit(1).alias("class_id")), q.select("query_id", F.lit(1).alias("class_id")))
    followed = retrieval.follow_references(hits, chunks, everyone)
    assert "Exchange hashpartitioning(chunk_id" not in plan_of(hits) and "Exchange hashpartitioning(doc_id" not in plan_of(followed)
    assert {(r.query_id, r.chunk_id, r.text[:8]) for r in hits.collect() if r["rank"] == 1} == {("q", 3, "alpha w3"), ("r", 0, "alpha w0")}


def test_terms_are_counted_without_a_row_per_chunk(spark):
    chunks = spark.createDataFrame([(1, "T", "alpha beta beta"), (2, "U", "gamma alpha"), (3, "V", ""), (4, None, None)], "chunk_id long, title string, text string")
    out = search.term_statistics(chunks)
    assert plan_of(out).count("Exchange") == 1
    assert {r.term: (r.df, r.cf, r.longest) for r in out.collect()} == {"alpha": (2, 2, 4), "beta": (1, 2, 4), "gamma": (1, 1, 3), "t": (1, 1, 4), "u": (1, 1, 3), "v": (1, 1, 1)}


def test_lsh_candidates_are_no_rows(spark, monkeypatch):
    for name, value in {"TILE": 3, "ROWS": 8, "QUERY_BLOCK": 6}.items():
        monkeypatch.setattr(search, name, value)
    r = random.Random(5)
    vec = lambda: [r.uniform(-1, 1) for _ in range(6)]
    v = spark.createDataFrame([(k, vec()) for k in range(90)] + [(99, None)], "chunk_id int, vector array<double>").repartition(3)
    q = spark.createDataFrame([(k, vec()) for k in range(14)], "query_id int, vector array<double>")
    p = search.planes(6, 3, 5)
    pairs = search.lsh_candidates(q, v.where("vector is not null"), p, 3, 4)
    scored = pairs.join(q.withColumnRenamed("vector", "q"), "query_id").join(v, "chunk_id").withColumn("score", text.cosine("q", "vector"))
    rounded = lambda df: sorted((x.query_id, x.chunk_id, x["rank"], round(x.score, 8)) for x in df.collect())
    for stored in (None, search.lsh_buckets(v.where("vector is not null"), "chunk_id", p)):
        assert rounded(search.ann_search(q, v, 4, p, 3, probes=4, buckets=stored)) == rounded(search.top_k(scored, 4))
    assert search.lsh_scored(q, v, p, 3, 4).first().c == pairs.count()


def test_a_task_holds_few_scores_at_once():
    """4000 vectors against 2000 queries in one batch: 64 MB of scores, of which 4 are held at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    of = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(rng.normal(size=n * 8)), 8)
    task = search._best_of_task(5, pa.array(range(2000)), search._by_vectors(of(2000), search.TILE), None, None, search.TILE, search.ROWS, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), of(4000)], names=["chunk_id", "vector"])
    tracemalloc.start()
    found = sum(b.num_rows for b in task([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 10_000 and peak < 40_000_000


def test_sets_that_share_common_words_alone_give_no_pairs(spark):
    """Every word is in a tenth of the documents or more, so a prefix of rare words gave a row per two documents."""
    r = random.Random(6)
    rows = [(k, "t", " ".join(r.sample([f"w{j}" for j in range(400)], 60)), k) for k in range(400)]
    rows += [(k + 400, "t", rows[k][2].replace(rows[k][2].split()[5], "changed"), k + 400) for k in range(0, 400, 50)]
    sets = documents.set_classes(documents.token_sets(spark.createDataFrame(rows, "doc_id int, title string, text string, ordinal int")))
    signed = documents.signatures(sets)
    pairs = signed.alias("a").join(signed.alias("b"), F.expr("a.w = b.w and a.first < b.first")).selectExpr("a.first AS a", "b.first AS b").distinct().collect()
    assert len(pairs) < 20 and {(k, k + 400) for k in range(0, 400, 50)} <= {tuple(p) for p in pairs}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_signatures_miss_no_link(spark, threshold):
    r = random.Random(8)
    rows = []
    for g in range(25):
        base = [f"g{g}w{k}" for k in range(r.randint(1, 40))]
        rows += [(len(rows) + k, "t", " ".join(w for w in base if r.random() > 0.1), len(rows) + k) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id int, title string, text string, ordinal int")
    sets, want = {x[0]: set(x[2].split()) | {"t"} for x in rows}, {}
    for b in sets:
        near = [a for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold]
        want |= {b: near[0]} if near else {}
    assert {x.doc_id: x.near_duplicate_of for x in documents.near_duplicates(docs, threshold).collect()} == want


def test_metrics_by_class_need_no_row_per_judgement(spark):
    r = random.Random(9)
    label = {k: r.choice("abc") for k in range(40)}
    hits = [(q, d, n) for q in range(12) for n, d in enumerate(r.choices(range(40), k=8), 1)]
    h = spark.createDataFrame([(*x, label[x[1]]) for x in hits], "query_id int, doc_id int, rank int, label string")
    q = spark.createDataFrame([(k, r.choice("abcd")) for k in range(12)], "query_id int, label string")
    docs = spark.createDataFrame(list(label.items()), "doc_id int, label string")
    judged = q.join(docs, "label").select("query_id", "doc_id", F.lit(1).alias("relevance"))
    rounded = lambda df: sorted((x.query_id, *(round(y, 9) for y in x[1:])) for x in df.collect())
    assert rounded(evaluation.class_metrics(h, q, docs.groupBy("label").agg(F.count("*").alias("n_rel")))) == rounded(evaluation.ranking_metrics(h, judged))
