"""run() against plain Python versions of its stages over the smallest tables; the classifier's decisions are its own."""

import hashlib
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from scriptorium.llm import bpe, quality
from scriptorium.llm._common import tokenizer_path

from .test_operators import LOWER, reference_components, reference_lines

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.classify(docs, quality.train(docs, labels)).where("predicted = 1").select("doc_id", "text").collect()
    assert 0.5 * docs.count() < len(kept) < docs.count()
    rows = [(i, text) for i, _, _, text in reference_lines([(r.doc_id, r.text) for r in kept])]
    alive = {i for i, _, _, keep in reference_components(rows) if keep}
    rows = [(i, t) for i, t in rows if i in alive]
    norm = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: norm.findall((t or "").translate(LOWER))
    patterns = {}
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = of(r.text)
        for k in range(max(1, len(w) - 12) if w else 0):
            patterns.setdefault(len(w[k : k + 13]), set()).add(tuple(w[k : k + 13]))

    def clean(text):
        w, hit = of(text), set()
        for n, ps in patterns.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in ps:
                    hit |= set(range(k, k + n))
        return not (hit and 20 * len(hit) >= len(w))

    t, want = Tokenizer.from_file(tokenizer_path(bpe.TOKENIZER)), Counter()
    for i, text in rows:
        if clean(text):
            ids = t.encode(text, add_special_tokens=False).ids
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "a text", "en", "s", 6, "more"), (None, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, DATA).columns == docs.columns and stage(spark, docs, DATA).count() == 2
