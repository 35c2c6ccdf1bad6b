"""The operators against plain Python versions, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import _kernels as K
from scriptorium.llm import bpe, decontaminate, fingerprint, html_text, language_model, line_dedup, near_dedup, quality, sharding, token_store
from scriptorium.llm._common import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORDS.findall((t or "").translate(LOWER))


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "é", "ação", "x1"] + [rng.choice("abcdef") + rng.choice(["th", "er", "on", "ß"]) * rng.randint(1, 3) for _ in range(60)]
    line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared = [line(12) for _ in range(4)]
    rows = []
    for i in range(n):
        base = "\n".join([line(rng.randint(1, 30)), rng.choice(shared), line(8)])
        rows.append((i, base))
        if i % 5 == 0:
            rows.append((1000 + i, base))
        if i % 7 == 0:
            rows.append((2000 + i, base + " extra"))
    rows += [(5000, None), (5001, ""), (5002, " \t\n "), (5003, "a b"), (5004, "a b"), (5005, "long " * 30_000), (None, "no id here at all"), (5006, "same row"), (5006, "same row"), (5007, "nbsp  here  two  x\r\n<|endoftext|>end İ K")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "src", 1, 2, "k") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, n_words int, score int, key string").repartition(3).cache()


def collect(df):
    return [r.asDict() for r in df.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# ---- kernels


def test_kernels():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aé \n\tB ") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    buf, off = K.buffers(pa.array(texts))
    start, end, row = K.spans(buf, off)
    data = buf.tobytes()
    assert [(r, data[a:b].decode()) for a, b, r in zip(start.tolist(), end.tolist(), row.tolist())] == [(i, w) for i, t in enumerate(texts) for w in WORDS.findall(t or "")]
    hashes = K.span_hashes(buf, start, end)
    of = {}
    for a, b, h in zip(start.tolist(), end.tolist(), hashes.tolist()):
        assert of.setdefault(data[a:b], h) == h
    assert len(set(of.values())) == len(of)
    for weak in (None, np.zeros(len(start), np.uint64), np.uint64(1) + (hashes & np.uint64(3))):
        first, inverse = K.equal_spans(buf, start, end, weak)
        own = [data[a:b] for a, b in zip(start.tolist(), end.tolist())]
        assert [own[first[k]] for k in inverse.tolist()] == own and len(first) == len(set(own))


def thue_morse(bits):
    """Two words that any polynomial in an odd base has the same value for modulo 2^64."""
    x = [0]
    for _ in range(bits):
        x += [1 - k for k in x]
    return "".join("ab"[k] for k in x), "".join("ba"[k] for k in x)


def test_words_are_told_apart_by_their_bytes():
    for pair in (thue_morse(10), thue_morse(12), ("x" * 300 + "a", "x" * 300 + "b"), ("y" * 40 + "a", "y" * 40 + "b")):
        for words_ in (list(pair), [*pair, *pair[::-1], pair[0][1:]]):
            buf, off = K.buffers(pa.array(words_))
            first, inverse = K.equal_spans(buf, off[:-1], off[1:])
            assert len(first) == len(set(words_)) and [words_[first[k]] for k in inverse.tolist()] == words_
            assert len(set(K.span_hashes(buf, off[:-1], off[1:]).tolist())) == len(set(words_))


# ---- 1


def reference_components(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    group = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            group[find(k)] = min(group.get(find(k), i), i)
    return Counter((i, len(sets[k]), None if i is None else group[find(k)], True if i is None else i == group[find(k)]) for k, (i, _) in enumerate(rows))


def test_near_duplicates(spark, docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == reference_components(corpus())
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_a_large_loose_group(spark):
    """Members resemble each other on both sides of the threshold; many others share a template below it."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"t{k}" for k in range(30)] + [f"o{i}x{k}" for k in range(8)])) for i in range(80)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == reference_components(rows)


# ---- 2


def test_main_text(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><div class='cookie-notice'>We use cookies</div><nav>menu</nav><article><h1>A &amp; B</h1><p>One<br>two  <b>bold</b>x<p>three<aside>side</aside><div class=comments>no</div></article><footer>f</footer>"
    rows = [(1, "http://a.org/1", page), (2, None, None), (3, "http://a.org/3", ""), (4, "x", "plain < text & more"), (1, "http://a.org/1", page)]
    rows += [(10 + i, f"https://b.org/{i}", f"<body><div>all pages of this site carry this very line of text</div><div><p>own words {i} {i * i} and {i + 7} more {i * 3}</p></div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\nOne\ntwo boldx\nthree" and got[2] == got[3] == "" and got[4] == "plain < text & more"
    assert all(got[10 + i] == f"own words {i} {i * i} and {i + 7} more {i * 3}" for i in range(8))
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_runs_are_counted_over_all_pages_of_a_host(spark):
    """However a host is split: what many pages repeat goes, also where a group has one page."""
    line = "this line is on a third of all pages of the host"
    own = lambda i: f"own words {i} {i * i} and {i + 7} more {i * 3}"
    rows = [(i, f"https://b.org/{i}", f"<body><div>{line if i % 3 == 0 else own(i + 1000)}</div><p>{own(i)}</p></body>") for i in range(60)]
    pages = spark.createDataFrame([*rows, rows[1], rows[1], rows[1]], "page_id long, url string, html string")
    for size in (500, 7, 1):
        got = {r.page_id: r.text for r in html_text.main_text(pages, group=size).collect()}
        assert got == {i: own(i) if i % 3 == 0 else own(i + 1000) + "\n" + own(i) for i in range(60)}


def test_boilerplate_of_few_pages_goes_and_copies_stay(spark):
    own = lambda i: f"own words {i} {i * i} and {i + 7} more {i * 3} {i} {i + 1} {i + 2} {i + 3}"
    line, text = "this line is on seven of all the pages of this host", " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"https://b.org/{i}", f"<div>{line if i < 7 else own(-i)}</div><p>{own(i)}</p>") for i in range(90)]
    rows += [(100 + i, f"https://b.org/c{i}", f"<p>{text}</p><p>copy {i}</p>") for i in range(5)]
    for size in (500, 20):
        got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group=size).collect()}
        assert all(got[i] == own(i) for i in range(7)) and all(got[i] == own(-i) + "\n" + own(i) for i in range(7, 90))
        assert all(got[100 + i] == f"{text}\ncopy {i}" for i in range(5))


def test_the_array_tells_the_template_inside_articles(spark):
    """A paragraph that texts share stays; what the host puts below each article goes, by its path."""
    own = lambda i: f"own words {i} {i * i} and {i + 7} more {i * 3} {i} {i + 1} {i + 2} {i + 3}"
    line, links = "this very paragraph of words is shared by many a text", "read more of our best and latest stories here"
    rows = [(i, f"https://b.org/{i}", f"<article><p>{own(i)}</p><p>{line}</p><p>Les.</p><div class='z9'>{links}</div></article><p>between</p><article>second {i}</article>") for i in range(9)]
    rows += [(20 + i, f"https://b.org/c{i}", f"<article><p>{own(50)}</p><p>{line}</p></article>") for i in range(9)]
    rows += [(40 + i, f"https://c.org/{i}", f"<article><p>{own(i)}</p><div class='z9'>{links} {i}</div></article>") for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    expected = {**{i: f"{own(i)}\n{line}\nLes.\nsecond {i}" for i in range(9)}, **{20 + i: f"{own(50)}\n{line}" for i in range(9)}, **{40 + i: f"{own(i)}\n{links} {i}" for i in range(2)}}
    for size in (500, 6):
        assert {r.page_id: r.text for r in html_text.main_text(pages, group=size).collect()} == expected
    off = {r.page_id: r.text for r in html_text.main_text(pages, least=10**6).collect()}
    assert all(off[i] == f"{own(i)}\n{line}\nLes.\n{links}\nsecond {i}" for i in range(9))


def test_main_text_with_extra_columns_and_long_pages(spark):
    page = "<article><h1>T</h1>" + "<p>some words of a long page</p>" * 40_000 + "</article>"
    rows = [(1, "http://a.org/1", page, "x", 3), (None, None, "<p>no id</p>", None, 4), (2, "http://a.org/2", "<p>" + "word " * 200_000, "y", 5)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, salt int")).collect()}
    assert got == {1: "T\n" + "\n".join(["some words of a long page"] * 40_000), None: "no id", 2: " ".join(["word"] * 200_000)}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_articles_are_documents(spark, sf):
    """What the registered query gives is, heading aside, a row of documents, line by line."""
    folder = f"/root/testdata/{sf}"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    flat = lambda t: "\n".join(x for x in (" ".join(line.split()) for line in (t or "").split("\n")) if x)
    texts = {flat(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()}
    rows = html_text.query(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows)
    assert [r.page_id for r in rows if not (r.text in texts or r.text.partition("\n")[2] in texts)] == []


def test_suffix_array():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 40, 200):
        for letters in (1, 2, 5):
            t = [rng.randrange(letters) for _ in range(n)]
            for depth in (None, 1, 3, 8):
                order, shared = html_text.suffix_array(np.array(t, np.int64), depth)
                cut = [tuple(t[k:][:depth]) for k in order.tolist()]
                assert cut == sorted(cut) and sorted(order.tolist()) == list(range(n))
                for k in range(1, n):
                    a, b = cut[k - 1], cut[k]
                    assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_packed_runs():
    rng = np.random.default_rng(1)
    for size in (0, 1, 1000):
        h, n = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64)), None
        n = rng.integers(1, 4, len(h))
        got, counts = html_text._unpacked(html_text._packed(h, n))
        assert (got == h).all() and (counts == n).all()


def test_repeated_runs_by_brute_force():
    rng = random.Random(2)
    streams = [np.array([rng.randrange(3) for _ in range(rng.randint(0, 40))]) for _ in range(9)]
    pages = np.array([0, 1, 2, 3, 4, 5, 6, 7, 7])
    got = html_text.repeated(streams, pages, 4, 3, 0.2)
    holders = {}
    for s, p in zip(streams, pages):
        for k in range(len(s) - 3):
            holders.setdefault(tuple(s[k : k + 4]), set()).add(p)
    for s, g in zip(streams, got):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - 3):
            if len(holders[tuple(s[k : k + 4])]) >= 3:
                want[k : k + 4] = True
        assert (g == want).all()


# ---- 3


def test_language_model(spark, docs):
    got = language_model.score(docs, head_words=20, rounds=1, rate=2).collect()
    rows = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c, n, ends = Counter(), 0, 0
    for i, t in rows:
        if not held(i):
            c.update(words(t))
            n += len(words(t)) + 1
            ends += 1
    whole = n + 0.1 * (len(c) + 2)
    want = {(i, t): (len(words(t)) + 1, sum(c[w] > 0 for w in words(t)) + 1, sum(math.log10((c[w] + 0.1) / whole) for w in words(t)) + math.log10((ends + 0.1) / whole)) for i, t in rows}
    assert len(got) == len(rows)
    by = {i: v for (i, _), v in want.items()}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*by[r.doc_id][:2], n, held(r.doc_id)) and r.base_score == pytest.approx(by[r.doc_id][2])
        assert r.score < 0
    assert language_model.score(empty(spark)).count() == 0


def test_model_is_trained_on_every_training_document(spark, docs, monkeypatch):
    monkeypatch.setattr(language_model, "START_DOCS", 2)
    train = docs.select("doc_id", "text")
    kept = bpe.distinct_words(train, language_model.word_chunks).cache()
    path = tokenizer_path(language_model.TOKENIZER)
    whole = sum(len(x) // 4 * r.n for r in kept.collect() for x in bpe.encode_words([b" " + bytes(r.word)], path)) + train.count()
    assert language_model.fit(train, kept, path).trained == whole
    monkeypatch.setattr(language_model, "HELD", 50)
    assert language_model.fit(train, kept, path, rounds=2, rate=3).trained == 2 * whole


def test_scores_do_not_depend_on_the_table_of_words(spark, docs):
    scores = lambda most: sorted((r.doc_id or -1, r.n_tokens, r.score) for r in language_model.score(docs, head_words=most).collect())
    whole = scores(500_000)
    for most in (0, 20):
        got = scores(most)
        assert [x[:2] for x in got] == [x[:2] for x in whole] and [x[2] for x in got] == pytest.approx([x[2] for x in whole])


def test_model_is_a_distribution_and_gradients_are_right():
    counts = np.random.default_rng(0).integers(0, 50, 3000).astype(float)
    classes = language_model.Classes(counts, (np.arange(3000) % 2))
    p = {k: v.astype(np.float64) for k, v in language_model.initial(classes).items()}
    rng = np.random.default_rng(1)
    h = rng.standard_normal((1, language_model.WIDTH))
    total = sum(10 ** (language_model.log_softmax(h, p, np.array([classes.of[i]]))[0] / np.log(10) + classes.within[i]) for i in range(3000))
    assert total == pytest.approx(1, abs=1e-5)
    x, y = rng.integers(0, classes.units, (2, language_model.WINDOW)), rng.integers(0, classes.size, (2, language_model.WINDOW))
    mask = rng.random(x.shape) < 0.7

    def loss():
        s, _ = language_model.attend(p, x)
        return -language_model.log_softmax(s[mask.reshape(-1)], p, y[mask]).mean()

    g = {k: np.full_like(v, 9) for k, v in p.items()}
    language_model.gradients(p, x, y, mask, g)
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        at = (int(x[0, 0]), *at[1:]) if k == "E" else (int(y[mask][0]) // 32, *at[1:]) if k in "Tt" else at
        old, e = p[k][at], 1e-5
        p[k][at] = old + e
        up = loss()
        p[k][at] = old - e
        down = loss()
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-5)


def test_only_scored_places_go_through_the_hidden_layer():
    classes = language_model.Classes(np.arange(3000.0), np.arange(3000) % 2)
    p = language_model.initial(classes)
    rng = np.random.default_rng(2)
    x = rng.integers(0, classes.units, (9, language_model.WINDOW))
    at = rng.permutation(x.size)[:50]
    whole, _ = language_model.attend(p, x)
    got, (*_, c, h1, m) = language_model.attend(p, x, at)
    assert len(whole) == x.size and len(got) == len(c) == len(h1) == len(m) == 50 and got == pytest.approx(whole[at], abs=1e-5)


def test_windows_score_each_once():
    for sizes in ([1], [5, 16, 17, 40], [13, 14, 29]):
        bounds = np.append(0, np.cumsum(sizes))
        at, valid, scored, row = language_model.windows(np.arange(bounds[-1]), bounds)
        assert sorted(at[scored].tolist()) == list(range(bounds[-1])) and (at[valid] < bounds[-1]).all()


# ---- 4


def test_token_store(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(token_store.TOKENIZER))
    store = token_store.write_store(docs, str(tmp_path / "store"))
    store.verify()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]
    starts = np.append(0, np.cumsum([len(x) for x in ids]))[:-1].tolist()
    want = Counter((i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids))
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.summary().collect()) == want
    assert {(r.start, tuple(r.ids)) for r in store.documents().collect()} == {(s, tuple(x)) for s, x in zip(starts, ids)}
    chunks = store.table("chunks")
    assert chunks.count() == chunks.select("hash").distinct().count() < sum(len(x) for x in ids)
    assert token_store.write_store(empty(spark), str(tmp_path / "none")).summary().count() == 0


def test_a_token_store_with_rows_lost_or_changed_is_refused(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    store = token_store.write_store(docs, str(tmp_path / "store"))
    store.verify()

    def changed(name, change):
        """Changes the first file of a table with rows enough; gives back how to undo that."""
        path = next(p for p in sorted((tmp_path / "store" / name).glob("part-*")) if pq.read_metadata(p).num_rows > 3)
        before = path.read_bytes()
        (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
        pq.write_table(change(pq.read_table(path)), path)
        return lambda: path.write_bytes(before)

    def swapped(t):
        roots = t.column("root").to_pylist()
        k = next(k for k in range(1, len(roots)) if roots[k] != roots[0] and t.column("part_root")[k].as_py() is None)
        roots[0], roots[k] = roots[k], roots[0]
        return t.set_column(t.schema.get_field_index("root"), "root", pa.array(roots, pa.binary()))

    for change in (lambda t: t.slice(1), swapped):
        undo = changed("recipes", change)
        with pytest.raises(Exception, match="manifest|has no row"):
            store.verify()
        undo()
    store.verify()
    undo = changed("chunks", lambda t: t.slice(1))
    for read in (store.summary, store.documents):
        with pytest.raises(Exception, match="missing or of another length"):
            read().collect()
    undo()
    assert store.summary().count() == docs.count()


def test_ids_are_those_of_the_library():
    """Pieces cut at signs, lines of plain words, and words that hashes might confuse."""
    from tokenizers import Tokenizer

    path, rng = tokenizer_path(token_store.TOKENIZER), random.Random(5)
    t = Tokenizer.from_file(path)
    some = ["Don't", "it's,", "''S", "x's.", "a-b_c", "word,", "3po", "c3", "é", "É,", "İ", "ﬁx", "e\u0301,", "a\u0338b", "=\u0338", "ß!", "—", "\u00a0", "\u2003x", "日本", "½", "..", "(a)", "#1", "\x00", "\u200b", "ǅ", "ªº", "ʼn"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "", "\n", "  "]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += ["<|endoftext|>A,b <|ENDOFTEXT|> Don't,", None, "", *thue_morse(10), " ".join(thue_morse(12)), *(" ".join(texts[i : i + 9]) for i in range(0, 90, 9))]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for end in ([], [1]):
        got = [ids[a:b].tolist() for ids, at in token_store.encoded_rows(pa.array(texts), path, *end) for a, b in zip(at, at[1:])]
        assert got == [x + end for x in want]


def test_cuts_follow_the_content():
    rng = np.random.default_rng(0)
    a, tail = rng.integers(0, 500, 3000), rng.integers(0, 500, 4000)
    x, y = (np.concatenate([h, tail]) for h in (a, a[:1234]))
    cuts = lambda s: token_store.cuts(len(s), token_store.window_ends(s).tolist())
    ends = [{len(s) - e for e in cuts(s)} for s in (x, y)]
    assert len(ends[0] & ends[1]) > 0.6 * len(cuts(tail))
    for s in (x, a[:1], a[:63], a[:65]):
        c = cuts(s)
        assert c[-1] == len(s) and all(b - f <= token_store.MOST for f, b in zip([0, *c], c))
    whole, cut = b"some bytes and others", 7
    crcs = [zlib.crc32(whole[:cut]), zlib.crc32(whole[cut:])]
    parts = token_store.shifted_crc(np.array(crcs), np.array([len(whole) - cut, 0]))
    assert int(parts[0] ^ parts[1]) == zlib.crc32(whole)


# ---- 5


@pytest.mark.parametrize("head", [0, 15, 10**6])
def test_bpe(spark, docs, head):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(bpe.TOKENIZER))
    want = Counter()
    for i, x in corpus():
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = bpe.digests(docs, head_words=head).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    if not head:
        texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
        assert all(texts[i] == (x or "") for i, x in corpus())
        assert bpe.digests(empty(spark)).count() == 0


def test_words_with_equal_polynomials_are_encoded_apart(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(bpe.TOKENIZER))
    texts = [*thue_morse(10), " ".join(thue_morse(12)), " ".join([*thue_morse(10)[::-1], "x"])]
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), head_words=3).collect()}
    assert all(np.frombuffer(bytes(got[i].ids), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts))


def test_words_are_cut_where_tokens_end():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer_path(bpe.TOKENIZER)), random.Random(6)
    texts = ["".join(rng.choice(["a", "Z", " ", "  ", "\n", " ", " ", "é", "1", "'s", ".", "\t", "—", "　"]) for _ in range(30)) for _ in range(400)]
    buf, off = K.buffers(pa.array(texts))
    start, end, row = bpe.cut(buf, off)
    data, out = buf.tobytes(), {}
    for a, b, r in zip(start.tolist(), end.tolist(), row.tolist()):
        out.setdefault(r, []).extend(t.encode(data[a:b].decode(), add_special_tokens=False).ids)
    assert all(out.get(i, []) == t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts))


# ---- 6


def test_sharding(spark, docs, tmp_path):
    rows, stored = sharding.shard_by_slots(docs, str(tmp_path / "map"), 4, 64)
    got = collect(rows)
    texts = corpus()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x in texts)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    map_ = stored.read(1)
    assert map_.count() == 64 and sharding.shard_by_slots(empty(spark), str(tmp_path / "none"))[0].count() == 0
    # One more shard: a second version of the stored map, and the first one is as it was.
    docs = docs.where("doc_id is null or doc_id <> 5005")
    rows, stored = sharding.shard_by_slots(docs, str(tmp_path / "other"), 4, 64)
    got, map_ = collect(rows), stored.read(1)
    before = map_.orderBy("vslot").collect()
    assert stored.rebalanced(1, 5) == 2 and stored.read(1).orderBy("vslot").collect() == before
    new = {r.vslot: r.shard for r in stored.read(2).collect()}
    assert all(new[r.vslot] in (r.shard, 4) for r in before) and 4 in new.values()
    moved = collect(sharding.assign(sharding.sized(docs, 64), stored.read(2), 2))
    assert all(r["shard"] == new[r["vslot"]] for r in moved) and len(moved) == len(got)
    for s in {r["shard"] for r in moved}:
        assert sorted(r["slot"] for r in moved if r["shard"] == s) == list(range(sum(r["shard"] == s for r in moved)))


def test_the_query_shards_by_bytes(spark):
    got = collect(sharding.query(spark, "/root/testdata/sf0.01"))
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(size) == set(range(24)) and max(size.values()) < 1.05 * min(size.values())
    for s in size:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_rebalance_moves_little():
    size = np.random.default_rng(3).integers(50, 150, 4096)
    old = sharding.place(size, 24)
    new = sharding.rebalance(old, size, 25)
    load = np.bincount(new, size, 25)
    assert load.max() / load.min() < 1.05 and (new != old).mean() < 0.06 and set(new[new != old]) == {24}
    assert sharding.rebalance(new, size, 24).max() == 23
    assert np.ptp(np.bincount(old, size, 24)) < 200


# ---- 7


def reference_lines(rows):
    key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(l) for l in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines, kept = (t or "").split("\n"), []
        for l in lines:
            h = holders.get(key(l), [])
            best = max((x for x in h if x is not None), default=None)
            if len(h) < 3 or best is None or best == i:
                kept.append(l)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize(("bits", "flush", "hot"), [(None, 200_000, 1000), (1 << 17, 7, 10**9)])
def test_line_dedup(spark, docs, bits, flush, hot):
    got = line_dedup.dedup_lines(docs, bits=bits, flush=flush, hot_keys=hot)
    assert {"lang", "row", "key", "score"} <= set(got.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == reference_lines(corpus())
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_of_many_rows_without_id(spark):
    line = "a line that many rows without an id share"
    rows = [(None, f"{line}\nown {k}") for k in range(3000)] + [(None, line)] * 500 + [(7, line)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, f"own {k}") for k in range(3000)] + [(None, "")] * 500 + [(7, line)])


# ---- 8


@pytest.mark.parametrize("outliers", [[2**50], [-(2**63), 2**63 - 1], [-(2**62) - 5, 2**62 + 5, *range(10**12, 10**12 + 300)]])
def test_successors_with_far_ids(spark, outliers):
    ids = [*range(400), *outliers]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").withColumn("sketch", F.array(F.lit(1)))
    for rows_a_bucket, most in ((10, 1000), (1, 10**6), (10**6, 10)):
        got = {r.doc_id: r.next_text for r in fingerprint.with_successor(df, rows_a_bucket, most).collect()}
        down = sorted(ids, reverse=True)
        assert got == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]])}
    filled = df.select(fingerprint._buckets(df, 10, 1000).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in filled) <= 40


def test_the_query_of_fingerprints(spark):
    """Against plain Python on the whole table: edited texts, and likeness against that of the shingle sets."""
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    down = sorted(rows, reverse=True)
    sets = lambda t: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(max(1, len(w) - 4))} if words(t) else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in fingerprint.query(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(rows)
    for i, j in zip(down, [*down[1:], down[0]]):
        h = len(rows[i]) // 2
        edited = rows[i][: len(rows[i]) - h] + rows[j][:h]
        assert got[i].n_chars == len(rows[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - like(sets(rows[i]), sets(edited))) < 0.2 and abs(got[i].near_next - like(sets(rows[i]), sets(rows[j]))) < 0.2
    prints = {}
    for i, t in rows.items():
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_fingerprints(spark, docs):
    got = fingerprint.edited_pairs(docs).collect()
    rows = [(i, x or "") for i, x in corpus()]
    assert len(got) == len(rows)
    named = sorted((r for r in rows if r[0] is not None and r[0] != 5006), key=lambda r: -r[0])
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, []).append(r)
    for (i, t), (_, after) in zip(named, named[1:]):
        if i > 5006 or i == 5007:
            continue
        h = len(t) // 2
        (r,) = prints[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()
    equal = {t: set() for _, t in rows}
    for r in got:
        if r.doc_id is not None:
            equal[dict(rows)[r.doc_id]].add(tuple(r.sketch))
    assert all(len(v) <= 1 for v in equal.values()) and prints[5000][0].sketch == []
    one = fingerprint.edited_pairs(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.edited_pairs(empty(spark)).count() == 0


def test_sketches_estimate_and_merge(spark):
    base = [f"w{k}" for k in range(3000)]
    parts = [" ".join(base[:2000]), " ".join(base[1000:]), " ".join(base), ""]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(parts)], "i int, x string, k string").select("i", "k", fingerprint.sketch(F.col("x"), 256).alias("s"))
    a, b, c, e = (r.s for r in df.orderBy("i").collect())
    both = df.select("k", "s").where("i < 2")
    assert fingerprint.merge_parts(both, "k", "s", 256).first().s == sorted(set(a) | set(b))[:256]
    pair = spark.createDataFrame([(a, b, c, e)], "a array<long>, b array<long>, c array<long>, e array<long>")
    r = pair.select(fingerprint.resemblance(F.col("a"), F.col("b"), 256).alias("j"), fingerprint.containment(F.col("a"), F.col("c"), 256).alias("in_c"), fingerprint.distinct_shingles(F.col("c"), 256).alias("n"), fingerprint.resemblance(F.col("e"), F.col("e"), 256).alias("e")).first()
    assert abs(r.j - 1 / 3) < 0.1 and r.in_c > 0.85 and abs(r.n / 2996 - 1) < 0.2 and r.e == 1.0


# ---- 9


@pytest.mark.parametrize("most", [10**6, 200])
def test_contamination(spark, docs, most):
    item = " ".join(f"Item{k}," for k in range(20))
    more = [(9000, "before " + item.upper() + " after"), (9001, " ".join(f"item{k}" for k in range(12))), (9002, "say Hello—World twice: hello—world"), (9003, "x " * 500 + " ".join(f"item{k}" for k in range(13)))]
    rows = [(i, t) for i, t in corpus() if (i or 0) % 3 == 0] + more
    bench = [(1, item), (2, "hello—world"), (3, None), (4, ""), (None, "no id"), (1, item)]
    norm = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: norm.findall((t or "").translate(LOWER))
    pats = {}
    for i, t in bench:
        w = of(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            pats.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {}
    for i, t in rows:
        w, hit, items = of(t), set(), set()
        for p, ids in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= {x for x in ids if x is not None}
        want[i] = (len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w))
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, items int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(d, b, most=most).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got} == want
    (r,) = [r for r in got if r.doc_id == 9000]
    text = dict(rows)[9000]
    assert [text[s.start : s.end] for s in r.spans] == [item.upper().rstrip(",")]
    assert decontaminate.contamination(empty(spark), b).count() == 0
    assert decontaminate.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0


# ---- 10


def test_quality(spark, docs):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, " | ".join(w) if bad and i % 8 else " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad)))
    d, l = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    trees = quality.train(d, l)
    got = {r.doc_id: r for r in quality.classify(d, trees).collect()}
    held = [i for i in got if got[i].held_out]
    assert {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1} == set(held) and len(held) > 200
    assert sum(got[i].predicted == dict(labels)[i] for i in held) / len(held) > 0.98
    again = quality.classify(docs, trees)
    assert again.count() == len(corpus()) and again.where("score < 0 or score > 1").count() == 0 and "lang" in again.columns
    none = quality.train(d, l.limit(0))
    assert {r.predicted for r in quality.classify(docs, none).collect()} == {1} and quality.classify(empty(spark), trees).count() == 0


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    t = quality.fit(x, y, trees=5, depth=3)
    for r in range(50):
        s = t.base
        for f, th, leaf in zip(t.feature, t.threshold, t.leaf):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(x[r, f[k]] > th[k])
            s += leaf[k - 7]
        assert t.raw(x[r : r + 1])[0] == pytest.approx(s)
