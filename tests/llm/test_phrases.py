"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from scriptorium.llm import phrases

SCHEMA = "doc_id long, text string, lang string, block string, score double"


def brute(rows, least, top, longest=5, percent=100):
    count, total = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    f = {key: a for key, a in count.items() if a >= least}
    out = []
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        holds = (q for (other, q) in f if other == lang and len(q) > len(words) and any(q[i : i + len(words)] == words for i in range(len(q))))
        if any(100 * f[lang, q] >= percent * a for q in holds):
            continue
        score, _, left, right = min((1000 * a * total[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), left, right, total[lang]))
    ranked, place = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def rows_of(seed=5):
    r = random.Random(seed)
    words = ["the", "Cat", "sat", "on", "été", "a b", "Ä", "x-y", "日本", "(", "of"]
    out = []
    for k in range(400):
        n = r.choice([0, 1, 2, 7, 40])
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?!"]) for _ in range(n))
        out.append((k % 90, text + r.choice(["", "the cat sat on the mat", "New York City;", "x" * 300 + " y"]), r.choice(["en", "en", "fr", None, "und", ""]), "b", 0.5))
    out += [(None, None, "en", None, None), (1, "", None, None, None), (2, " .,\n", "de", None, None)]
    out += [(7, "Same words again and again. " * 3, "de", "x", 1.0)] * 30
    out.append((8, "one two three four five six seven " * 60_000, "long", None, None))
    return out


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_all_phrases_as_by_counting(spark, broadcast_rows, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = [tuple(r) for r in phrases.collocations(df, least=12, top=25, broadcast_rows=broadcast_rows).collect()]
    assert sorted(found) == sorted(brute(rows, 12, 25)) and len(found) > 40


def test_phrases_of_parts_cover_and_blocks_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 200)
    rows = rows_of(6)[:-1]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in phrases.collocations(df, least=9, longest=4, top=None, covered_percent=80).collect()]
    assert sorted(found) == sorted(brute(rows, 9, 10**9, 4, 80))
    levels, totals = phrases.frequent_phrases(df, least=9)
    three = {r.id: r for r in levels[2].collect()}
    two = {r.id: r.phrase for r in levels[1].collect()}
    assert three and all(r.phrase.rsplit(" ", 1)[0] == two[r.left] and r.phrase.split(" ", 1)[1] == two[r.right] for r in three.values())
    assert {r.lang for r in totals.collect()} == {"und" if r[2] is None else r[2] for r in rows if (r[1] or "").strip(" .,\n")}


def test_counts_beyond_64_bits_and_ties(spark):
    level = spark.createDataFrame([(10**14, 10**15, [2 * 10**14], [3 * 10**14])], "a long, n long, pre array<long>, suf array<long>")
    assert tuple(level.select(phrases._cut(2).alias("c")).first().c) == (10**32 // (6 * 10**28), 1, 2 * 10**14, 3 * 10**14)
    # Both cuts give 0 after flooring: the shorter first part counts.
    level = spark.createDataFrame([(1, 5, [90, 80], [70, 99])], "a long, n long, pre array<long>, suf array<long>")
    assert tuple(level.select(phrases._cut(3).alias("c")).first().c) == (0, 1, 90, 99)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = phrases.collocations(df)
    assert out.collect() == [] and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0
