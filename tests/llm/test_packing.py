"""Packing: every id once, in gapless sequences, and patterns against packing piece by piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scriptorium.llm import bpe, packing
from scriptorium.llm._common import tokenizer_path

SCHEMA = "doc_id long, text string, ids string, part int, rest int"


def one_by_one(lengths, length):
    """Fills of packs when pieces go one at a time, longest first, into the shortest pack with room."""
    packs = []
    for n in sorted(lengths, reverse=True):
        best = min(range(len(packs)), key=lambda k: packs[k], default=None)
        if best is None or packs[best] + n > length:
            packs.append(n)
        else:
            packs[best] += n
    return sorted(packs)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_are_those_of_single_pieces(seed):
    r = random.Random(seed)
    length = r.choice([16, 100, 2048])
    lengths = [r.choice([1, 1, 2, 3, r.randint(1, length), length // 2 + 1, length // 3]) for _ in range(r.choice([0, 1, 7, 900]))]
    packs = packing.patterns(Counter(lengths), length)
    assert sorted(p.size for p in packs for _ in range(p.count)) == one_by_one(lengths, length)
    held = Counter()
    for p in packs:
        for n, copies in p.lengths:
            held[n] += copies * p.count
    assert held == Counter(lengths)


def test_a_billion_pieces_are_a_few_patterns():
    histogram = {n: 10**9 // n for n in range(1, 2048)}
    packs = packing.patterns(histogram)
    assert sum(p.size * p.count for p in packs) == sum(n * c for n, c in histogram.items())
    assert len(packs) < 3 * 2048 and sum(2048 * p.count for p in packs) < 1.001 * sum(n * c for n, c in histogram.items())


def test_sizes():
    assert packing.sizes(2048) == [2048] and packing.sizes(2000) == [2000] and packing.sizes(1024) == [1024]
    assert packing.sizes(1100) == [1024, 64, 8, 4] and packing.sizes(1) == [1]
    for n in range(1, 2049):
        own = packing.sizes(n)
        assert sum(own) == n and sum(0 if k & (k - 1) == 0 else 2048 - k for k in own) <= packing.MOST_PADDING


def texts():
    r = random.Random(3)
    words = ["the", "Of.", "l'été", "don't", "a--b", "x1,y2", "日本", "\n", "\n\n", " \n", "it's.", "(no)", " ", " ", "z ", "...'s", "_q_"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 60, 900])))) for k in range(150)]
    rows += [(None, "no id"), (None, None), (5, None), (6, ""), (7, "a\nb\n\nC\n.D"), (8, "x <|endoftext|>y.z"), (9, "word " * 40_000)]
    return rows + [(10, "the same text.\nTwice, Thrice")] * 40


@pytest.fixture(scope="module")
def packed(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(4)
    return rows, df


@pytest.mark.parametrize("broadcast_numbers", [0, 10**6])
def test_every_id_is_in_one_piece(spark, packed, broadcast_numbers):
    rows, df = packed
    pieces = packing.pack(df, broadcast_numbers=broadcast_numbers)
    found = [r.asDict() for r in pieces.collect()]
    t = bpe.load(tokenizer_path(packing.TOKENIZER))
    expected = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in rows)
    # Sequences have no gaps; a document's pieces put together are its ids.
    by = defaultdict(list)
    for r in found:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    padding = 0
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * sum(len(x) for _, x in expected.elements())
    docs = defaultdict(list)
    for r in found:
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()))
    for (i, n), own in docs.items():
        same = [x for (j, x), c in expected.items() for _ in range(c) if j == i and len(x) == n]
        # Pieces of equal texts are cut alike or not, but each id of each copy is there once.
        ids = Counter((s + k, x) for s, m, z in own for k, x in enumerate(z))
        assert ids == Counter((k, v) for x in same for k, v in enumerate(x))
    assert {k for k in docs} == {(i, len(x)) for i, x in expected}


def test_sequences_and_query(spark, packed, tmp_path):
    rows, df = packed
    pieces = packing.pack(df)
    for r in packing.sequences(pieces, pad_id=9).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 2048) and (ids[r.n_tokens :] == 9).all()
        assert sum(d.length for d in r.documents) == r.n_tokens
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.query(spark, str(tmp_path)).collect()
    t = bpe.load(tokenizer_path(packing.TOKENIZER))
    of = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    for r in out:
        if r.doc_id is not None and r.doc_id > 10:
            assert r.ids_crc32 == zlib.crc32(np.array(of[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(of[r.doc_id])


def test_no_rows(spark):
    out = packing.pack(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
