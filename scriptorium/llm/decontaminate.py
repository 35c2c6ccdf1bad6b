"""Benchmark decontamination with an Aho-Corasick automaton.

Items and documents are normalised alike: A-Z lower-cased, words (runs of ASCII letters and digits and of
all characters beyond ASCII) joined by one space, with a space at both ends. Every window of WINDOW
consecutive item words, or a shorter item as a whole, is one pattern with its spaces, so it only matches
at word boundaries. One automaton scans each normalised text once; an end offset becomes a word number by
the words' end offsets, and word numbers become offsets in the original text through the words' spans.

The patterns are a stated query set that goes to every task. Its size is checked: where items might make more
than MAX_PATTERN_CHARS they are dealt by a hash into as many blocks as needed, each one automaton and one pass
over all documents, with what has been found written in between; so a task and the driver hold one block at
a time.

Defined cases. A null text has no words: n_words 0, not contaminated. A null or empty item has no window. A
null item_id is left out of the items, its words still count as hit. Repeated items count once by
item_id. Empty tables give no hits, or no rows. Other columns are carried along; input columns named
like computed ones are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._common import keep, lean, prepare

WINDOW = 13
#: Pattern characters in one automaton: bounds its memory at some 100 bytes each.
MAX_PATTERN_CHARS = 1_500_000
#: Contaminated with PART * n_hit >= n_words and a hit.
PART = 20

#: Word bytes become themselves in lower case, all others a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def patterns(items: list[tuple[int | None, str | None]], size: int = WINDOW) -> dict[bytes, list]:
    """Window -> ids of the items that hold it."""
    of: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text or "", size):
            of.setdefault(w, set()).add(item)
    return {w: sorted(x for x in ids if x is not None) for w, ids in of.items()}


def _automaton(block: dict[bytes, list]) -> ahocorasick.Automaton | None:
    """Kept by content in the worker, as building takes longer than a small batch's scan."""
    if not block:
        return None
    name = hashlib.sha256(repr(sorted(block)).encode()).hexdigest()
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        a = ahocorasick.Automaton()
        for w in block:
            a.add_word(f" {w.decode()} ", (w.count(b" ") + 1, w))
        a.make_automaton()
        _AUTOMATA[name] = a
    return _AUTOMATA[name]


def hit_words(normal: str, automaton: ahocorasick.Automaton, block: dict[bytes, list]) -> tuple[np.ndarray, set]:
    """Numbers of the words inside any match in a normalised text, and the items matched."""
    ends: np.ndarray | None = None
    hit, items = [], set()
    for end, (n, w) in automaton.iter(normal):
        if ends is None:
            ends = np.cumsum(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
        last = int(ends[end]) - 2  # the closing space of word k is the (k + 2)th space
        hit.append((last - n + 1, last + 1))
        items.update(block[w])
    if not hit:
        return np.zeros(0, np.int64), items
    return np.unique(np.concatenate([np.arange(i, j) for i, j in set(hit)])), items


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def original_spans(text: str, numbers: np.ndarray) -> list[tuple[int, int]]:
    """Offsets (in code points) in the original text of the hit words, neighbours joined."""
    data = text.encode().translate(K.LOWER_BYTES)
    at = [m.span() for m in _WORD.finditer(data)]
    out: list[list[int]] = []
    for k in numbers.tolist():
        i, j = len(data[: at[k][0]].decode()), len(data[: at[k][1]].decode())
        if out and k and out[-1][2] == k - 1:
            out[-1][1:] = [j, k]
        else:
            out.append([i, j, k])
    return [(i, j) for i, j, _ in out]


def _texts(column: pa.Array) -> Iterator[bytes]:
    buf, off = K.buffers(column)
    data = buf.tobytes()
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[i:j]


def _scan(block_, last: bool, spans: bool):
    """Adds a block's hits to those found before; after the last block, numbers instead of texts."""

    def run(batches):
        block = block_.value
        automaton = _automaton(block)
        for batch in batches:
            n_words, n_hit, items, hits, where = [], [], [], [], []
            before = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for text, had, ids in zip(_texts(batch.column("text")), *before):
                words = text.translate(_NORMAL).split()
                n_words.append(len(words))
                hit, found = np.frombuffer(had or b"", np.int64), set(ids or ())
                if words and automaton:
                    h, f = hit_words(f" {b' '.join(words).decode('utf-8', 'replace')} ", automaton, block)
                    hit, found = (np.union1d(hit, h) if len(h) else hit), found | f
                n_hit.append(len(hit))
                items.append(sorted(found))
                hits.append(hit.tobytes())
                if last and spans:
                    where.append([{"start": i, "end": j} for i, j in original_spans(text.decode("utf-8", "replace"), hit)] if len(hit) else [])
            found = pa.array(items, pa.list_(pa.int64()))
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(hits, pa.binary()), found], names=["row", "text", "hits", "items"])
                continue
            out, names = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), found], ["row", "n_words", "n_hit", "items"]
            if spans:
                out.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MAX_PATTERN_CHARS, spans: bool = True) -> DataFrame:
    """docs with n_words, n_hit, items (ids with occurring windows), contaminated, and the hits' spans in the text."""
    spark = docs.sparkSession
    prepare(spark)
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    # A window begins at each word and is about window words long, so items make at most window times their characters.
    blocks = max(1, -(-window * (bench.agg(F.sum(F.length("text")).alias("n")).first().n or 0) // most))
    computed = ("n_words", "n_hit", "items", "contaminated", *(["spans"] if spans else []))
    carried = [c for c in docs.columns if c not in computed]
    state = docs.select(F.struct(*carried).alias("row"), "text", F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<long>").alias("items"))
    found, array = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType())], T.StructField("items", T.ArrayType(T.LongType()))
    where = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))] if spans else []
    for k in range(blocks):
        own = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        block = spark.sparkContext.broadcast(patterns([(r.item_id, r.text) for r in own.collect()], window))
        last = k == blocks - 1
        schema = T.StructType([state.schema["row"], *found, array, *where] if last else [*state.schema.fields[:3], array])
        state = state.mapInArrow(lean(_scan(block, last, spans)), schema)
        if not last:
            state = keep(state, "hits").df
    contaminated = ((F.col("n_hit") > 0) & (PART * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    return state.select(*(F.col("row")[c].alias(c) for c in carried), "n_words", "n_hit", "items", contaminated, *(["spans"] if spans else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), bench, spans=False)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH norm AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+least(len(w), 13)-1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM norm, sizes WHERE len(w) >= n)),
m AS (SELECT win.doc_id, win.i, win.n, pat.item_id FROM win JOIN pat ON win.n = pat.n AND win.p = pat.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT norm.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN hit ON norm.doc_id = hit.doc_id LEFT JOIN its ON norm.doc_id = its.doc_id
"""
