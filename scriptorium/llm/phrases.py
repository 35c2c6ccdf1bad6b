"""Collocations: phrases of 2 to 5 words that occur together more often than their parts would by chance.

Frequent phrases are named level by level, and only names travel:

1. Words are counted by language; a word with LEAST occurrences gets an id. Texts are then kept as blocks: in
   each a sequence of numbers of the block's own words with ids, 0 where a piece ends or a word has none.
2. Level k. In a block, where two (k-1)-grams with ids stand one word apart, their pair of ids is a k-gram.
   Pairs are counted in each task, summed over all, named, and their ids joined back to the blocks, whose
   sequences are then those of k-grams. No k-gram is frequent unless both of its pair are, so nothing is
   lost, and what is left shrinks with each level.
3. A k-gram's pair of ids points to its parents, its first and its last k-1 words. Following them gives the
   counts of all its beginnings and endings, so of both sides of every cut, and the phrases that a longer one
   covers: a phrase inside a longer one with a given count is inside one that is a single word longer, with
   at least that count.

Ids are joined back in the tasks, by a table of at most BROADCAST_ROWS names of 24 bytes; where a level has more
names, each block sends its distinct keys to a join by key and gets their ids back. Sums are partial in each
task, so a hot word or pair shuffles one row a task.

Defined cases. A null or empty text has no words, a null lang is `und`. Repeated rows count each. Words are of
any length and never cut. Counts, scores and products are whole numbers: a product of two counts has 38
digits at most, and counts beyond 10^15 raise an error. Ties of score and count go to the phrase that is first
in UTF-8 byte order. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import Table, keep, lean, prepare

LEAST, LONGEST, TOP, COVERED_PERCENT = 100, 5, 2000, 100
BROADCAST_ROWS = 3_000_000
#: Bytes of text in a block, about; a single longer text is one block. Words a task counts before it sends them.
BLOCK, FLUSH = 8 << 20, 250_000
SALTS = 64
_BETWEEN = b".,;:!?\n\x0b\x0c\r"
_WORD = np.ones(256, np.uint8)
_WORD[[*_BETWEEN, *b" \t"]] = 0
_ENDS_PIECE = np.zeros(256, np.uint8)
_ENDS_PIECE[list(_BETWEEN)] = 1
#: A block: numbers from 1 on of its distinct keys, 0 for none, as 32-bit integers; and what the numbers stand for.
_WORDS = "block long, seq binary, lang array<string>, word array<string>"
_NAMES = "block long, seq binary, ids array<bigint>"


def _numbering():
    """Numbers of blocks, distinct over all tasks of a stage."""
    block = TaskContext.get().partitionId() << 32
    while True:
        yield block
        block += 1


# ---- words


class _Block(NamedTuple):
    """Words of some texts: distinct ones, each with its language, counts, and the sequence of their numbers."""

    lang: list[str]
    word: list[bytes]
    n: np.ndarray
    seq: np.ndarray


def _word_blocks(batches):
    for batch in batches:
        lang = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        lang_of, names = lang.indices.to_numpy().astype(np.int64), lang.dictionary.to_pylist()
        buf, off = K.buffers(batch.column("text"))
        for i, j in K.chunks(off, BLOCK):
            low = K.LOWER[buf[off[i] : off[j]]]
            start, end, row = K.spans(low, off[i : j + 1] - off[i], _WORD)
            if not len(start):
                continue
            first, word = K.equal_spans(low, start, end)
            keys = pa.array(lang_of[i:j][row] * len(first) + word).dictionary_encode()
            own, codes = keys.dictionary.to_numpy(), keys.indices.to_numpy()
            ends = np.append(0, np.cumsum(_ENDS_PIECE[low], dtype=np.int64))
            apart = np.flatnonzero((row[1:] != row[:-1]) | (ends[start[1:]] != ends[end[:-1]])) + 1
            at, data = first[own % len(first)], low.tobytes()
            words = [data[x:y] for x, y in zip(start[at].tolist(), end[at].tolist())]
            yield _Block([names[k] for k in (own // len(first)).tolist()], words, np.bincount(codes, minlength=len(own)), np.insert(codes + 1, apart, 0))


def _count_words(batches):
    def send(counts):
        lang, word = zip(*counts)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([w.decode() for w in word], pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])

    counts: dict[tuple[str, bytes], int] = {}
    for block in _word_blocks(batches):
        for key, n in zip(zip(block.lang, block.word), block.n.tolist()):
            counts[key] = counts.get(key, 0) + n
        if len(counts) >= FLUSH:
            yield send(counts)
            counts = {}
    if counts:
        yield send(counts)


def _write_words(batches):
    number = _numbering()
    for block in _word_blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array([next(number)]), pa.array([block.seq.astype("<i4").tobytes()], pa.binary()), pa.array([block.lang], pa.list_(pa.string())), pa.array([[w.decode() for w in block.word]], pa.list_(pa.string()))], names=["block", "seq", "lang", "word"])


def _digests(lang, word) -> np.ndarray:
    """128 bits of each word in its language, as two numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"%d %s %s" % (len(x), x, w)) for x, w in zip((x.encode() for x in lang), word)), np.uint64).reshape(-1, 2)


def _digest_rows(batches):
    for batch in batches:
        key = _digests(batch.column("lang").to_pylist(), [w.encode() for w in batch.column("word").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(key[:, k].view(np.int64)) for k in (0, 1))], names=["id", "high", "low"])


# ---- names


class Names(NamedTuple):
    """Ids by pairs of numbers: distinct left and right numbers, ascending pairs of their places, and ids."""

    left: np.ndarray
    right: np.ndarray
    pair: np.ndarray
    id: np.ndarray

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, -1 for one without."""
        if not len(self.pair):
            return np.full(len(left), -1, np.int64)
        a, b = (np.minimum(np.searchsorted(x, y), len(x) - 1) for x, y in ((self.left, left), (self.right, right)))
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
        return np.where((self.left[a] == left) & (self.right[b] == right) & (self.pair[at] == pair), self.id[at], -1)


def _names(rows: DataFrame, left: str, right: str) -> Names:
    t = rows.toArrow()
    (a, x), (b, y) = (np.unique(t.column(c).to_numpy(), return_inverse=True) for c in (left, right))
    pair = x.astype(np.int64) << 32 | y
    order = np.argsort(pair)
    return Names(a, b, pair[order], t.column("id").to_numpy()[order])


def _named(sums: DataFrame, key: list[str], least: int, level: int) -> Table:
    """(id, key, a): what occurs least times or more. Written, so that ids stay."""
    return keep(sums.where(F.col("a") >= least).select(F.monotonically_increasing_id().alias("id"), *key, "a"), f"grams{level}")


def _send(block: int, seq: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
    """The block with only those numbers that have ids (others: -1), or nothing."""
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return None
    own = np.zeros(len(ids) + 1, np.int32)
    own[known + 1] = np.arange(1, len(known) + 1)
    seq = own[seq]
    seq = seq[(seq > 0) | np.append(False, seq[:-1] > 0)]  # one 0 where there are more
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([seq.astype("<i4").tobytes()], pa.binary()), pa.array([ids[known]], pa.list_(pa.int64()))], names=["block", "seq", "ids"])


def _all(batches):
    return (b for b in batches if b is not None)


def _known_words(names_):
    def run(batches):
        names, number = names_.value, _numbering()
        for block in _word_blocks(batches):
            key = _digests(block.lang, block.word).view(np.int64)
            yield _send(next(number), block.seq, names.find(key[:, 0], key[:, 1]))

    return run


def _blocks(batch: pa.RecordBatch):
    for block, seq, ids in zip(*(batch.column(c) for c in ("block", "seq", "ids"))):
        yield block.as_py(), np.frombuffer(seq.as_buffer(), "<i4").astype(np.int64), ids.values.to_numpy()


def _pairs(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of neighbours in a block, as ids, with their counts; and the sequence of their numbers."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    keys, pair, n = np.unique(seq[at] << 32 | seq[at + 1], return_inverse=True, return_counts=True)
    out = np.zeros(max(len(seq) - 1, 0), np.int64)
    out[at] = pair + 1
    return ids[(keys >> 32) - 1], ids[(keys & 0xFFFFFFFF) - 1], n, out


def _count_pairs(batches):
    for batch in batches:
        for _, seq, ids in _blocks(batch):
            left, right, n, _ = _pairs(seq, ids)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n.astype(np.int64))], names=["left", "right", "n"])


def _known_pairs(names_):
    def run(batches):
        names = names_.value
        for batch in batches:
            for block, seq, ids in _blocks(batch):
                left, right, _, out = _pairs(seq, ids)
                yield _send(block, out, names.find(left, right))

    return run


# The same for more names than are sent to all tasks: keys go to the names by a join, ids come back by block.


def _pair_keys(batches):
    for batch in batches:
        for block, seq, ids in _blocks(batch):
            left, right, *_ = _pairs(seq, ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), block)), pa.array(np.arange(len(left), dtype=np.int32)), pa.array(left), pa.array(right)], names=["block", "code", "left", "right"])


def _found(batches):
    """Blocks with the numbers of some of their keys (for pairs: with the ids of the level before)."""
    for batch in batches:
        pairs = "ids" in batch.schema.names
        for k, (block, seq) in enumerate(zip(batch.column("block").to_pylist(), batch.column("seq"))):
            codes, found = (batch.column(c)[k].values.to_numpy() for c in ("codes", "found"))
            seq = np.frombuffer(seq.as_buffer(), "<i4").astype(np.int64)
            if pairs:
                seq = _pairs(seq, batch.column("ids")[k].values.to_numpy())[3]
            ids = np.full(int(max(seq.max(initial=0), codes.max(initial=0) + 1)), -1, np.int64)
            ids[codes] = found
            yield _send(block, seq, ids)


def _by_join(blocks: DataFrame, keys: DataFrame, grams: Table, key: list[str]) -> DataFrame:
    found = keys.join(grams.df.select("id", *key), key).groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("of"))
    both = blocks.join(found.select("block", F.col("of.code").alias("codes"), F.col("of.id").alias("found")), "block")
    return both.mapInArrow(lean(lambda batches: _all(_found(batches))), _NAMES)


def _word_names(texts: DataFrame, grams: Table, broadcast_rows: int) -> Table:
    """Blocks of texts with ids of words."""
    if grams.df.count() <= broadcast_rows:
        names = _names(grams.df.mapInArrow(_digest_rows, "id long, high long, low long"), "high", "low")
        known = _known_words(texts.sparkSession.sparkContext.broadcast(names))
        return keep(texts.mapInArrow(lean(lambda batches: _all(known(batches))), _NAMES), "level1")
    blocks = keep(texts.mapInArrow(lean(_write_words), _WORDS), "words")
    keys = blocks.df.select("block", F.posexplode(F.arrays_zip("lang", "word")).alias("code", "key")).select("block", "code", "key.lang", "key.word")
    out = keep(_by_join(blocks.df.select("block", "seq"), keys, grams, ["lang", "word"]), "level1")
    blocks.drop()
    return out


def _pair_names(blocks: Table, grams: Table, broadcast_rows: int, level: int) -> Table:
    """Blocks with ids of pairs, from those with ids of the level before."""
    if grams.df.count() <= broadcast_rows:
        known = _known_pairs(blocks.spark.sparkContext.broadcast(_names(grams.df.select("id", "left", "right"), "left", "right")))
        return keep(blocks.df.mapInArrow(lean(lambda batches: _all(known(batches))), _NAMES), f"level{level}")
    keys = blocks.df.mapInArrow(lean(_pair_keys), "block long, code int, left long, right long")
    return keep(_by_join(blocks.df, keys, grams, ["left", "right"]), f"level{level}")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, broadcast_rows: int = BROADCAST_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """Per level from 1: (id, lang, phrase, a, left, right, pre, suf), the phrases with least occurrences, the ids
    of their parents, and the counts of their first and last 1, 2, ... words; and (lang, n)."""
    prepare(docs.sparkSession)
    texts = docs.select("lang", "text")
    words = keep(texts.mapInArrow(lean(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = keep(words.df.groupBy("lang").agg(F.sum("a").alias("n")), "totals").df
    grams = _named(words.df, ["lang", "word"], least, 1)
    words.drop()
    none = F.array().cast("array<bigint>")
    level = grams.df.select("id", "lang", F.col("word").alias("phrase"), "a", *(F.lit(None).cast("long").alias(c) for c in ("left", "right")), none.alias("pre"), none.alias("suf"), F.col("word").alias("last"))
    levels, blocks = [level], _word_names(texts, grams, broadcast_rows)
    for k in range(2, longest + 1):
        sums = blocks.df.mapInArrow(lean(_count_pairs), "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("a"))
        grams = _named(sums, ["left", "right"], least, k)
        first = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("p"), F.concat("pre", F.array("a")).alias("pre"))
        rest = level.select(F.col("id").alias("right"), F.concat("suf", F.array("a")).alias("suf"), "last")
        level = grams.df.join(first, "left").join(rest, "right").select("id", "lang", F.concat("p", F.lit(" "), "last").alias("phrase"), "a", "left", "right", "pre", "suf", "last")
        level = keep(level, f"phrases{k}").df
        levels.append(level)
        if k < longest:
            after = _pair_names(blocks, grams, broadcast_rows, k)
            blocks.drop()
            blocks = after
    blocks.drop()
    return [x.drop("last") for x in levels], totals


def _cut(k: int) -> Column:
    """(score, words in the first part, l, r) of the lowest cut; the shortest first part among equals."""
    thousand = (F.col("a") * 1000).cast("decimal(19,0)") * F.col("n").cast("decimal(18,0)")

    def one(j: int) -> Column:
        left, right = F.col("pre")[j - 1], F.col("suf")[k - j - 1]
        parts = left.cast("decimal(18,0)") * right.cast("decimal(18,0)")
        return F.struct(F.call_function("div", thousand, parts).alias("score"), F.lit(j).alias("words"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*(one(j) for j in range(1, k))))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, covered_percent: int = COVERED_PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases by score (all of them with top None).

    A phrase is left out if one that holds it has covered_percent of its occurrences."""
    levels, totals = frequent_phrases(docs, least, longest, broadcast_rows)
    every = None
    for k in range(2, longest + 1):
        level = levels[k - 1].join(totals, "lang").withColumn("cut", _cut(k))
        if k < longest:
            longer = levels[k].select(F.col("left").alias("id"), F.col("a").alias("b")).union(levels[k].select("right", "a")).groupBy("id").agg(F.max("b").alias("b"))
            level = level.join(longer, "id", "left").where(F.col("b").isNull() | (F.col("b") * 100 < F.col("a") * covered_percent))
        level = level.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        every = level if every is None else every.union(level)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the first of each part of a language, so that no task sorts a language whole
        part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
        every = every.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= top).drop("nth")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, [x for x in string_split_regex(piece, '[\\x20\\x09]+') if x <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, n.n, x.a AS l, y.a AS r, c.cut, (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1) c
  JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM f q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.a >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""
