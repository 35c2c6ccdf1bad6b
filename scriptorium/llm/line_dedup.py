"""Line deduplication with two Bloom filters.

1. Each task hashes the keys of its documents' lines and sends, block by block, the bit positions of keys it
   has seen once and of those it has seen twice. Blocks are merged by block number into two filters: a bit is
   in the second one if a task saw it twice or two tasks saw it. So a key held by two documents is always
   in the second filter.
2. Only keys whose bits are all in the second filter are shuffled, as 128-bit digests with doc_id, counted
   exactly, and the largest doc_id of each is found.
3. What a document loses is joined back by doc_id. Keys of very many documents (at most HOT_KEYS of them by
   construction) are sent to all tasks instead of through the join, so no join key is hot.

The filter has about BITS_A_LINE bits for each line, in a power of two from LEAST_BITS to MOST_BITS (128 MB, the only
broadcast besides the hot keys). Beyond that it fills up, more keys count as suspected and step 2 shuffles
more; results never depend on it.

Defined cases. A null or empty text is one empty line. A null doc_id ranks below all others: its lines go if
any named document holds the key; if none does, they stay. Each row counts as a document, so repeated
rows count as several; all rows with the largest doc_id keep their lines. Rows without doc_id find what they lose by their text. An empty table gives an empty
table. Input columns named like computed ones are replaced, all others are carried along.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._common import keep, lean, prepare

MIN_CHARS, MIN_DOCS = 20, 3
BITS_A_LINE, LEAST_BITS, MOST_BITS, BLOCK = 8, 1 << 20, 1 << 30, 1 << 16
#: Keys a task holds before it sends their positions and starts anew.
FLUSH = 200_000
HOT_KEYS = 1000


def line_key(line: bytes) -> bytes:
    return line.strip(K.SPACES).translate(K.LOWER_BYTES)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def digests(text: bytes, min_chars: int) -> Iterator[bytes | None]:
    """The digest of each line's key, None for lines that are too short to count."""
    for line in text.split(b"\n"):
        key = line_key(line)
        yield xxhash.xxh3_128_digest(key) if _long_enough(key, min_chars) else None


def _rows(column: pa.Array) -> Iterator[bytes]:
    buf, off = K.buffers(column)
    data = buf.tobytes()
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        yield data[i:j]


def _positions(keys: list[bytes], bits: int) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(keys), np.uint64) & np.uint64(bits - 1))


def _by_block(once: list[bytes], twice: list[bytes], bits: int) -> pa.RecordBatch:
    parts: dict[int, list[bytes]] = {}
    for k, keys in enumerate((once, twice)):
        at = _positions(keys, bits)
        block = (at // np.uint64(BLOCK)).astype(np.int64)
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        for b, piece in zip(block[cut].tolist(), np.split(at, cut[1:]) if len(at) else []):
            parts.setdefault(b, [b"", b""])[k] = (piece % np.uint64(BLOCK)).astype(np.uint16).tobytes()
    return pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int32()), *(pa.array([v[k] for v in parts.values()], pa.binary()) for k in (0, 1))], names=["block", "once", "twice"])


def _collect_bits(min_chars: int, bits: int, flush: int):
    def run(batches):
        once: set[bytes] = set()
        twice: set[bytes] = set()
        for batch in batches:
            for text in _rows(batch.column(0)):
                own = set(digests(text, min_chars)) - {None}
                twice |= own & once
                once |= own
                if len(once) >= flush:
                    yield _by_block([*once], [*twice], bits)
                    once, twice = set(), set()
        if once:
            yield _by_block([*once], [*twice], bits)

    return run


def _merge(batches):
    """Per block the second filter: seen twice by one sender or once by two."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(batch.column(k).to_pylist() for k in range(3))):
            have = seen.setdefault(block, np.zeros((2, BLOCK // 8), np.uint8))
            new = np.zeros((2, BLOCK), np.uint8)
            new[0, np.frombuffer(once, np.uint16)] = 1
            new[1, np.frombuffer(twice, np.uint16)] = 1
            new = np.packbits(new, axis=1, bitorder="little")
            have[1] |= new[1] | (have[0] & new[0])
            have[0] |= new[0]
    full = {b: x[1] for b, x in seen.items() if x[1].any()}
    yield pa.RecordBatch.from_arrays([pa.array(full.keys(), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in full.values()], pa.binary())], names=["block", "bits"])


def repeated_filter(docs: DataFrame, min_chars: int = MIN_CHARS, bits: int = LEAST_BITS, flush: int = FLUSH) -> dict[int, bytes]:
    """Block number -> compressed bits of the filter of keys seen at least twice; bits / 8 bytes at most."""
    parts = docs.select("text").mapInArrow(lean(_collect_bits(min_chars, bits, flush)), "block int, once binary, twice binary")
    return {r.block: bytes(r.bits) for r in parts.repartition("block").mapInArrow(lean(_merge), "block int, bits binary").collect()}


def _suspects(filter_, min_chars: int, bits: int):
    def run(batches):
        at = np.zeros(bits // 8, np.uint8)
        for block, data in filter_.value.items():
            at[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(zlib.decompress(data), np.uint8)
        for batch in batches:
            keys: list[bytes] = []
            rows: list[int] = []
            for k, text in enumerate(_rows(batch.column("text"))):
                own = set(digests(text, min_chars)) - {None}
                keys += own
                rows += [k] * len(own)
            if not keys:
                continue
            where = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2) & np.uint64(bits - 1)
            hit = np.flatnonzero((at[where >> np.uint64(3)] >> (where & np.uint64(7)).astype(np.uint8) & 1).all(axis=1))
            ids = batch.column("doc_id").take(pa.array(np.array(rows, np.int64)[hit]))
            own = batch.column("own").take(pa.array(np.array(rows, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit.tolist()], pa.binary()), ids.cast(pa.int64()), own], names=["key", "doc_id", "own"])

    return run


def _strip(hot, min_chars: int):
    def run(batches):
        keep_of = hot.value
        for batch in batches:
            ids, lost = batch.column("id").to_pylist(), batch.column("lost").to_pylist()
            texts, total, dropped = [], [], []
            for k, text in enumerate(_rows(batch.column("text"))):
                gone = set(lost[k] or ())
                lines, left = text.split(b"\n"), []
                for line, key in zip(lines, digests(text, min_chars)):
                    if key is None or not (key in gone or key in keep_of and keep_of[key] is not None and keep_of[key] != ids[k]):
                        left.append(line)
                texts.append(b"\n".join(left).decode("utf-8", "replace"))
                total.append(len(lines))
                dropped.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=["row", "kept", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, flush: int = FLUSH, hot_keys: int = HOT_KEYS) -> DataFrame:
    """docs with text less its repeated lines, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    prepare(spark)
    # Rows without an id are told apart by their texts: one key for all of them would be hot.
    own = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("own")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", own)
    if bits is None:
        ends = texts.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))).alias("ends"), F.count("*").alias("n")).first()
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_LINE * ((ends.ends or 0) + ends.n)).bit_length()))
    filter_ = spark.sparkContext.broadcast(repeated_filter(texts, min_chars, bits, flush))
    suspects = keep(texts.mapInArrow(lean(_suspects(filter_, min_chars, bits)), "key binary, doc_id long, own string"), "suspects")
    counted = suspects.df.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs)
    confirmed = keep(counted, "confirmed")
    # A key with more than total / hot_keys rows is hot: there are fewer than hot_keys of them.
    total = suspects.df.count()
    often = max(1000, total // hot_keys + 1)
    hot = {bytes(r.key): r.keep for r in confirmed.df.where(F.col("n") >= often).collect()}
    lost = suspects.df.join(F.broadcast(confirmed.df.where(F.col("n") >= often).select("key")), "key", "left_anti")
    lost = lost.join(confirmed.df.where(F.col("n") < often), "key").where("keep is not null and not (doc_id <=> keep)")
    lost = lost.groupBy("doc_id", "own").agg(F.collect_set("key").alias("lost"))
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row = docs.select(F.struct(*(c for c in carried if c != "text")).alias("row"), F.col("doc_id").cast("long").alias("id"), own, "text")
    joined = row.join(lost, row["id"].eqNullSafe(lost["doc_id"]) & row["own"].eqNullSafe(lost["own"]), "left").select("row", "id", "text", "lost")
    schema = T.StructType([row.schema["row"], T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = joined.mapInArrow(lean(_strip(spark.sparkContext.broadcast(hot), min_chars)), schema)
    return out.select(*(F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in carried), "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keep AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
