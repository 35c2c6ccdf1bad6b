"""BPE encoding and decoding by a table of distinct words.

A word here is a piece of text that the tokenizer encodes alike alone and in its text: texts are cut before a
space that follows a character other than white space, where no token of a byte-level BPE can cross.

1. Count: tasks send their distinct words with counts in compressed blocks by a hash, merged into one row
   per distinct word.
2. The most frequent words, at most HEAD_WORDS and HEAD_BYTES, are the table: each is encoded once, and its
   ids are kept under a 128-bit digest. The bound makes it a broadcast at any size of the input.
3. Texts become their words' numbers in the table, and the ids are joined back by position. A word beyond
   the table is rare (fewer occurrences than any word in it) and is encoded where it stands: sending such
   words and their documents through a join takes more disk than they are worth (see the README).
4. Decoding joins ids to the vocabulary's pieces (its size is the bound of that broadcast) and reads the
   bytes as UTF-8.

The result does not depend on the table's bounds.

Defined cases. A null or empty text has no ids. A null doc_id is carried. Repeated rows are encoded each. The
text of a special token is encoded as the library does, as that token. An empty table gives an empty
table. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import keep, lean, prepare, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
HEAD_WORDS, HEAD_BYTES = 1_000_000, 64 << 20
BUCKETS, FLUSH = 1024, 250_000
_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer, once in a worker, without truncation, padding or threads of its own."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True


def before_spaces(buf: np.ndarray) -> np.ndarray:
    """Places of the spaces whose predecessor is not white space; one that may be white space beyond ASCII counts as such."""
    at = np.flatnonzero(buf == 32)
    at = at[at > 0]
    one, two, three = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    blank = _BLANK[one] | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    blank |= (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
    return at[~blank]


def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words, which tile their rows. Cut before a space whose predecessor is not
    white space."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n, bool)
    first[before_spaces(buf)] = True
    first[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(first)
    return start, np.append(start[1:], n), np.searchsorted(off, start, "right") - 1


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of spans, the number of each span's word, and counts."""
    index, inverse = K.equal_spans(buf, start, end)
    data = buf.tobytes()
    return [data[i:j] for i, j in zip(start[index].tolist(), end[index].tolist())], inverse, np.bincount(inverse, minlength=len(index))


def _cut_chunks(column: pa.Array):
    buf, off = K.buffers(column)
    for i, j in K.chunks(off):
        part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end, row = cut(part, o)
        yield i, j, row, *distinct(part, start, end)


def _pack(counts: dict[bytes, int]) -> pa.RecordBatch:
    by: dict[int, list[bytes]] = {}
    for w in counts:
        by.setdefault(zlib.crc32(w) % BUCKETS, []).append(w)
    data = []
    for words in by.values():
        words.sort()
        head = np.array([[len(w) for w in words], [counts[w] for w in words]], np.uint32)
        data.append(zlib.compress(np.uint32(len(words)).tobytes() + head.tobytes() + b"".join(words), 1))
    return pa.RecordBatch.from_arrays([pa.array(by.keys(), pa.int32()), pa.array(data, pa.binary())], names=["bucket", "words"])


def _count(cutter):
    def run(batches):
        counts: dict[bytes, int] = {}
        for batch in batches:
            for *_, words, _, n in cutter(batch.column("text")):
                for w, k in zip(words, n.tolist()):
                    counts[w] = counts.get(w, 0) + k
                if len(counts) >= FLUSH:
                    yield _pack(counts)
                    counts = {}
        if counts:
            yield _pack(counts)

    return run


def _merge(batches):
    counts: dict[bytes, int] = {}
    for batch in batches:
        for blob in batch.column("words").to_pylist():
            data = zlib.decompress(blob)
            m = int(np.frombuffer(data, np.uint32, 1)[0])
            size, n = np.frombuffer(data, np.uint32, 2 * m, 4).reshape(2, m)
            at = 4 + 8 * m
            for s, k in zip(size.tolist(), n.tolist()):
                w = data[at : at + s]
                counts[w] = counts.get(w, 0) + k
                at += s
    words = list(counts)
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])


def distinct_words(docs: DataFrame, cutter=_cut_chunks) -> DataFrame:
    """(word, n): every distinct word of docs' texts, as cutter cuts them, with its count."""
    parts = docs.select("text").mapInArrow(lean(_count(cutter)), "bucket int, words binary")
    return parts.repartition("bucket").mapInArrow(lean(_merge), "word binary, n long")


def encode_words(words: list[bytes], path: str, at_once: int = 200) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers.

    Words go to the library many at a time with a special token between them, which always ends a piece of
    text, so each is encoded as if alone; a word that holds the token's text goes by itself."""
    t = load(path)
    mark, mark_id = next(((x.content, i) for i, x in sorted(t.get_added_tokens_decoder().items()) if x.special), (None, None))
    one = lambda w: array("I", t.encode(w, add_special_tokens=False).ids).tobytes()
    texts = [w.decode("utf-8", "replace") for w in words]
    if mark is None:
        return [one(x) for x in texts]
    alone = {k for k, x in enumerate(texts) if mark in x}
    rest = [x for k, x in enumerate(texts) if k not in alone] if alone else texts
    out: list[bytes] = []
    joined = [mark.join(rest[i : i + at_once]) for i in range(0, len(rest), at_once)]
    for e, i in zip(t.encode_batch(joined, add_special_tokens=False), range(0, len(rest), at_once)):
        ids = np.array(e.ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == mark_id), len(ids))
        data, begin = ids.tobytes(), 0
        for end in ends.tolist():
            out.append(data[4 * begin : 4 * end])
            begin = end + 1
    if alone:
        found = iter(out)
        out = [one(x) if k in alone else next(found) for k, x in enumerate(texts)]
    return out


def _encode_head(path: str, prefix: bytes):
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(w) for w in words], pa.binary()), batch.column("n"), pa.array(encode_words([prefix + w for w in words], path), pa.binary())], names=["digest", "n", "ids"])

    return run


class Head(NamedTuple):
    """Words by digest: its 128 bits in two, in ascending order, the words' counts and ids."""

    high: np.ndarray
    low: np.ndarray
    n: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    least: int | None  # all words with this count or more are here


def head_of(words: DataFrame, path: str, most: int = HEAD_WORDS, most_bytes: int = HEAD_BYTES, prefix: bytes = b"") -> Head:
    """The words that are at least as frequent as the least count for which the bounds hold."""
    sizes = sorted(words.groupBy("n").agg(F.count("*").alias("words"), F.sum(F.length("word") * 4 + 36).alias("bytes")).collect(), reverse=True)
    least, w, b = None, 0, 0
    for r in sizes:
        w, b = w + r.words, b + r.bytes
        if w > most or b > most_bytes:
            break
        least = r.n
    rows = words.where(F.col("n") >= least) if least is not None else words.limit(0)
    t = rows.mapInArrow(lean(_encode_head(path, prefix)), "digest binary, n long, ids binary").toArrow()
    digest, _ = K.buffers(t.column("digest").combine_chunks()) if t.num_rows else (np.empty(0, np.uint8), None)
    data, off = K.buffers(t.column("ids").combine_chunks()) if t.num_rows else (np.empty(0, np.uint8), np.zeros(1, np.int64))
    key = np.frombuffer(digest.tobytes(), np.uint64).reshape(-1, 2)
    order = np.lexsort((key[:, 1], key[:, 0]))
    ids, size = K.ragged(np.frombuffer(data.tobytes(), np.uint32), off // 4, order)
    # As narrow as the values allow: the table is copied to every executor.
    if not len(ids) or ids.max() < 1 << 16:
        ids = ids.astype(np.uint16)
    n = np.minimum(t.column("n").to_numpy()[order], (1 << 63) - 1)
    return Head(key[order, 0], key[order, 1], n.astype(np.int32) if not len(n) or n.max() < 1 << 31 else n, np.append(0, np.cumsum(size)).astype(np.uint32 if len(ids) < 1 << 32 else np.int64), ids, least)


def _lookup(head: Head, words: list[bytes]) -> np.ndarray:
    """Number of each word in the head, -1 for others."""
    if not words or not len(head.high):
        return np.full(len(words), -1, np.int64)
    key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    at = np.searchsorted(head.high, key[:, 0])
    at[at == len(head.high)] = 0
    return np.where((head.high[at] == key[:, 0]) & (head.low[at] == key[:, 1]), at, -1)


def _ids(head_, path: str):
    """Texts as ids: the table's by number, those of other words encoded here, all joined by position."""

    def run(batches):
        head = head_.value
        for batch in batches:
            out, n = [], []
            for i, j, row, words, inverse, _ in _cut_chunks(batch.column("text")):
                at = _lookup(head, words)
                rare = np.flatnonzero(at < 0)
                own = [np.frombuffer(x, np.uint32) for x in encode_words([words[k] for k in rare.tolist()], path)]
                # One table for the chunk: its words of the head, then its rare ones.
                known, size = K.ragged(head.ids, head.offsets, at[at >= 0])
                length = np.zeros(len(words), np.int64)
                length[at >= 0], length[rare] = size, [len(x) for x in own]
                begin = np.zeros(len(words), np.int64)
                begin[at >= 0] = np.cumsum(size) - size
                begin[rare] = len(known) + np.cumsum(length[rare]) - length[rare]
                values = np.concatenate([known, *own])
                take = length[inverse]
                ends = np.cumsum(take)
                ids = values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[inverse] - (ends - take), take)].astype("<u4")
                bound = np.append(0, ends)[np.searchsorted(row, np.arange(j - i + 1))]
                for k in range(j - i):
                    out.append(ids[bound[k] : bound[k + 1]].tobytes())
                n += np.diff(bound).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _with_head(docs: DataFrame, tokenizer: str | None, head_words: int, head_bytes: int):
    """The texts of docs and the function over their batches that gives ids."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path(TOKENIZER)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = keep(distinct_words(texts), "words")
    head = spark.sparkContext.broadcast(head_of(words.df, path, head_words, head_bytes))
    words.drop()
    return texts, _ids(head, path), path


def encode(docs: DataFrame, tokenizer: str | None = None, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of each row of docs."""
    texts, ids, _ = _with_head(docs, tokenizer, head_words, head_bytes)
    return texts.mapInArrow(lean(ids), "doc_id long, n_tokens long, ids binary")


def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary as a table from id to bytes: all bytes in a row, and offsets by id. Byte-level pieces
    name bytes by characters: printable ones by themselves, the other 68 by 256 and up."""
    t = load(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    size = max(t.get_vocab(with_added_tokens=True).values()) + 1
    table = []
    for i in range(size):
        piece = t.id_to_token(i) or ""
        table.append(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())
    return np.frombuffer(b"".join(table), np.uint8), np.append(0, np.cumsum([len(x) for x in table]))


def _decode(table):
    def run(batches):
        data, off = table.value
        for batch in batches:
            texts = [K.ragged(data, off, np.frombuffer(x or b"", "<u4").astype(np.int64))[0].tobytes().decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """encoded with the text of its ids (special tokens kept)."""
    spark = encoded.sparkSession
    prepare(spark)
    table = spark.sparkContext.broadcast(pieces(tokenizer or tokenizer_path(TOKENIZER)))
    base = encoded.drop("text")
    return base.mapInArrow(lean(_decode(table)), base.withColumn("text", F.lit("")).schema)


def _digest(batches):
    """SHA-256 of the text, and of the decimal ids joined by commas, with a table of each id's decimals and comma."""
    data = off = None
    for batch in batches:
        of_ids, of_text = [], []
        for x, text in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist()):
            ids = np.frombuffer(x, "<u4").astype(np.int64)
            if len(ids) and (off is None or int(ids.max()) >= len(off) - 1):
                names = [b"%d," % k for k in range(int(ids.max()) + 4096)]
                data, off = np.frombuffer(b"".join(names), np.uint8), np.append(0, np.cumsum([len(n) for n in names]))
            of_ids.append(hashlib.sha256(K.ragged(data, off, ids)[0][:-1] if len(ids) else b"").hexdigest())
            of_text.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, tokenizer: str | None = None, head_words: int = HEAD_WORDS) -> DataFrame:
    """encode, decode and digest in one worker: batches pass from one to the next without leaving it."""
    texts, ids, path = _with_head(docs, tokenizer, head_words, HEAD_BYTES)
    decoded = _decode(docs.sparkSession.sparkContext.broadcast(pieces(path)))
    return texts.mapInArrow(lean(lambda batches: _digest(decoded(ids(batches)))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
