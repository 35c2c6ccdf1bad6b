"""Packing: documents in sequences of LENGTH ids with little padding, by shortest-pack-first over the histogram of lengths.

1. Each text is encoded once (every distinct piece of some megabytes once, with what a worker has met before kept)
   and END_ID is appended. Whole multiples of LENGTH are sequences of their own; what is left over is one piece of
   1 to LENGTH - 1 ids, numbered among those of its length in its task.
2. The counts by length, LENGTH numbers at most whatever the input, are packed on the driver: lengths from the
   longest down, each into the packs that are filled least, if it fits there, else into new ones. Packs filled
   alike are one pattern with a count, so a step places as many pieces as there are such packs. A pattern that
   would be padded by more than MOST_PADDING ids is cut at the binary digits of its size into sequences of a power of
   two, which take no padding.
3. Patterns go back to the documents by rank: those of one length fill the pattern's places in order of their
   numbers. A task's first number of each length is a sum over the tasks before it. Patterns are at most a few
   for each length and are sent to all tasks; the tasks' first numbers only up to BROADCAST_NUMBERS, else they are joined.

Sequences are numbered without gaps: packs first, whole ones after them.

Defined cases. A null or empty text is the end id alone. A null doc_id is carried. Repeated rows are packed each. The text
of a special token is encoded as the library does, as that token. An empty table gives an empty table. Texts of any
length are packed whole. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from . import bpe
from ._common import Table, keep, lean, prepare, tokenizer_path

TOKENIZER, LENGTH, END_ID, MOST_PADDING = "byte_bpe_50k.json", 2048, 1, 64
BROADCAST_NUMBERS = 2_000_000
CACHE, CHUNK = 400_000, 4 << 20
ENCODED = "part int, doc_id long, n_tokens long, ids binary, rest int, number long, whole long"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# ---- encoding

#: Ids of pieces of text met by this worker: those of late, and those before, which go when as many new ones have come.
_MET: dict[str, list[dict[bytes, bytes]]] = {}
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2


def pieces_of_text(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As bpe.cut, and cut as well between an ASCII letter and a sign other than the apostrophe, and around a line
    break after an ASCII sign or letter, where no token crosses either. A text that may name a special token is cut
    at spaces only."""
    cut = np.zeros(len(buf) + 1, bool)
    cut[bpe.before_spaces(buf)] = True
    cut[off[:-1]] = True
    if b"<|" not in buf.tobytes():
        kind = np.append(_KIND[buf], np.uint8(0))
        cut[1:] |= kind[1:] * kind[:-1] == 2
        lines = np.flatnonzero((buf[1:] == 10) & (buf[:-1] > 32) & (buf[:-1] < 127)) + 1
        cut[lines] = True
        cut[lines[kind[lines + 1] == 1] + 1] = True
    start = np.flatnonzero(cut[:-1])
    return start, np.append(start[1:], len(buf))[: len(start)], K.rows_of(start, off)


def _ids_of(words: list[bytes], path: str) -> list[bytes]:
    young, old = kept = _MET.setdefault(path, [{}, {}])
    if len(young) > CACHE:
        kept[:] = young, old = {}, young
    missing = []
    for w in words:
        if w not in young:
            if (x := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = x
    young.update(zip(missing, bpe.encode_words(missing, path)))
    return [young[w] for w in words]


def _encode(path: str, end_id: int, length: int, kind: str):
    end = np.array([end_id], kind).tobytes()

    def run(batches):
        part, numbers, whole = TaskContext.get().partitionId(), np.zeros(length, np.int64), 0
        for batch in batches:
            blobs, n = [], []
            buf, off = K.buffers(batch.column("text"))
            for i, j in K.chunks(off, CHUNK):
                own, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                begin, stop, row = pieces_of_text(own, o)
                words, inverse, _ = bpe.distinct(own, begin, stop)
                table = _ids_of(words, path)
                places = np.append(0, np.cumsum([len(x) // 4 for x in table])).astype(np.int64)
                ids, size = K.ragged(np.frombuffer(b"".join(table), "<u4").astype(kind), places, inverse)
                bound = np.append(0, np.cumsum(size))[np.searchsorted(row, np.arange(j - i + 1))].tolist()
                blobs += [ids[a:b].tobytes() + end for a, b in zip(bound, bound[1:])]
                n += [b - a + 1 for a, b in zip(bound, bound[1:])]
            n = np.array(n, np.int64)
            rest, full = n % length, n // length
            number = np.zeros(len(n), np.int64)
            for k, r in enumerate(rest.tolist()):
                number[k] = numbers[r]
                numbers[r] += 1
            before = whole + np.cumsum(full) - full
            whole += int(full.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(n), pa.array(blobs, pa.binary()), pa.array(rest.astype(np.int32)), pa.array(number), pa.array(before)],
                names=["part", "doc_id", "n_tokens", "ids", "rest", "number", "whole"],
            )

    return run


# ---- patterns


class Pattern(NamedTuple):
    """count packs, each of these lengths with their copies."""

    count: int
    lengths: tuple[tuple[int, int], ...]

    @property
    def size(self) -> int:
        return sum(n * copies for n, copies in self.lengths)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[Pattern]:
    """Packs for that many pieces of each length: longest first, each into the shortest pack, if it fits there."""
    open_: dict[int, list[Pattern]] = {}  # by the space that is left
    spaces: list[int] = []
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        spaces = sorted(s for s in open_ if s)
        while left:
            space = spaces[-1] if spaces else 0
            if space < n:
                each = length // n
                new = [Pattern(left // each, ((n, each),)), Pattern(1, ((n, left % each),))]
                new, left = [p for p in new if p.count and p.lengths[0][1]], 0
            else:
                old = open_[space].pop()
                if not open_[space]:
                    del open_[space]
                    spaces.pop()
                took = min(left, old.count)
                left -= took
                same = old.lengths[-1][0] == n
                new = [Pattern(took, (*old.lengths[:-1], (n, old.lengths[-1][1] + 1)) if same else (*old.lengths, (n, 1)))]
                if took < old.count:
                    new.append(old._replace(count=old.count - took))
            for p in new:
                space = length - p.size
                open_.setdefault(space, []).append(p)
                if space and space not in spaces:
                    spaces.append(space)
                    spaces.sort()
    return [p for s in sorted(open_) for p in open_[s]]


def sizes(fill: int, length: int = LENGTH, most_padding: int = MOST_PADDING) -> list[int]:
    """The sequences of a pack of that size: one, or its binary digits, where one would be padded too much."""
    if fill & (fill - 1) == 0 or length - fill <= most_padding:
        return [fill]
    return [1 << k for k in reversed(range(fill.bit_length())) if fill >> k & 1]


class Places(NamedTuple):
    """Where a pattern puts pieces: rows by length and first number; first is counted over all lengths."""

    base: np.ndarray  # by length: pieces of all shorter lengths
    first: np.ndarray
    copies: np.ndarray
    at: np.ndarray  # in the pack
    sequence: np.ndarray  # of the pattern's first pack
    each: np.ndarray  # sequences a pack
    bounds: np.ndarray  # of its sequences, the last one repeated
    n_sequences: int


def places(packs: list[Pattern], length: int = LENGTH, most_padding: int = MOST_PADDING) -> Places:
    used, rows, sequence, wide = {}, [], 0, length.bit_length() + 1
    for p in packs:
        own = sizes(p.size, length, most_padding)
        bounds = [0, *np.cumsum(own).tolist()]
        bounds += [p.size] * (wide - len(bounds))
        at = 0
        for n, copies in p.lengths:
            first = used.get(n, 0)
            rows.append((n, first, copies, at, sequence, len(own), bounds))
            used[n] = first + p.count * copies
            at += n * copies
        sequence += p.count * len(own)
    base = np.append(0, np.cumsum([used.get(n, 0) for n in range(length + 1)]))[: length + 1].astype(np.int64)
    rows.sort(key=lambda r: r[:2])
    column = lambda k: np.array([r[k] for r in rows], np.int64)
    bounds = np.array([r[6] for r in rows], np.int64).reshape(-1, wide)
    return Places(base, base[column(0)] + column(1), column(2), column(3), column(4), column(5), bounds, sequence)


def _place(table, length: int, kind: str):
    def run(batches):
        p = table.value
        for batch in batches:
            blobs = batch.column("ids").to_pylist()
            n, rest, number, whole = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "rest", "number", "whole"))
            full = n // length
            # Whole sequences.
            row = np.repeat(np.arange(len(n)), full)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            found = [(row, nth * length, np.full(len(row), length), p.n_sequences + whole[row] + nth, np.zeros(len(row), np.int64))]
            # What is left over, cut where its pack is.
            row = np.flatnonzero(rest)
            if len(row):
                size = rest[row]
                rank = p.base[size] + number[row]
                slot = np.searchsorted(p.first, rank, "right") - 1
                pack, copy = np.divmod(rank - p.first[slot], p.copies[slot])
                at = p.at[slot] + copy * size
                low, high = p.bounds[slot, :-1], p.bounds[slot, 1:]
                begin, end = np.maximum(at[:, None], low), np.minimum((at + size)[:, None], high)
                k, part = np.nonzero(end > begin)
                begin, end = begin[k, part], end[k, part]
                found.append((row[k], length * full[row[k]] + begin - at[k], end - begin, p.sequence[slot[k]] + pack[k] * p.each[slot[k]] + part, begin - low[k, part]))
            row, start, size, sequence, offset = (np.concatenate(x) for x in zip(*found))
            width = np.dtype(kind).itemsize
            ids = [np.frombuffer(blobs[r], kind, m, width * s).astype("<u4").tobytes() for r, s, m in zip(row.tolist(), start.tolist(), size.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), pa.array(start), pa.array(size), pa.array(ids, pa.binary()), batch.column("n_tokens").take(take), pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, most_padding: int = MOST_PADDING, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """doc_id, start, length, ids (binary: little-endian unsigned 32-bit integers), doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path(TOKENIZER)
    kind = "<u2" if max(bpe.load(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = keep(texts.mapInArrow(lean(_encode(path, end_id, length, kind)), ENCODED), "encoded")
    numbers = first_numbers(encoded, length)
    total = numbers.df.groupBy("rest").agg(F.sum("n").alias("n")).where(F.col("rest") < length).collect()  # one row a length
    table = places(patterns({r.rest: r.n for r in total}, length), length, most_padding)
    before = numbers.df.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "before"))).alias("before"))
    if numbers.df.count() <= broadcast_numbers:
        before = F.broadcast(before)
    own = lambda key: F.coalesce(F.try_element_at("before", key), F.lit(0))
    ranked = encoded.df.join(before, "part").select("doc_id", "n_tokens", "ids", "rest", (F.col("number") + own(F.col("rest"))).alias("number"), (F.col("whole") + own(F.lit(length))).alias("whole"))
    return ranked.mapInArrow(lean(_place(spark.sparkContext.broadcast(table), length, kind)), PIECES)


def first_numbers(encoded: Table, length: int) -> Table:
    """(part, rest, n, before): pieces of each length in a task, and in the tasks before it; whole ones under length."""
    docs = encoded.df.select("part", "rest", F.expr(f"n_tokens div {length}").alias("full"))
    some = docs.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n"))
    every = some.union(docs.groupBy("part").agg(F.sum("full").alias("n")).select("part", F.lit(length).alias("rest"), "n"))
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part")) - F.col("n")
    return keep(every.select("part", "rest", "n", before.alias("before")), "numbers")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (padded to length, except at a power of two), documents (doc_id, start, offset, length)."""
    one = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("of"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("of.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    padding = F.when(F.expr("bit_count(n_tokens) = 1"), 0).otherwise(length - F.col("n_tokens")).cast("int")
    pad = F.lit(int(pad_id).to_bytes(4, "little") * length)
    documents = F.transform("of", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return one.select("sequence_id", "n_tokens", F.concat(ids, F.substring(pad, F.lit(1), 4 * padding)).alias("ids"), documents.alias("documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
