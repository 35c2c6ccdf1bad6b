"""Token ids in a content-addressed store.

Each text is encoded (every distinct piece of some megabytes once: this tokenizer never joins across white space),
END_ID is appended, and a rolling hash over WINDOW ids cuts the stream into chunks of AVERAGE ids on average,
within LEAST and MOST, so equal passages give equal chunks wherever they start. The store is a folder:

  chunks/    hash (16 bytes of SHA-256 of the ids' bytes), n, ids; each chunk once
  recipes/   files in ascending doc_id order: part, doc_id, first (ids before it in its part), n_tokens, the
             hashes and lengths of its chunks, and root, the Merkle root of the hashes; each part ends with
             a row that has the Merkle root of its documents' roots
  manifest/  one row per part in order (ids before the part, root), all below one root

Ids are little-endian, of 16 bits where the vocabulary allows it. Reading checks every chunk against its
hash and length, every recipe and part against its root; verify() puts each part's root together anew. The checksum of a document is put together from its chunks'
checksums, as CRC-32 is linear, so the ids themselves are not shuffled again.

Defined cases. A null or empty text is the end id alone. Null doc_ids come first. Repeated rows are documents
of their own that share all chunks. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import keep, lean, prepare, scratch_dir, tokenizer_path
from .bpe import distinct, encode_words, load

TOKENIZER, END_ID = "word_bpe_49k.json", 1
WINDOW, AVERAGE, LEAST, MOST = 16, 256, 64, 2048
CACHE, SEEN = 400_000, 300_000
#: Bytes of text whose pieces are told apart together.
CHUNK = 4 << 20
ENCODED = "doc_id long, n_tokens long, hashes binary, lengths array<int>, fresh array<struct<hash: binary, n: int, ids: binary>>"
RECIPES = "part int, doc_id long, first long, n_tokens long, hashes binary, lengths array<int>, root binary, part_root binary"


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up as it is; no leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _split(blob: bytes, size: int = 16) -> list[bytes]:
    return [blob[i : i + size] for i in range(0, len(blob), size)]


#: Odd constants by which the parts of a window are told apart.
_PLACES = K.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_ends(ids: np.ndarray, average: int = AVERAGE, window: int = WINDOW) -> np.ndarray:
    """Where a window of ids ends whose hash is 0 modulo average."""
    if len(ids) < window:
        return np.zeros(0, np.int64)
    # Twice as many ids with each step, as far as the next one fits into the window.
    rolling, size = (ids.astype(np.uint64) + np.uint64(1)) * _PLACES[0], 1
    rolling ^= rolling >> np.uint64(29)
    while size < window:
        hop = min(size, window - size)
        rolling = rolling[: len(rolling) - hop] * _PLACES[size] + rolling[hop:]
        size += hop
    return np.flatnonzero(K.mix(rolling) % np.uint64(average) == 0) + window


def cuts(n: int, hits: list[int], least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of n ids: at a hit that is not within least of the last end, and at most most apart."""
    out, last = [], 0
    for h in [*hits, n]:
        while h - last > most:
            last += most
            out.append(last)
        if h - last >= least or h == n and h > last:
            out.append(h)
            last = h
    return out


#: Ids of pieces met by this worker: those of late, and those before, which go when as many new ones have come.
_PIECES: dict[str, list[dict[bytes, bytes]]] = {}
#: Which ids end a word, by vocabulary.
_ENDS: dict[str, np.ndarray] = {}
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2


def pieces(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and start, end and row of the pieces, which the tokenizer encodes alike alone and in their text.

    It drops white space, lower-cases, and never joins a letter and a sign; so texts are cut at white space and
    between an ASCII letter and an ASCII sign other than the apostrophe, and A-Z are lower-cased. Where a text might
    name a special token, which is matched before all that, only white space cuts."""
    if b"<|" in buf.tobytes():
        return buf, *K.spans(buf, off)
    kind, cut = _KIND[buf], np.zeros(len(buf), bool)
    np.equal(kind[1:] * kind[:-1], 2, out=cut[1:])
    return K.LOWER[buf], *K.spans(buf, off, cut=cut)


def _encode_pieces(some: list[bytes], path: str, at_once: int = 500) -> list[bytes]:
    """As bpe.encode_words. Words of letters only go in lines of at_once: each of them is one word to the
    tokenizer, so the ids that end a word part them; where their number is another, they go as all others do."""
    if path not in _ENDS:
        vocabulary = load(path).get_vocab(with_added_tokens=True)
        _ENDS[path] = np.zeros(max(vocabulary.values()) + 1, bool)
        _ENDS[path][[i for name, i in vocabulary.items() if name.endswith("</w>")]] = True
    out: list[bytes | None] = [None] * len(some)
    plain = [k for k, w in enumerate(some) if w.isalpha() or w[0] > 127 and w.decode("utf-8", "replace").isalpha()]
    lines = ["\n".join([some[k].decode() for k in plain[i : i + at_once]]) for i in range(0, len(plain), at_once)]
    for i, e in zip(range(0, len(plain), at_once), load(path).encode_batch_fast(lines, add_special_tokens=False) if lines else ()):
        own, ids = plain[i : i + at_once], np.array(e.ids, np.uint32)
        ends = np.flatnonzero(_ENDS[path][ids]) + 1
        if len(ends) == len(own):
            data, begin = ids.tobytes(), 0
            for k, end in zip(own, (4 * ends).tolist()):
                out[k] = data[begin:end]
                begin = end
    rest = [k for k, x in enumerate(out) if x is None]
    for k, x in zip(rest, encode_words([some[k] for k in rest], path)):
        out[k] = x
    return out


def _ids_of(words: list[bytes], path: str) -> list[bytes]:
    young, old = kept = _PIECES.setdefault(path, [{}, {}])
    if len(young) > CACHE:
        kept[:] = young, old = {}, young
    missing = []
    for w in words:
        if w not in young:
            if (x := old.get(w)) is None:
                missing.append(w)
            else:
                young[w] = x
    young.update(zip(missing, _encode_pieces(missing, path)))
    return [young[w] for w in words]


def encoded_rows(column: pa.Array, path: str, end_id: int | None = None):
    """The ids of the texts of a column, some texts at a time: all ids in a row, and each text's bounds. Each text is
    followed by end_id, if given."""
    buf, off = K.buffers(column)
    more = int(end_id is not None)
    for i, j in K.chunks(off, CHUNK):
        part, start, end, row = pieces(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        words, inverse, _ = distinct(part, start, end)
        blobs = _ids_of(words, path)
        if more:  # as one more piece of each text
            place = np.searchsorted(row, np.arange(1, j - i + 1))
            inverse, row = np.insert(inverse, place, len(blobs)), np.insert(row, place, np.arange(j - i))
            blobs.append(np.uint32(end_id).tobytes())
        offsets = np.append(0, np.cumsum([len(b) // 4 for b in blobs])).astype(np.int64)
        ids, size = K.ragged(np.frombuffer(b"".join(blobs), np.uint32), offsets, inverse)
        yield ids, np.append(0, np.cumsum(size))[np.searchsorted(row, np.arange(j - i + 1))]


def _encode(path: str, end_id: int, kind: str):
    width = np.dtype(kind).itemsize

    def run(batches):
        seen: set[bytes] = set()
        sha = hashlib.sha256
        for batch in batches:
            # Per text: its ids, and its chunks' hashes. Per chunk: its length. Per fresh chunk: hash, length, ids.
            total, hashes, lengths, bounds, fresh, fresh_bounds = [], [], [], [0], ([], [], []), [0]
            for ids, place in encoded_rows(batch.column("text"), path, end_id):
                hits, data, place = window_ends(ids), ids.astype(kind).tobytes(), place.tolist()
                hit_of, hits = np.searchsorted(hits, place, "right").tolist(), hits.tolist()
                for k, (begin, stop) in enumerate(zip(place, place[1:])):
                    own, last = [], 0
                    # A window that begins in the text before ends within least of this one's start.
                    for end in cuts(stop - begin, [h - begin for h in hits[hit_of[k] : hit_of[k + 1]]]):
                        piece = data[width * (begin + last) : width * (begin + end)]
                        h = sha(piece).digest()[:16]
                        own.append(h)
                        lengths.append(end - last)
                        if h not in seen:
                            seen.add(h)
                            for column, x in zip(fresh, (h, end - last, piece)):
                                column.append(x)
                        last = end
                    total.append(last)
                    hashes.append(b"".join(own))
                    bounds.append(len(lengths))
                    fresh_bounds.append(len(fresh[0]))
            if len(seen) > SEEN:  # a chunk may then be sent once more
                seen.clear()
            new = pa.StructArray.from_arrays([pa.array(fresh[0], pa.binary()), pa.array(fresh[1], pa.int32()), pa.array(fresh[2], pa.binary())], names=["hash", "n", "ids"])
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), x) for o, x in ((bounds, pa.array(lengths, pa.int32())), (fresh_bounds, new))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(hashes, pa.binary()), *lists], names=["doc_id", "n_tokens", "hashes", "lengths", "fresh"])

    return run


def _once(batches):
    """Rows arrive in the order of their hashes; the first of each stays."""
    last = None
    for batch in batches:
        hashes = batch.column("hash").to_pylist()
        mask = [h != (hashes[k - 1] if k else last) for k, h in enumerate(hashes)]
        last = hashes[-1] if hashes else last
        yield batch.filter(pa.array(mask, pa.bool_()))


def _recipes(batches):
    """Adds the part, the ids before each document in it, the roots, and the part's closing row."""
    part, first, roots = TaskContext.get().partitionId(), 0, []
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("hashes", pa.binary()), ("lengths", pa.list_(pa.int32())), ("root", pa.binary()), ("part_root", pa.binary())])
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        before = first + np.cumsum(n) - n
        first += int(n.sum())
        own = [merkle(_split(h)) for h in batch.column("hashes").to_pylist()]
        roots += own
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int32()), batch.column("doc_id"), pa.array(before, pa.int64()), batch.column("n_tokens"), batch.column("hashes"), batch.column("lengths"), pa.array(own, pa.binary()), pa.nulls(len(n), pa.binary())], schema=schema)
    if roots:
        yield pa.RecordBatch.from_pylist([{"part": part, "doc_id": None, "first": first, "n_tokens": 0, "hashes": b"", "lengths": [], "root": b"", "part_root": merkle(roots)}], schema=schema)


def _roots(batches):
    """The root of each part, from its documents' roots; rows arrive by part and place, the closing row last."""
    part, first, roots = None, 0, []
    for batch in batches:
        out = []
        for own, place, n, root, closing in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "n_tokens", "root", "part_root"))):
            if own != part:
                part, first, roots = own, 0, []
            if place != first:
                raise ValueError(f"part {part} has no row or more than one at {first}")
            if closing is not None:
                out.append((part, merkle(roots), closing))
            else:
                roots.append(root)
                first += n
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2))], names=["part", "own", "part_root"])


#: Reflected CRC-32 polynomial, fixed by the checksum's definition.
_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two polynomials modulo the CRC's, in its reflected bit order, elementwise."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros_like(a)
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(_POLY), np.uint64(0))
    return out


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What the checksum of a piece adds to that of a whole with that many bytes after it."""
    out, n = crc.astype(np.uint64), zeros.astype(np.int64) * 8
    step = np.array([1 << 30], np.uint64)  # x to the power 1
    while n.any():
        odd = (n & 1).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(step, (int(odd.sum()),)))
        step, n = _times(step, step), n >> 1
    return out


def _checked(kind: str):
    def run(batches):
        for batch in batches:
            crc, n = [], []
            hashes = batch.column("hash").to_pylist()
            for h, data in zip(hashes, batch.column("ids").to_pylist()):
                if hashlib.sha256(data).digest()[:16] != h:
                    raise ValueError(f"chunk {h.hex()} does not match its hash")
                ids = np.frombuffer(data, kind)
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crc, pa.int64()), pa.array(n, pa.int32())], names=["hash", "crc", "n"])

    return run


def _steps(batches):
    """A row per chunk of each recipe, after the recipe has been held against its root."""
    for batch in batches:
        hashes, blobs = [], batch.column("hashes").to_pylist()
        for blob, root in zip(blobs, batch.column("root").to_pylist()):
            own = _split(blob)
            if merkle(own) != root:
                raise ValueError("a recipe does not match its root")
            hashes += own
        n = np.array([len(x) // 16 for x in blobs], np.int64)
        length = batch.column("lengths").flatten().to_numpy().astype(np.int64)
        if len(length) != len(hashes):
            raise ValueError("a recipe has more or fewer lengths than chunks")
        rows, begin, upto = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n, np.append(0, np.cumsum(length))
        after = 4 * (upto[(begin + n)[rows]] - upto[1:])
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("part", "first", "doc_id")), pa.array(hashes, pa.binary()), pa.array((np.arange(len(rows)) - begin[rows]).astype(np.int32)), pa.array(after), pa.array(length.astype(np.int32))], names=["part", "first", "doc_id", "hash", "pos", "after", "length"])


def _shift(batches):
    for batch in batches:
        value = shifted_crc(batch.column("crc").to_numpy(), batch.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "first", "doc_id", "length")), pa.array(value.astype(np.int64))], names=["part", "first", "doc_id", "length", "crc"])


class Store:
    """A written store."""

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self.spark, self.path, self.kind = spark, path, kind

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def steps(self) -> DataFrame:
        recipes = self.table("recipes").where("part_root is null").select("part", "first", "doc_id", "hashes", "lengths", "root")
        return recipes.mapInArrow(lean(_steps), "part int, first long, doc_id long, hash binary, pos int, after long, length int")

    def summary(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 from the files, every chunk and recipe checked."""
        chunks = self.table("chunks").select("hash", "ids").mapInArrow(lean(_checked(self.kind)), "hash binary, crc long, n int")
        crc = F.when(F.col("n") == F.col("length"), F.col("crc")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing or of another length"))).alias("crc")
        steps = self.steps().join(chunks, "hash", "left").select("part", "first", "doc_id", "length", crc, "after").mapInArrow(lean(_shift), "part int, first long, doc_id long, length int, crc long")
        docs = steps.groupBy("part", "first", "doc_id").agg(F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
        parts = self.table("manifest").select("part", "before")  # a row per file of recipes
        return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")

    def documents(self) -> DataFrame:
        """doc_id, start, ids (array<int>): every document put together again."""
        chunks = self.table("chunks").select("hash", "ids")
        ids = F.when(F.length("ids") == F.col("length") * np.dtype(self.kind).itemsize, F.col("ids")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing or of another length")))
        pieces = self.steps().join(chunks, "hash", "left").withColumn("ids", ids).groupBy("part", "first", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("pieces"))
        parts = self.table("manifest").select("part", "before")
        return pieces.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("pieces.ids").alias("pieces")).mapInArrow(lean(_joined(self.kind)), "doc_id long, start long, ids array<int>")

    def verify(self) -> bytes:
        """Holds every part, its root put together anew from its recipes', against its manifest; the root of all."""
        rows = self.table("manifest").orderBy("part").collect()
        if rows and merkle([bytes(r.root) for r in rows]) != bytes(rows[0].top):
            raise ValueError("the manifest does not match its root")
        recipes = self.table("recipes").select("part", "first", "n_tokens", "root", "part_root").repartition("part").sortWithinPartitions("part", "first", F.col("part_root").isNotNull())
        found = {r.part: (bytes(r.own), bytes(r.part_root)) for r in recipes.mapInArrow(lean(_roots), "part int, own binary, part_root binary").collect()}
        if found != {r.part: (bytes(r.root), bytes(r.root)) for r in rows}:
            raise ValueError("a part does not match the manifest")
        return bytes(rows[0].top) if rows else merkle([])


def _joined(kind: str):
    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p), kind).astype(np.int32) for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> Store:
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = tokenizer or tokenizer_path(TOKENIZER)
    kind = "<u2" if max(load(vocabulary).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = keep(texts.mapInArrow(lean(_encode(vocabulary, end_id, kind)), ENCODED), "encoded")
    fresh = encoded.df.select(F.explode("fresh").alias("c")).select("c.hash", "c.n", "c.ids")
    fresh.repartition("hash").sortWithinPartitions("hash").mapInArrow(lean(_once), "hash binary, n int, ids binary").write.option("compression", "zstd").parquet(f"{path}/chunks")
    ranged = encoded.df.select("doc_id", "n_tokens", "hashes", "lengths").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "hashes")
    ranged.mapInArrow(_recipes, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    encoded.drop()
    store = Store(spark, path, kind)
    ends = store.table("recipes").where("part_root is not null").select("part", F.col("first").alias("n_tokens"), F.col("part_root").alias("root")).orderBy("part").collect()
    rows, before = [], 0
    top = merkle([bytes(r.root) for r in ends])
    for r in ends:
        rows.append((r.part, before, r.n_tokens, bytes(r.root), top))
        before += r.n_tokens
    spark.createDataFrame(rows, "part int, before long, n_tokens long, root binary, top binary").coalesce(1).write.parquet(f"{path}/manifest")
    return store


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    store = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_dir(spark)}/store-{uuid.uuid4().hex[:12]}")
    store.verify()
    return store.summary()
