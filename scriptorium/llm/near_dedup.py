"""MinHash near-duplicate detection with tensored banding.

Two small collections of M half-keys are computed, each a hash of HALF minhashes. The tables' keys are the
pairs of a half-key of the first collection and one of the second: M * M = 196 tables from 2 * M * HALF = 84
minhashes instead of 1176. A pair of resemblance s is missed by all tables if no half of one collection
agrees, which has the chance 1 - (1 - (1 - s^HALF)^M)^2: 3e-6 at 0.85.

Documents with equal sets are one class before any banding, so a group of copies is one row. Every
candidate is verified on the full shingle sets. What is wanted are components, so a bucket inside one
component is done and never emits its pairs. The rounds go from cheap to exact:

1. Diagonal tables (half i with half i): one centre per bucket against the members of other components.
2. A class is settled if no half-key bucket of one collection reaches another component. The others,
   the active ones, make all their M * M keys, with new centres.
3. Deep tables: keys of two halves of each collection, (i, i + t) with (j, j + t), t by round. A large
   group whose members mostly resemble each other below the threshold falls into small buckets.
4. What is still active is joined exactly by prefix filtering: two sets that are linked share one of their
   n - ceil(0.85 n) + 1 rarest shingles, at places that leave enough to share. So a template that thousands share makes no pairs, and no link of
   active classes is lost to the choice of centres.

Defined cases. No text or no words: n_shingles 0, component_id = doc_id, kept. doc_id null: not compared
(component_id null, kept true), as it cannot name a component. Repeated rows share one component and are all
kept if they hold its smallest doc_id. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import keep, lean, prepare, Table

M, HALF, DEEP_ROUNDS = 14, 3, 1
#: Linked with 100 * intersection >= 85 * union.
NUM, DEN = 85, 100
SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, ka array<long>, kb array<long>"


def _constants(n: int) -> np.ndarray:
    return K.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array):
    """(first row of a chunk, its rows, hashes, their rows) for each chunk of a column of texts."""
    buf, off = K.buffers(texts)
    for i, j in K.chunks(off):
        part, o = K.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end, row = K.spans(part, o)
        yield i, j - i, *K.shingles(K.span_hashes(part, start, end), row, j - i)


def _sketch(batches):
    a, b = _constants(4 * M * HALF).reshape(2, -1)
    salt = _constants(8 * M)[-2 * M :]
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ka", pa.list_(pa.int64())), ("kb", pa.list_(pa.int64()))])
    for batch in batches:
        rows = batch.num_rows
        count, f1, f2 = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
        keys = np.zeros((rows, 2 * M), np.uint64)
        for first, n, h, at in shingle_sets(batch.column("text")):
            if not len(h):
                continue
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            who = at[cut] + first
            for k, piece in zip(who.tolist(), np.split(h, cut[1:])):
                s = np.unique(piece)
                count[k], f1[k], f2[k] = len(s), K.mix(s).sum(dtype=np.uint64), K.mix(s ^ a[0]).sum(dtype=np.uint64)
            least = np.stack([np.minimum.reduceat((h ^ b[k]) * a[k], cut) for k in range(2 * M * HALF)])
            for k in range(2 * M):
                parts = least[k * HALF : (k + 1) * HALF]
                keys[who, k] = K.mix(sum((K.mix(p + a[i]) * b[i] for i, p in enumerate(parts)), np.zeros(len(who), np.uint64)) ^ salt[k])
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * M), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64))) for x in (keys[:, :M], keys[:, M:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(count), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *lists], schema=schema)


def _sets(batches):
    for batch in batches:
        node, out = np.zeros(batch.num_rows, np.uint64), [b""] * batch.num_rows
        for first, n, h, at in shingle_sets(batch.column("text")):
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            for k, piece in zip((at[cut] + first).tolist(), np.split(h, cut[1:]) if len(h) else []):
                s = np.unique(piece)
                node[k], out[k] = K.mix(s).sum(dtype=np.uint64), s.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(out, pa.binary())], names=["node", "shingles"])


def _linked(num: int, den: int):
    def verify(batches):
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            hit = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int(np.count_nonzero(y[at] == x))
                hit[i] = den * same >= num * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    return verify


def connected(links: DataFrame) -> Table:
    """(v, label): the smallest vertex reachable, for each vertex of the links (a, b).

    Each step takes the least label among a vertex and its neighbours, then that label's own label; every
    step is written, so a lost executor costs one step at most."""
    both = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    now = keep(both.df.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("label")), "labels")
    while True:
        near = both.df.join(now.df.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "label")
        least = now.df.withColumn("old", F.col("label")).unionByName(near, allowMissingColumns=True).groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        up = now.df.select(F.col("v").alias("label"), F.col("label").alias("up"))
        new = keep(least.join(up, "label", "left").select("v", F.least("label", "up").alias("label"), "old"), "labels")
        same = new.df.where("label <> old").isEmpty()
        now.drop()
        now = Table(new.spark, new.path, new.df.select("v", "label").schema)
        if same:
            both.drop()
            return now


def _half(side: str, shift: int) -> Column:
    """A collection's half-keys, or for shift > 0 the hashes of the pairs (i, i + shift)."""
    return F.expr(f"transform(sequence(0, {M - 1}), i -> xxhash64({side}[i], {side}[(i + {shift}) % {M}]))") if shift else F.col(side)


def _keys(nodes: DataFrame, shift: int = 0, diagonal: bool = False) -> DataFrame:
    """(key, node, label, n_shingles) of the tables' buckets; null halves have been found to be alone."""
    a, b = _half("ka", shift), _half("kb", shift)
    base = nodes.select("node", "label", "n_shingles", a.alias("a"), b.alias("b"))
    if diagonal:
        out = base.select("node", "label", "n_shingles", F.explode(F.arrays_zip("a", "b")).alias("z")).select("node", "label", "n_shingles", "z.a", "z.b")
    else:
        out = base.select("node", "label", "n_shingles", F.explode("a").alias("a"), "b").where("a is not null").select("node", "label", "n_shingles", "a", F.explode("b").alias("b"))
    return out.where("a is not null and b is not null").select(F.xxhash64("a", "b").alias("key"), "node", "label", "n_shingles")


def _star_pairs(keys: DataFrame, seed: int, num: int, den: int) -> tuple[DataFrame, Table]:
    """Candidates (a, b): the members of a bucket in other components than its centre, drawn by seed; and the written
    table of centres: a join with a table, not with an aggregate in the same stage, can be split where a key is hot."""
    draw = F.struct(F.xxhash64("node", F.lit(seed)).alias("o"), F.col("node"), F.col("label"), F.col("n_shingles"))
    per = keys.groupBy("key").agg(F.min(draw).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    centres = keep(per.select("key", F.col("c.node").alias("c"), F.col("c.label").alias("cl"), F.col("c.n_shingles").alias("cn")), "centres")
    return _fitting(keys.join(centres.df, "key").where("label <> cl"), num, den), centres


def _fitting(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b) whose sizes allow a link: the smaller at least num / den of the larger."""
    fits = den * F.least("n_shingles", "cn") >= num * F.greatest("n_shingles", "cn")
    return pairs.where(fits).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _items(batches):
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        take = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("node", "label", "n_shingles")), pa.array(np.concatenate(sets))], names=["node", "label", "n_shingles", "g"])


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (a, b) in different components that share a shingle of both prefixes."""
    items = nodes.select("node", "label", "n_shingles").join(sets, "node").mapInArrow(lean(_items), "node long, label long, n_shingles long, g long")
    of = items.groupBy("g").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "g"))
    prefix = items.join(of, "g").withColumn("r", rank).where(F.col("r") <= F.col("n_shingles") - F.ceil(F.col("n_shingles") * num / den) + 1).where("lo < hi")
    prefix = prefix.select("g", "r", "node", "label", "n_shingles")
    other = prefix.select("g", F.col("r").alias("cr"), F.col("node").alias("c"), F.col("label").alias("cl"), F.col("n_shingles").alias("cn"))
    # At the first shingle they share, the rest of the shorter remainder bounds what they can share in all.
    most = 1 + F.least(F.col("n_shingles") - F.col("r"), F.col("cn") - F.col("cr"))
    enough = most * (num + den) >= num * (F.col("n_shingles") + F.col("cn"))
    return _fitting(prefix.join(other, "g").where("label < cl").where(enough), num, den)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return with_both.select("a", "b", "sa", "sb").mapInArrow(lean(_linked(num, den)), "a long, b long")


def _relabel(labels: Table, links: Table) -> Table:
    """labels after the links: components of the graph between labels, then each label's new one."""
    of = labels.df
    ends = links.df.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    merged = connected(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    new = keep(of.join(merged.df.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    for t in (merged, labels):
        t.drop()
    return new


def _unsettled(live: DataFrame) -> DataFrame:
    """live with only the half-keys whose bucket reaches another component, on both sides, else left out."""
    half = live.select("node", "label", F.posexplode(F.concat("ka", "kb")).alias("at", "h")).where("h is not null")
    mixed = half.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    sides = half.join(mixed, "h", "left_semi").groupBy("node").agg(F.min(F.col("at") >= M).alias("b_only"), F.max(F.col("at") >= M).alias("some_b"))
    return live.drop("label").join(sides.where("not b_only and some_b").select("node"), "node", "left_semi")


def link_classes(live: Table, sets: DataFrame, num: int, den: int, deep_rounds: int) -> Table:
    """(node, label) of the classes in live: label is equal for connected ones."""
    labels = keep(live.df.select("node", F.col("node").alias("label")), "labels")
    active = live
    for round_ in range(deep_rounds + 3):
        exact = round_ == deep_rounds + 2
        if round_ == 1 or exact:
            old, active = active, keep(_unsettled(active.df.join(labels.df, "node")), "active")
            if old is not live:
                old.drop()
            if active.df.isEmpty():
                break
        nodes = active.df.join(labels.df, "node")
        if exact:
            pairs = keep(_prefix_pairs(nodes, sets, num, den), "pairs")
        else:
            candidates, centres = _star_pairs(_keys(nodes, max(0, round_ - 1), diagonal=round_ == 0), round_, num, den)
            pairs = keep(candidates, "pairs")
            centres.drop()
        found = keep(_verified(pairs.df, sets, num, den), "found")
        pairs.drop()
        if not found.df.isEmpty():
            labels = _relabel(labels, found)
        found.drop()
    if active is not live:
        active.drop()
    return labels


def live_classes(reps: DataFrame) -> DataFrame:
    """reps with null for half-keys that no other row has; rows without a shared half on either side are left
    out, as they meet nothing in any table."""
    half = reps.select("node", "n_shingles", F.posexplode(F.concat("ka", "kb")).alias("at", "h"))
    shared = half.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = half.join(shared, "h").groupBy("node", "n_shingles").agg(F.map_from_entries(F.collect_list(F.struct("at", "h"))).alias("of"))
    sides = [F.expr(f"transform(sequence({k * M}, {k * M + M - 1}), i -> of[i])").alias(name) for k, name in enumerate(("ka", "kb"))]
    return found.select("node", "n_shingles", *sides).where("exists(ka, x -> x is not null) and exists(kb, x -> x is not null)")


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, deep_rounds: int = DEEP_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = keep(texts.mapInArrow(lean(_sketch), SKETCH), "sketch")
    named = sketch.df.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy(F.col("f1").alias("node"), "f2").agg(F.min("doc_id").alias("rep"))
    reps = named.withColumnsRenamed({"doc_id": "rep", "f1": "node"}).join(classes, ["rep", "node", "f2"], "left_semi").dropDuplicates(["rep", "node", "f2"])
    live = keep(live_classes(reps), "live")
    wanted = classes.join(live.df.select("node"), "node", "left_semi")
    some = texts.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = keep(some.mapInArrow(lean(_sets), "node long, shingles binary").join(live.df.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    labels = link_classes(live, sets.df, num, den, deep_rounds)
    live.drop()
    sets.drop()
    labelled = classes.join(labels.df, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component"))
    final = labelled.join(least, "label").select("node", "f2", "component")
    out = sketch.df.select("doc_id", "n_shingles", F.when(F.expr("doc_id is not null and n_shingles > 0"), F.col("f1")).alias("node"), "f2")
    out = out.join(final, ["node", "f2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over the shingles: words by white space, distinct 5-grams, all pairs that share one, then components.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
one AS (SELECT doc_id, len(sh) AS n, hash(list_sort(sh)) AS h FROM s),
rep AS (SELECT h, n, min(doc_id) AS rep FROM one WHERE n > 0 GROUP BY h, n),
x AS (SELECT r.rep, r.n, unnest(s.sh) AS g FROM rep r JOIN s ON s.doc_id = r.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
c(v, u) AS (SELECT rep, rep FROM rep UNION SELECT c.v, e.b FROM c JOIN e ON c.u = e.a),
m AS (SELECT v, min(u) AS component FROM c GROUP BY v)
SELECT o.doc_id, CAST(o.n AS BIGINT) AS n_shingles, coalesce(m.component, o.doc_id) AS component_id, o.doc_id = coalesce(m.component, o.doc_id) AS kept
FROM one o LEFT JOIN rep r ON o.h = r.h AND o.n = r.n LEFT JOIN m ON m.v = r.rep
"""
