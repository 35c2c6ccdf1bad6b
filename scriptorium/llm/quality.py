"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes len(FEATURES) numbers computed on its whole text with numpy. A fixed-depth booster
(logistic loss, quantile bins, second-order gains) is fitted on the driver with at most MAX_LABELLED
labelled documents, taken in the order of a hash of doc_id; documents whose crc32(doc_id) mod 3 is 1 are
held out. The trees are flattened into arrays of features, thresholds and leaves, and a batch walks all
trees at once, one level at a time. No text is shuffled: the labelled sample is bounded, so it is
broadcast to the documents for fitting, and scoring is a map.

Defined cases. A null or empty text has the statistics of an empty one and is scored like any other. Null
labels or doc_ids do not take part in fitting; held_out of a null doc_id is false. Without labels, or with labels
of one class, the score is the smoothed share of label 1, 0.5 without any (predicted 1, so nothing is
rejected without evidence). Repeated rows are scored each. Other columns are carried along; input columns
named like computed ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernels as K
from ._common import lean, prepare

#: The bound of the labelled sample.
MAX_LABELLED = 40_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.2, 1.0, 5

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "comma", "bang", "pipe", "mark", "quote", "symbol", "lead", "trail")
_CLASS = np.full(256, _CLASSES.index("symbol"), np.uint8)
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", b" \t\x0b\x0c\r"), ("newline", b"\n"), ("stop", b"."), ("comma", b",;:"),
    ("bang", b"!?"), ("pipe", b"|"), ("mark", b"#$%&*"), ("quote", b"'\"()-"), ("lead", range(192, 256)), ("trail", range(128, 192)),
):
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
FEATURES = (
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_length", "word_length_dev", "longest_word", "same_as_before", "same_as_two_before", "distinct_words", "capital_words",
    "marked_words", "stopped_words", "one_letter_words", "words_a_line", "distinct_lines", "byte_entropy", "upper_to_lower",
)


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def _statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    size = np.diff(off).astype(float)
    of_byte = np.repeat(np.arange(rows), np.diff(off))
    share = np.bincount(of_byte * 16 + _CLASS[buf], minlength=16 * rows).reshape(rows, 16)[:, : len(_CLASSES)] / np.maximum(size, 1)[:, None]
    counts = np.bincount(of_byte * 64 + (buf >> 2), minlength=64 * rows).reshape(rows, 64) / np.maximum(size, 1)[:, None]
    entropy = -(counts * np.log2(np.maximum(counts, 1e-12))).sum(axis=1)
    start, end, row = K.spans(buf, off)
    n = np.bincount(row, minlength=rows).astype(float)
    some, length = np.maximum(n, 1), (end - start).astype(float)
    mean = _per_row(length, row, rows) / some
    dev = np.sqrt(np.maximum(_per_row(length**2, row, rows) / some - mean**2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    h = K.span_hashes(buf, start, end)

    def same(k: int) -> np.ndarray:
        return _per_row((h[k:] == h[:-k]) & (row[k:] == row[:-k]), row[k:], rows) / some if len(h) > k else np.zeros(rows)

    def distinct(hashes: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, at))
        a, b = hashes[order], at[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.bincount(b[new], minlength=rows) / of

    kind_first, kind_last = (_CLASS[buf[start]], _CLASS[buf[end - 1]]) if len(start) else (np.zeros(0, np.uint8),) * 2
    kind_second = _CLASS[buf[np.minimum(start + 1, end - 1)]] if len(start) else kind_first
    code = _CLASSES.index
    loud = (kind_first == code("upper")) & (kind_second == code("upper")) & (length > 1)
    marked = np.isin(kind_last, [code("mark"), code("bang"), code("pipe"), code("symbol")])
    stopped = kind_last == code("stop")
    not_newline = np.ones(256, np.uint8)
    not_newline[10] = 0
    ls, le, lrow = K.spans(buf, off, not_newline)
    lines = np.maximum(np.bincount(lrow, minlength=rows), 1)
    columns = [
        np.log1p(size), np.log1p(n), mean, dev, longest, same(1), same(2), distinct(h, row, some), _per_row(loud, row, rows) / some, _per_row(marked, row, rows) / some, _per_row(stopped, row, rows) / some,
        _per_row(length == 1, row, rows) / some, n / lines, distinct(K.span_hashes(buf, ls, le), lrow, lines), entropy, share[:, 1] / np.maximum(share[:, 0] + share[:, 1], 1e-9),
    ]
    return np.column_stack([share, *columns])


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    buf, off = K.buffers(texts)
    parts = [_statistics(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in K.chunks(off)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Complete trees in level order: inner node k of a tree has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # as feature; inf sends all to the left
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        if not t or not n:
            return np.full(n, self.base)
        at = np.zeros((n, t), np.int64)
        tree, row = np.arange(t)[None, :], np.arange(n)[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1]))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - self.feature.shape[1]].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosts trees on quantile bins; each level takes one histogram per feature over all its nodes."""
    n, inner = len(y), 2**depth - 1
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    raw = np.full(n, base)
    out_f, out_t, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            best, split = np.full(width, 1e-6), [(0, bins, np.inf)] * width
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = node * (bins + 1) + binned[:, f]
                hg, hh, hn = (np.bincount(at, w, width * (bins + 1)).reshape(width, -1).cumsum(axis=1) for w in (g, h, None))
                lg, lh, ln = hg[:, : len(e)], hh[:, : len(e)], hn[:, : len(e)]
                tg, th, tn = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = lg**2 / (lh + L2) + (tg - lg) ** 2 / (th - lh + L2) - tg**2 / (th + L2)
                gain[(ln < LEAST) | (tn - ln < LEAST)] = 0
                k = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[w], split[w] = gain[w, k[w]], (f, int(k[w]), float(e[k[w]]))
            right = np.zeros(n, bool)
            for w, (f, k, t) in enumerate(split):
                feature[width - 1 + w], threshold[width - 1 + w] = f, t
                if np.isfinite(t):
                    own = node == w
                    right[own] = binned[own, f] > k
            node = 2 * node + right
        sg, sh = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        value = -rate * sg / (sh + L2)
        raw += value[node]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_v), base)


def _remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def _features_of(batches):
    for batch in batches:
        x = features(batch.column("text"))
        cells = pa.array(x.reshape(-1))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), cells)], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Trees:
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (_remainder() != 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("y", "text").mapInArrow(lean(_features_of), "y double, x array<double>").toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the order of arrival must not matter
    return fit(x[order], y[order])


def _score(trees):
    def run(batches):
        model = trees.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.score(features(batch.column("text"))))], names=["row", "score"])

    return run


def classify(docs: DataFrame, trees: Trees, carry: list[str] | None = None) -> DataFrame:
    """docs, or their columns in carry (doc_id among them), with held_out, score and predicted."""
    spark = docs.sparkSession
    prepare(spark)
    carried = [c for c in carry or docs.columns if c not in ("held_out", "score", "predicted")]
    row = docs.select(F.struct(*carried).alias("row"), "text")
    out = row.mapInArrow(lean(_score(spark.sparkContext.broadcast(trees))), T.StructType([row.schema["row"], T.StructField("score", T.DoubleType())]))
    out = out.select(*(F.col("row")[c].alias(c) for c in carried), "score")
    return out.withColumns({"held_out": F.coalesce(_remainder() == 1, F.lit(False)), "predicted": (F.col("score") >= 0.5).cast("int")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return classify(docs, train(docs, labels), carry=["doc_id"]).select("doc_id", "held_out", "score", "predicted")
