"""Language-model scoring with a causal self-attention model trained in numpy on subword ids.

Counts first: every distinct word of the training documents with its count (compressed blocks by a hash,
merged into one row a word), from which come the unigram base and the counts of subword ids.

The model predicts subword ids (each word encoded with a leading space, then the end token). An id is
predicted as class times id within class: the most frequent ids are classes of their own, the others share
classes by whether they begin a word and by frequency, and their share of the class is their count's. The
classes lie in groups, and both the group and the class within it come from one attention block over the
ids before: embeddings and positions, masked attention, a small hidden layer, two softmaxes. So the
probabilities of all ids add up to 1. A word's probability is MIX times the model's (the product over its
ids) plus 1 - MIX times its share of the training tokens: a mixture of two distributions over words.

Training starts on one task with about START_DOCS documents, which only gives all tasks a common point, and is
then data-parallel over all training documents: a hash deals them into RATE parts, and in each of ROUNDS
rounds every part is read in turn. Every task trains the current parameters on its share of the part, HELD
windows at a time, and the parameters are averaged by tokens, block by block on the executors. So every
training document is trained on ROUNDS times, whatever the input's size. Scoring cuts each
document into windows of WINDOW ids that overlap; every id is scored once, in the first window in which it
has OVERLAP ids before it.

Words beyond the HEAD most frequent, which are broadcast within a bound, are encoded where they stand, and
their counts are joined by the word, together with the model's probability at each place they stand, so the
bound has no part in the results.

Defined cases. A null or empty text is the end token alone. A null doc_id counts as training. Repeated rows
are counted and scored each. With no training documents N and V are 0. An empty table gives an empty table. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import keep, lean, prepare, tokenizer_path
from .bpe import Head, _lookup, distinct, distinct_words, encode_words, head_of, load

TOKENIZER = "byte_bpe_50k.json"
WINDOW, OVERLAP, WIDTH, HIDDEN = 16, 3, 16, 24
OWN_CLASSES, TIERS, GROUP, UNITS = 992, 16, 32, 4096
MIX = 0.75
#: The most words with counts and ids in every task; the rest go by a join.
HEAD_WORDS = 500_000
#: Passes over all training documents, parts of a pass (with an average after each), windows of a step, the rate.
ROUNDS, RATE, BATCH, LEARN = 1, 4, 128, 0.002
#: Windows that a task holds at once: they are shuffled and trained on, and make room for the next.
HELD = 1 << 16
#: The start, on one task: about so many documents, so many steps at least (in at most so many passes), its rate.
START_DOCS, START_STEPS, MOST_EPOCHS, START_LEARN = 1500, 1200, 12, 0.006
SMOOTH = 0.1
_BLOCK = 8192


def word_chunks(column: pa.Array):
    """As bpe's words, but runs without white space, A-Z lower-cased."""
    buf, off = K.buffers(column)
    for i, j in K.chunks(off):
        part, o = K.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end, row = K.spans(part, o)
        yield i, j, row, *distinct(part, start, end)


# ---- sums of long vectors over all tasks, block by block


def _as_blocks(vector: np.ndarray) -> pa.RecordBatch:
    parts = [vector[i : i + _BLOCK].astype(np.float64).tobytes() for i in range(0, len(vector), _BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "data"])


def _add_blocks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
            x = np.frombuffer(data, np.float64)
            total[b] = total[b] + x if b in total else x
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"])


def _summed(df: DataFrame, function, size: int) -> np.ndarray:
    """The sum of what function gives for each task of df; only the sum reaches the driver."""
    rows = df.mapInArrow(lean(function), "block int, data binary").repartition("block").mapInArrow(lean(_add_blocks), "block int, data binary").collect()
    out = np.zeros(size)
    for r in rows:
        x = np.frombuffer(bytes(r.data), np.float64)
        out[r.block * _BLOCK : r.block * _BLOCK + len(x)] += x
    return out


def _count_ids(path: str, size: int):
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            ids = [np.frombuffer(x, np.uint32) for x in encode_words([b" " + w for w in batch.column("word").to_pylist()], path)]
            if ids:
                total += np.bincount(np.concatenate(ids), np.repeat(batch.column("n").to_numpy().astype(float), [len(x) for x in ids]), size)
        yield _as_blocks(total)

    return run


# ---- the model


class Classes:
    """Classes of ids, the log10 share of an id in its class, and the ids' input units; from their counts."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray):
        n = len(counts)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((np.arange(n), -counts))] = np.arange(n)
        tier = np.minimum((np.log2(np.maximum(rank, OWN_CLASSES) / OWN_CLASSES) * TIERS / np.log2(max(2, n / OWN_CLASSES))).astype(np.int64), TIERS - 1)
        own = np.where(rank < OWN_CLASSES, rank, OWN_CLASSES + 2 * tier + begins)
        self.size = OWN_CLASSES + 2 * TIERS
        # Groups of GROUP neighbours: classes that begin words first, then the others, each by falling count.
        first = np.full(self.size, n)
        np.minimum.at(first, own, rank)
        begin = np.zeros(self.size, np.int64)
        begin[own] = begins
        new = np.empty(self.size, np.int64)
        new[np.lexsort((first, -begin))] = np.arange(self.size)
        self.of = new[own]
        self.groups = -(-self.size // GROUP)
        total, members = np.bincount(self.of, counts, self.size), np.bincount(self.of, minlength=self.size)
        self.within = np.log10((counts + SMOOTH) / (total + SMOOTH * members)[self.of])
        self.unit = np.where(rank < UNITS, rank, UNITS + self.of)
        self.start = UNITS + self.size
        self.units = self.start + 1
        share = np.zeros(self.groups * GROUP)
        share[: self.size] = (total + SMOOTH * members) / (total + SMOOTH * members).sum()
        by_group = share.reshape(self.groups, GROUP)
        self.prior = np.log(np.maximum(by_group.sum(axis=1), 1e-12)).astype(np.float32)
        #: -30 shuts the places that no class has.
        self.prior_within = np.where(by_group > 0, np.log(np.maximum(by_group, 1e-12)) - self.prior[:, None], -30).astype(np.float32)


def shapes(classes: Classes) -> dict[str, tuple]:
    """The last rows of U and of each part of T are added: they stand on a column of ones."""
    d, h, g = WIDTH, HIDDEN, classes.groups
    return {"E": (classes.units, d), "P": (WINDOW, d), "Q": (d, d), "K": (d, d), "V": (d, d), "O": (d, d), "A": (d, h), "a": (h,), "B": (h, d), "U": (d + 1, g), "T": (g, d + 1, GROUP)}


def initial(classes: Classes) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    p = {k: (rng.standard_normal(s) * (0.3 if k in "EP" else 0.5 / np.sqrt(WIDTH))).astype(np.float32) for k, s in shapes(classes).items() if k != "T"}
    t = (rng.standard_normal((classes.groups, WIDTH, GROUP)) * 0.5 / np.sqrt(WIDTH)).astype(np.float32)
    p["T"] = np.concatenate([t, classes.prior_within[:, None]], axis=1)
    p["a"][:] = 0
    p["U"] *= 0.2
    p["T"][:, :-1] *= 0.2
    p["U"][-1] = classes.prior
    return p


def flat(p: dict) -> np.ndarray:
    return np.concatenate([x.reshape(-1) for x in p.values()])


def unflat(v: np.ndarray, classes: Classes) -> dict[str, np.ndarray]:
    """The parameters as parts of a vector of 32-bit numbers."""
    out, at = {}, 0
    for k, s in shapes(classes).items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


_EARLIER = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], np.float32)


def _exp(z: np.ndarray) -> np.ndarray:
    """exp of z in place, each row up to a factor, which only rows of wide range need."""
    if max(float(z.max(initial=0)), -float(z.min(initial=0))) > 60:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _three(p: dict) -> np.ndarray:
    """Side by side, what makes queries, which are scaled, keys and values."""
    return np.hstack([p["Q"] * np.float32(1 / np.sqrt(WIDTH)), p["K"], p["V"]])


def attend(p: dict, x: np.ndarray, at: np.ndarray | None = None):
    """Hidden states of windows x (n, WINDOW) of units, a row for each place in at, or for all: batched masked
    attention and the hidden layer, which only those places go through."""
    n, w = x.shape
    h0 = np.take(p["E"], x, axis=0)
    h0 += p["P"]
    h0 = h0.reshape(n * w, -1)
    q, k, v = np.split((h0 @ _three(p)).reshape(n, w, -1), 3, axis=2)
    s = q @ k.transpose(0, 2, 1)
    if max(float(s.max()), -float(s.min())) > 60:
        s -= np.where(_EARLIER > 0, s, -np.inf).max(axis=2, keepdims=True)
        np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s *= _EARLIER
    s /= _row_sums(s.reshape(n * w, w)).reshape(n, w, 1)
    c = (s @ v).reshape(n * w, -1)
    own = h0
    if at is not None:
        c, own = np.take(c, at, axis=0), np.take(h0, at, axis=0)
    h1 = c @ p["O"]
    h1 += own
    m = h1 @ p["A"]
    m += p["a"]
    np.maximum(m, 0, out=m)
    h2 = m @ p["B"]
    h2 += h1
    return h2, (h0, q, k, v, s, c, h1, m)


def _own_log(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log softmax of each row of z at its target; z is overwritten."""
    own = np.arange(len(z)) * z.shape[1] + target
    z = _exp(z)
    return np.log(np.maximum(z.reshape(-1)[own], np.float32(1e-37)) / _row_sums(z))


def _sorted(group: np.ndarray, groups: int) -> tuple[np.ndarray, list[int]]:
    """The rows by group, and where each group begins and ends among them."""
    return np.argsort(group.astype(np.int16), kind="stable"), [0, *np.cumsum(np.bincount(group, minlength=groups)).tolist()]


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((len(h), h.shape[1] + 1), h.dtype)
    out[:, :-1] = h
    return out


def _within(h: np.ndarray, p: dict, bounds: list[int]) -> np.ndarray:
    """Values of the places within the group of each row of h, which is in the order of the groups."""
    z = np.empty((len(h), GROUP), h.dtype)
    for g, (i, j) in enumerate(zip(bounds, bounds[1:])):
        if j > i:
            np.matmul(h[i:j], p["T"][g], out=z[i:j])
    return z


def log_softmax(h: np.ndarray, p: dict, target: np.ndarray) -> np.ndarray:
    """log probability of the target classes: of their group, then within it."""
    order, bounds = _sorted(target // GROUP, len(p["T"]))
    h, target = _with_ones(np.take(h, order, axis=0)), target[order]
    out = np.empty(len(h), h.dtype)
    out[order] = _own_log(h @ p["U"], target // GROUP) + _own_log(_within(h, p, bounds), target % GROUP)
    return out


def gradients(p: dict, x: np.ndarray, y: np.ndarray, mask: np.ndarray, g: dict) -> None:
    """Of the mean cross-entropy over masked places, into the arrays of g."""
    n, w = x.shape
    at = np.flatnonzero(mask.reshape(-1))
    target = y.reshape(-1)[at]
    # The places in the order of their groups.
    order, bounds = _sorted(target // GROUP, len(p["T"]))
    at, target = at[order], target[order]
    h2, (h0, q, k, v, s, c, h1, m) = attend(p, x, at)
    h, share = _with_ones(h2), np.float32(1 / max(1, len(at)))

    def soft(z: np.ndarray, own: np.ndarray) -> np.ndarray:
        z = _exp(z)
        z *= (share / _row_sums(z))[:, None]
        z.reshape(-1)[np.arange(len(z)) * z.shape[1] + own] -= share
        return z

    z = soft(h @ p["U"], target // GROUP)
    np.matmul(h.T, z, out=g["U"])
    dh = z @ p["U"][:-1].T
    z = soft(_within(h, p, bounds), target % GROUP)
    more = np.empty_like(dh)
    for k_, (i, j) in enumerate(zip(bounds, bounds[1:])):
        if j > i:
            np.matmul(h[i:j].T, z[i:j], out=g["T"][k_])
            np.matmul(z[i:j], p["T"][k_, :-1].T, out=more[i:j])
        else:
            g["T"][k_] = 0
    dh += more
    dm = dh @ p["B"].T
    dm *= m > 0
    g["B"][:], g["A"][:], g["a"][:] = m.T @ dh, h1.T @ dm, np.ones(len(dm), dm.dtype) @ dm
    dh1 = dm @ p["A"].T
    dh1 += dh
    g["O"][:] = c.T @ dh1
    dc = np.zeros_like(h0)
    dc[at] = dh1 @ p["O"].T
    dc = dc.reshape(n, w, -1)
    made = np.empty((n, w, 3 * WIDTH), h0.dtype)
    dq, dk, dv = np.split(made, 3, axis=2)
    np.matmul(s.transpose(0, 2, 1), dc, out=dv)
    ds = dc @ v.transpose(0, 2, 1)
    ds -= _row_sums((ds * s).reshape(n * w, w)).reshape(n, w, 1)
    ds *= s
    # The scale of the queries is in q, and is put on their weights' gradient.
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    made = made.reshape(n * w, -1)
    g["Q"][:], g["K"][:], g["V"][:] = np.split(h0.T @ made, 3, axis=1)
    g["Q"] *= np.float32(1 / np.sqrt(WIDTH))
    dh0 = made @ _three(p).T
    dh0[at] += dh1
    g["P"][:] = dh0.reshape(n, -1).sum(axis=0).reshape(w, -1)
    g["E"][:] = 0
    np.add.at(g["E"].reshape(-1), (x.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).reshape(-1), dh0.reshape(-1))


def windows(inputs: np.ndarray, bounds: np.ndarray):
    """Index matrix (n, WINDOW) into inputs, where inputs of row k lie at bounds[k]:bounds[k + 1], which places
    hold an id, and which are scored: each once."""
    size = np.diff(bounds)
    step = WINDOW - OVERLAP
    n = np.maximum(1, -(-(size - OVERLAP) // step))
    row = np.repeat(np.arange(len(size)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (bounds[row] + nth * step)[:, None] + np.arange(WINDOW)[None, :]
    valid = at < bounds[row + 1][:, None]
    scored = valid & ((np.arange(WINDOW)[None, :] >= OVERLAP) | (nth == 0)[:, None])
    return np.minimum(at, len(inputs) - 1), valid, scored, row


class Adam:
    """Steps over shuffled batches of windows; the moments stay from one call to the next."""

    def __init__(self, vector: np.ndarray, classes: Classes, seed: int, learn: float = LEARN):
        self.rng, self.learn, self.t = np.random.default_rng(seed), learn, 0
        self.vector, self.g, self.mean, self.square = vector.astype(np.float32), *(np.zeros(len(vector), np.float32) for _ in range(3))
        self.views, self.g_views = unflat(self.vector, classes), unflat(self.g, classes)

    def train(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, epochs: int = 1, fall: float = 0.0) -> None:
        """The rate falls by the share fall over these steps."""
        g, mean, square, done, total = self.g, self.mean, self.square, 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for i in range(0, len(order), BATCH):
                take = order[i : i + BATCH]
                self.t, done = self.t + 1, done + 1
                rate = self.learn * (1 - fall * done / total)
                gradients(self.views, x[take].astype(np.int64), y[take].astype(np.int64), mask[take], self.g_views)
                # Moments are kept as sums that fall by a tenth and a hundredth a step; what would scale the squares scales the rest.
                mean *= np.float32(0.9)
                mean += g
                g *= g
                square *= np.float32(0.99)
                square += g
                root = np.sqrt((1 - 0.99**self.t) / 0.01)
                np.sqrt(square, out=g)
                g += np.float32(1e-6 * root)
                np.divide(mean, g, out=g)
                g *= np.float32(rate * 0.1 / (1 - 0.9**self.t) * root)
                self.vector -= g


class Encoded:
    """Ids of a chunk's rows, each with its end token; what the words outside the head are."""

    def __init__(self, head: Head, path: str, end_id: int, rows: int, row, words, inverse):
        self.at = _lookup(head, words)
        rare = np.flatnonzero(self.at < 0)
        own = [np.frombuffer(x, np.uint32) for x in encode_words([b" " + words[k] for k in rare.tolist()], path)]
        some = self.at >= 0
        known, size = K.ragged(head.ids, head.offsets, self.at[some])
        length, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        length[some], length[rare] = size, [len(x) for x in own]
        begin[some] = np.cumsum(size) - size
        begin[rare] = len(known) + np.cumsum(length[rare]) - length[rare]
        values = np.concatenate([known, *own])
        self.length = length
        take = length[inverse]
        ends = np.cumsum(take)
        ids = values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin[inverse] - (ends - take), take)]
        place = np.append(0, ends)[np.searchsorted(row, np.arange(rows + 1))]
        self.bounds = place + np.arange(rows + 1)
        self.ids = np.full(len(ids) + rows, end_id, np.int64)
        mask = np.ones(len(self.ids), bool)
        mask[self.bounds[1:] - 1] = False
        self.ids[mask] = ids


def _inputs(e: Encoded, classes: Classes) -> np.ndarray:
    x = np.empty(len(e.ids), np.int64)
    x[1:] = classes.unit[e.ids[:-1]]
    x[e.bounds[:-1]] = classes.start
    return x


def _train(head_, shared, path: str, end_id: int, seed: int, learn: float, steps: int = 0):
    """Trains on every text of a task: once, HELD windows at a time, or where steps are asked for, on all of
    them together in as many passes as that takes."""

    def run(batches):
        head, (classes, v) = head_.value, shared.value
        adam, held, weight = Adam(v, classes, seed, learn), [], 0.0

        def flush() -> float:
            x, y, mask = (np.concatenate(parts) for parts in zip(*held))
            held.clear()
            if steps:
                adam.train(x, y, mask, min(MOST_EPOCHS, max(1, -(-steps // -(-len(x) // BATCH)))), 0.9)
            else:
                adam.train(x, y, mask)
            return float(mask.sum())

        n = 0
        for batch in batches:
            for i, j, row, words, inverse, _ in word_chunks(batch.column("text")):
                e = Encoded(head, path, end_id, j - i, row, words, inverse)
                x = _inputs(e, classes)
                at, valid, scored, _ = windows(x, e.bounds)
                held.append((x[at].astype(np.int16), classes.of[e.ids][at].astype(np.int16), scored))
                n += len(at)
                if n >= HELD and not steps:
                    weight, n = weight + flush(), 0
        if held:
            weight += flush()
        if weight:
            yield _as_blocks(np.append(adam.vector.astype(np.float64) * weight, weight))

    return run


class Model:
    """What scoring needs; the head is a broadcast, made once for training and scoring."""

    def __init__(self, head, least: int | None, classes: Classes, vector: np.ndarray, path: str, end_id: int, total: int, distinct_: int, ends: int, trained: int):
        self.head, self.least, self.classes, self.vector, self.path, self.end_id = head, least, classes, vector, path, end_id
        #: trained: subword ids and end tokens that the rounds after the start have trained on.
        self.total, self.distinct, self.ends, self.trained = total, distinct_, ends, trained


def _is_held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def fit(train: DataFrame, words: DataFrame, path: str, head_words: int = HEAD_WORDS, rounds: int = ROUNDS, rate: int = RATE) -> Model:
    """The model of training documents (doc_id, text) and their words (word, n)."""
    spark = train.sparkSession
    t = load(path)
    vocabulary = t.get_vocab(with_added_tokens=True)
    size = max(vocabulary.values()) + 2
    end_id = size - 1
    begins = np.zeros(size, np.int64)
    begins[[i for piece, i in vocabulary.items() if piece.startswith("Ġ")]] = 1
    begins[end_id] = 1
    head = head_of(words, path, most=head_words, prefix=b" ")
    head_ = spark.sparkContext.broadcast(head)
    ends = train.count()
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    counts = _summed(words, _count_ids(path, size), size)
    counts[end_id] = ends
    classes = Classes(counts, begins)
    vector = flat(initial(classes)).astype(np.float64)
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(rate))
    first = train.where(mark < int((1 << 30) * min(1.0, START_DOCS / max(1, ends)))).select("text").repartition(1)
    turns, trained = rounds * rate, 0
    for r in range(-1, turns) if ends else ():
        own = first if r < 0 else train.where(part == r % rate).select("text")
        learn, steps = (START_LEARN, START_STEPS) if r < 0 else (LEARN * (1 - 0.9 * r / turns), 0)
        shared = spark.sparkContext.broadcast((classes, vector.astype(np.float32)))
        got = _summed(own, _train(head_, shared, path, end_id, r + 1, learn, steps), len(vector) + 1)
        if got[-1]:
            vector = got[:-1] / got[-1]
            trained += int(got[-1]) if r >= 0 else 0
    return Model(head_, head.least, classes, vector.astype(np.float32), path, end_id, int(sums.n or 0) + ends, int(sums.v) + bool(ends), ends, trained)


def score_ids(p: dict, classes: Classes, e: Encoded, batch: int = 256) -> np.ndarray:
    """log10 probability of each id of e given those before it in its row."""
    x = _inputs(e, classes)
    at, _, scored, _ = windows(x, e.bounds)
    out = classes.within[e.ids]
    target = classes.of[e.ids]
    for i in range(0, len(at), batch):
        w, m = at[i : i + batch], scored[i : i + batch]
        h, _ = attend(p, x[w], np.flatnonzero(m))
        places = w[m]
        out[places] += log_softmax(h, p, target[places]) * np.float32(1 / np.log(10))
    return out


def word_logs(ids: np.ndarray, e: Encoded, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's log10 probability of each word, and of each row's end."""
    ends = e.bounds[1:] - 1
    inner = np.ones(len(ids), bool)
    inner[ends] = False
    size = e.length[inverse]
    words = np.add.reduceat(ids[inner], np.cumsum(size) - size) if len(inverse) else np.zeros(0)
    return np.maximum(words, -300), np.maximum(ids[ends], -300)


def mixed(model, share):
    """log10 of the mixture of the model's probability, given as log10, and the share of the training tokens."""
    return np.log10(MIX * 10.0**model + (1 - MIX) * share)


def _score(shared):
    def run(batches):
        m = shared.value
        head = m.head.value
        p = unflat(m.vector, m.classes)
        logs, shares = np.log10(head.n + 0.1), head.n / max(1, m.total)
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("model", pa.list_(pa.float64()))]))
        for batch in batches:
            rows = batch.num_rows
            n, known, base, score, rare = np.ones(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows), [[] for _ in range(rows)]
            for i, j, row, words, inverse, _ in word_chunks(batch.column("text")):
                e = Encoded(head, m.path, m.end_id, j - i, row, words, inverse)
                model, end = word_logs(score_ids(p, m.classes, e), e, inverse)
                n[i:j] += np.bincount(row, minlength=j - i)
                at = e.at[inverse]
                in_head = at >= 0
                score[i:j] = mixed(end, m.ends / max(1, m.total)) + np.bincount(row[in_head], mixed(model[in_head], shares[at[in_head]]), j - i)
                base[i:j] += np.bincount(row[in_head], logs[at[in_head]], j - i)
                known[i:j] += np.bincount(row[in_head], minlength=j - i)
                key = row[~in_head] * len(words) + inverse[~in_head]
                order = np.argsort(key, kind="stable")
                key, first = np.unique(key[order], return_index=True)
                for k, own in zip(key.tolist(), np.split(model[~in_head][order], first[1:])):
                    rare[i + k // len(words)].append({"word": words[k % len(words)], "model": own})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (n, known, base, score)), pa.array(rare, rare_type)], names=["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def score(docs: DataFrame, tokenizer: str | None = None, head_words: int = HEAD_WORDS, rounds: int = ROUNDS, rate: int = RATE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path(TOKENIZER)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = texts.where(~_is_held_out())
    words = keep(distinct_words(train, word_chunks), "words")
    m = fit(train, words.df, path, head_words, rounds, rate)
    shared = spark.sparkContext.broadcast(m)
    scored = keep(texts.mapInArrow(lean(_score(shared)), "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, model: array<double>>>").withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare = scored.df.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.model")
    tail = words.df.where(F.col("n") < m.least) if m.least is not None else words.df
    n, k = F.coalesce("n", F.lit(0)), F.size("model")
    own = F.aggregate("model", F.lit(0.0), lambda total, x: total + F.log10(F.lit(MIX) * F.pow(F.lit(10.0), x) + F.lit((1 - MIX) / max(1, m.total)) * n))
    found = rare.join(tail, "word", "left").groupBy("uid").agg(F.sum(k * F.log10(n + F.lit(0.1))).alias("more"), F.sum(F.when(n > 0, k).otherwise(0)).alias("also"), F.sum(own).alias("rest"))
    out = scored.df.drop("rare").join(found, "uid", "left")
    # Known of the end token: in every training document.
    end = float(np.log10(m.ends + 0.1))
    whole = float(np.log10(m.total + 0.1 * (m.distinct + 1)))
    return out.select(
        "doc_id", _is_held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0)) + F.lit(int(m.ends > 0))).alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
