"""Vectorised text kernels on the UTF-8 bytes of a batch: spans of words, their 64-bit hashes, shingles.

A batch is handled in chunks of about CHUNK bytes, so that the temporary arrays stay small; a single
longer text is one chunk. ASCII bytes never occur inside a UTF-8 sequence, so words cut at ASCII
characters are whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A-Z to a-z for bytes.translate.
LOWER_BYTES = LOWER.tobytes()
#: White space as the contracts have it: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[list(SPACES)] = 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def rows_of(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The row of each start, which ascend."""
    return np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray = NOT_SPACE, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes with inside[byte]; rows bound the runs, and so do the
    places where cut is true, between two bytes of a run each."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[buf].astype(bool)
    first = np.ones(n, bool)
    np.logical_not(w[:-1], out=first[1:])
    edge = off[1:-1]
    first[edge[edge < n]] = True
    if cut is not None:
        first |= cut
    # A run ends where the next byte is outside or begins another one.
    last = np.ones(n, bool)
    np.logical_or(~w[1:], first[1:], out=last[:-1])
    start, end = np.flatnonzero(w & first), np.flatnonzero(w & last) + 1
    return start, end, rows_of(start, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits after which each bit depends on all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Spans of more bytes are hashed and compared one at a time.
LONG = 256
#: What is left of eight bytes, read as a little-endian number, when only the first k count.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf on as a number; zeros follow its end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time, mixed after each step, from the length on."""
    size = end - start
    out = mix(size.astype(U) * U(0xD6E8FEB86659FD93))
    eights, at, some, left = _eights(buf), start, None, size
    if len(long := np.flatnonzero(size > LONG)):
        data = buf.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(data[i:j]) for i, j in zip(start[long].tolist(), end[long].tolist())]
        some = np.flatnonzero(size <= LONG)
        at, left = start[some], size[some]
    while len(at):
        x = eights[at] & _FIRST[np.minimum(left, 8)]
        if some is None:
            out = mix(out ^ x)
            some = np.flatnonzero(left > 8)
            at, left = at[some] + 8, left[some] - 8
        else:
            out[some] = mix(out[some] ^ x)
            more = left > 8
            some, at, left = some[more], at[more] + 8, left[more] - 8
    return out


def _differ(buf: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> bool:
    """Whether a span of size bytes differs from the one that begins at other."""
    long = size > LONG
    if long.any():
        data = buf.tobytes()
        if any(data[i : i + n] != data[j : j + n] for i, j, n in zip(start[long].tolist(), other[long].tolist(), size[long].tolist())):
            return True
        start, size, other = start[~long], size[~long], other[~long]
    eights = _eights(buf)
    while len(start):
        if ((eights[start] ^ eights[other]) & _FIRST[np.minimum(size, 8)]).any():
            return True
        more = size > 8
        start, other, size = start[more] + 8, other[more] + 8, size[more] - 8
    return False


def equal_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one span for each distinct content, and for each span which of those it equals.

    Spans are grouped by hash, and each is held against the bytes of its group's first; where a hash turns out
    to stand for two contents, the bytes themselves decide."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = span_hashes(buf, start, end) if hashes is None else hashes
    inverse = pa.array(h).dictionary_encode().indices.to_numpy()
    first = np.empty(int(inverse.max()) + 1, np.int64)
    first[inverse[::-1]] = np.arange(len(start) - 1, -1, -1)
    size, other = end - start, first[inverse]
    if (size != size[other]).any() or _differ(buf, start, size, start[other]):
        data = buf.tobytes()
        of: dict[bytes, int] = {}
        inverse = np.array([of.setdefault(data[i:j], len(of)) for i, j in zip(start.tolist(), end.tolist())], np.int64)
        return np.unique(inverse, return_index=True)[1], inverse
    return first, inverse


def shingles(words: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, with its row; a row of fewer words, but not none, is one."""
    n = len(words)
    odd = [U(0xA0761D6478BD642F + 2 * 0x1234567 * i | 1) for i in range(k)]
    if n >= k:
        full = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        h = words[: n - k + 1] * odd[0]
        for i in range(1, k):
            h += mix(words[i : n - k + 1 + i] * odd[i])
        h = mix(h[full])
        at = row[full]
    else:
        h, at = np.zeros(0, U), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows) if n else np.zeros(rows, np.int64)
    if len(short := np.flatnonzero((count > 0) & (count < k))):
        first = np.searchsorted(row, short)
        extra = np.array([mix(np.array([np.sum(mix(words[f : f + c] * np.array(odd[:c], U)), dtype=U) + U(c)], U))[0] for f, c in zip(first.tolist(), count[short].tolist())], U)
        h, at = np.concatenate([h, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def ragged(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates the lists values[offsets[i]:offsets[i + 1]] for i in which; and each one's length."""
    begin = offsets[which].astype(np.int64)
    length = offsets[which + 1].astype(np.int64) - begin
    total = int(length.sum())
    if not total:
        return values[:0], length
    ends = np.cumsum(length)
    index = np.arange(total) + np.repeat(begin - (ends - length), length)
    return values[index], length
