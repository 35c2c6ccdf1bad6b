"""Main text of web pages: block structure plus a suffix array over each host's token streams.

1. A page's html is cut into blocks (block elements, line breaks), each with its tags, and becomes a stream
   of tokens. Elements that never hold the article (scripts, styles, forms, navigation, ...) are left out by
   their names, roles and classes; the article elements, where there are any, bound the rest.
2. Host suffix array: the streams of a host's pages are concatenated, each page ended by tokens of its own,
   and sorted suffixes with their common prefixes show every run of at least REPEAT tokens that occurs in
   several distinct pages. A block of which such runs cover more than COVERED is boilerplate.
   A page of which such blocks hold more than COPIED is a copy of a text (or as good as one): of it, only the
   blocks go that SHARE of the host's pages repeat, and if that were all of them, none.
3. Inside article elements, all of which are kept, single blocks are not judged, as texts may share paragraphs.
   There the array tells the host's template: blocks are taken together by their path of elements and classes,
   and a path goes where such runs cover more than COVERED of its tokens over the pages that are not copies,
   as a row of links below each article does. Of a copied article nothing goes, however many pages have it.
   Paths are judged over the pages of a group; runs never cross blocks there.

Hosts are split by a hash of the page into groups of about GROUP pages, so a hot host is many tasks. Where
a host has several groups, each sends its distinct runs, as hashes cut to the bits that the host's number of runs
needs, with the pages that hold them; these are added up over the host, dealt by hash, and each group gets
back the sums of its own runs from PAGES on. So every block is judged against all pages of its host, however
they are split. Pages are parsed once, and only their blocks are shuffled. Nothing else is dropped and no text is cut.

Defined cases. A null or empty html gives an empty text. A null url has the host ''. Broken markup: unknown
tags are ignored, unclosed elements end with the page, a stray < is text. Repeated rows of one page count as
one page for step 2. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import lean, prepare

#: Tokens of a repeated run, distinct pages that hold it at least, the share of a host's pages from which it is
#: on all of them, the share of a block that must be covered, and the share of a page from which it is a copy.
REPEAT, PAGES, SHARE, COVERED, COPIED = 8, 3, 0.2, 0.6, 0.8
#: Pages and characters handled together, about; hosts that may be split at all.
GROUP, GROUP_BYTES, HOSTS = 500, 32 << 20, 100_000

# Element names of the HTML standard by their role here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_DROP = frozenset("head nav footer aside form button select option menu dialog template noscript svg math object canvas audio video map".split()) | _RAW
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An open element on the left is closed by those on the right when they start.
_CLOSES = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"table", "td", "th", "button", "article", "section", "div", "li", "blockquote", "body"}}
#: Words in a class or id that name what is not the article.
_JUNK = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup sidebar aside widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus popup modal overlay login paywall pagination pager skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*[\"']?([^\"'>]+)", re.I)
_PART = re.compile(r"[^a-z0-9]+")


#: What tokens consist of in a page's blocks, where words are parted by single spaces and blocks by line ends.
_WORD = np.ones(256, np.uint8)
_WORD[[10, 32]] = 0


class Block(NamedTuple):
    text: str
    article: int  # number of the page's article element around it, 0 for none
    main: bool
    path: str  # names and classes of the elements around it


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    if name in _DROP or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    values = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    words = set(_PART.split(f"{values.get('class', '')} {values.get('id', '')}"))
    return bool(words & _JUNK) or values.get("role") in _ROLES or values.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[Block]:
    """The page's blocks in order without what never holds the article."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool, str]] = []  # name, dropped, article, main, path
    pieces: list[str] = []
    articles = at = 0
    drop, article, main = False, 0, False

    def text(raw: str) -> None:
        if not drop and raw:
            pieces.append(_html.unescape(raw))

    def close() -> None:
        if pieces:
            if line := " ".join("".join(pieces).split()):
                out.append(Block(line, article, main, stack[-1][4] if stack else ""))
            pieces.clear()

    def top() -> tuple[bool, int, bool]:
        return stack[-1][1:4] if stack else (False, 0, False)

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(m[1])
            continue
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:  # an end tag
            if name == "p" and not any(x[0] == "p" for x in stack):
                close()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in _BLOCK or any(x[0] in _BLOCK or x[1] for x in stack[k:]):
                        close()
                    del stack[k:]
                    drop, article, main = top()
                    break
            continue
        if name in _BLOCK:
            close()
        for k in range(len(stack) - 1, -1, -1):
            if name in _CLOSES.get(stack[k][0], ()):
                del stack[k:]
                drop, article, main = top()
                break
            if stack[k][0] in _SCOPE.get(name, _SCOPE["p"]):
                break
        if name in _VOID or m[4].endswith("/") and name not in _BLOCK:
            continue
        gone = drop or _unwanted(name, m[4], article > 0)
        if name == "article" and not gone and not article:
            articles += 1
            article = articles
        is_main = main or name == "main" or "role" in m[4] and 'role="main"' in m[4]
        if gone and not drop:
            close()
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        named = _CLASS.search(m[4]) if m[4] and not gone else None
        path = f"{stack[-1][4] if stack else ''}/{name}{'.' + named[1].lower() if named else ''}"
        stack.append((name, gone, article, is_main, path))
        drop, main = gone, is_main
    close()
    return out


def _sorted_suffixes(tokens: np.ndarray, depth: int | None) -> tuple[np.ndarray, np.ndarray, list]:
    """The suffixes in order of their first depth tokens (all of them if None), whether each differs in these
    from the one before it, and their ranks by their first h tokens for each step h.

    By doubling: suffixes ranked by their first h tokens are ranked by their first 2h through the ranks at h
    places on; only those that are not alone yet are sorted again."""
    n = len(tokens)
    order = np.argsort(tokens.astype(np.uint16) if n and tokens.max() < 1 << 16 else tokens, kind="stable")
    new = np.ones(n, bool)
    new[1:] = tokens[order[1:]] != tokens[order[:-1]]
    place, steps, h = np.arange(n), [], 1
    while True:
        # The rank of a suffix is the place of the first one that begins alike; beyond the end it is -1.
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, place, 0))
        steps.append((h, rank))
        alone = new & np.append(new[1:], True)
        if alone.all() or depth is not None and h >= depth:
            return order, new, steps
        hop = h if depth is None else min(h, depth - h)
        at = np.flatnonzero(~alone)
        some = order[at]
        key = rank[some] * (n + 1) + rank[np.minimum(some + hop, n)]
        by = np.argsort(key)
        order[at], key = some[by], key[by]
        new[at[1:]] |= (key[1:] != key[:-1]) & ~new[at[1:]]
        h += hop


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first depth tokens (all of them if None), and how many tokens each shares
    with the one before it, up to depth: from the longest step down, neighbours of equal rank share the step."""
    n = len(tokens)
    order, _, steps = _sorted_suffixes(tokens, depth)
    shared = np.zeros(n, np.int64)
    left, right, more = order[:-1], order[1:], shared[1:]
    for h, rank in reversed(steps):
        fits = (rank[np.minimum(left + more, n)] == rank[np.minimum(right + more, n)]) & (np.maximum(left, right) + more + h <= n)
        if depth is not None:
            fits &= more + h <= depth
        more[fits] += h
    return order, shared


class Runs:
    """Every run of length tokens of some streams, and the distinct pages that hold it.

    They are read off the suffix array of all streams together: the suffixes that share length tokens are
    neighbours. What they share beyond that changes neither which they are nor, as every place of a longer run
    begins a run or lies in one, which tokens repeated runs cover; so the array is sorted to that depth. Each
    stream is followed by length tokens that are found nowhere else, so no run crosses pages."""

    def __init__(self, tokens: np.ndarray, size: np.ndarray, pages: np.ndarray, length: int):
        """tokens: numbers from 0 on, of all streams in a row; the streams' sizes and pages."""
        self.length, self.size = length, size
        self.begin = np.cumsum(size + length) - size - length
        self.total = total = int((size + length).sum())
        #: Where a run of length tokens begins and ends in its stream.
        whole = np.zeros(total + 1, np.int64)
        np.add.at(whole, self.begin, 1)
        np.add.at(whole, self.begin + np.maximum(0, size - length + 1), -1)
        self.at = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
        self.rank = np.zeros(total, np.int64)
        self.holders = np.zeros(1, np.int64)
        if not len(self.at):
            return
        real = np.ones(total, bool)
        real[((self.begin + size)[:, None] + np.arange(length)).reshape(-1)] = False
        self.tokens = np.empty(total, np.int64)
        self.tokens[real] = tokens
        self.tokens[~real] = int(tokens.max()) + 1 + np.arange(total - len(tokens))
        order, new, _ = _sorted_suffixes(self.tokens, length)
        self.rank[order] = np.cumsum(new) - 1
        rank, of_page, most = self.rank[self.at], np.repeat(pages, size + length)[self.at], int(pages.max()) + 1
        self.holders = np.bincount(rank, minlength=int(self.rank.max()) + 1)
        # Where a run stands more than once, its pages are counted.
        often = self.holders[rank] > 1
        held = np.sort(rank[often] * most + of_page[often])
        self.holders[rank[often]] = 0
        self.holders += np.bincount(held[np.diff(held, prepend=-1) > 0] // most, minlength=len(self.holders))

    def hashed(self, of_token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs: their ranks, and their hashes from those of the tokens."""
        if not len(self.at):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        one = np.zeros(len(self.holders), np.int64)
        one[self.rank[self.at]] = self.at + 1
        ranks = np.flatnonzero(one)
        out, at = np.zeros(len(ranks), np.uint64), one[ranks] - 1
        for k in range(self.length):
            out = out * np.uint64(0x9E3779B97F4A7C15) + of_token[self.tokens[at + k]]
        return ranks, K.mix(out)

    def covered(self, holders: np.ndarray, least: float, bounds: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Per stream, which tokens lie in a run that has least holders; with the streams' blocks' bounds, in one
        that lies in one block."""
        hit = np.zeros(self.total + 1, np.int64)
        starts = self.at[holders[self.rank[self.at]] >= least]
        if bounds is not None and len(starts):
            edges = np.concatenate([b + begin for b, begin in zip(bounds, self.begin.tolist())])
            starts = starts[edges[np.minimum(np.searchsorted(edges, starts, "right"), len(edges) - 1)] >= starts + self.length]
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + self.length, -1)
        covered = np.cumsum(hit[:-1]) > 0
        return [covered[b : b + k] for b, k in zip(self.begin.tolist(), self.size.tolist())]


def repeated(streams: list[np.ndarray], pages: np.ndarray, length: int = REPEAT, least: int = PAGES, share: float = SHARE) -> list[np.ndarray]:
    """Per stream, which tokens lie in a run of length tokens that is in at least least distinct pages, and
    in share of them."""
    runs = Runs(np.concatenate([np.zeros(0, np.int64), *streams]), np.array([len(x) for x in streams], np.int64), pages, length)
    return runs.covered(runs.holders, max(least, share * len(set(pages.tolist()))))


class Group:
    """Some parsed pages of one host, ranked; pages of one name count once for repetition."""

    def __init__(self, texts: list[bytes], kinds: list[bytes], names: list, length: int):
        """texts: a line for each block. kinds: for each block twice the number of its article, and 1 inside main;
        then a number for each one's path."""
        both = [np.frombuffer(x, np.int32).reshape(2, -1) for x in kinds]
        self.texts, self.kinds, self.paths = texts, [x[0] for x in both], [x[1] for x in both]
        buf, off = K.buffers(pa.array(texts, pa.binary()))
        start, end, row = K.spans(buf, off, _WORD)
        first, code = K.equal_spans(buf, start, end)
        self.hashes = K.span_hashes(buf, start[first], end[first])
        size = np.bincount(row, minlength=len(texts))
        # The blocks' bounds in the tokens of their page.
        line = np.flatnonzero(buf == 10)
        of, at = K.rows_of(line, off), np.searchsorted(start, line)
        before = np.append(0, np.cumsum(size))
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        self.bounds = [np.concatenate([[0], at[cut[k] : cut[k + 1]] - before[k], size[k : k + 1]]) for k in range(len(texts))]
        numbers: dict = {}
        self.runs = Runs(code.astype(np.int64), size, np.array([numbers.setdefault(n, len(numbers)) for n in names], np.int64), length)
        self.pages = len(numbers)

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs.hashed(self.hashes)

    def main(self, holders: np.ndarray, least: int, share: float, covered: float, pages: int) -> list[str]:
        """Main text of each page; pages is how many the host has."""
        out = []
        hits, wide = self.runs.covered(holders, least), self.runs.covered(holders, max(least, share * pages))
        template = self.template(holders, least, covered)
        for text, kind, path, bound, *by in zip(self.texts, self.kinds, self.paths, self.bounds, hits, wide):
            lines = text.decode("utf-8", "replace").split("\n")
            out.append("\n".join(lines[k] for k in chosen(kind, bound, *by, covered, np.isin(path, template))) if len(kind) else "")
        return out

    def template(self, holders: np.ndarray, least: int, covered: float) -> np.ndarray:
        """Paths inside articles of whose tokens repeated runs cover more than covered, over pages that aren't copies."""
        total: dict[int, int] = {}
        of: dict[int, int] = {}
        for kind, path, bound, hit in zip(self.kinds, self.paths, self.bounds, self.runs.covered(holders, least, self.bounds)):
            size, held = np.diff(bound), np.diff(np.append(0, np.cumsum(hit))[bound]) if len(bound) > 1 else np.zeros(0, np.int64)
            some = np.flatnonzero(kind > 1)
            if held[some].sum() > COPIED * size[some].sum():
                continue
            for p, n, h in zip(path[some].tolist(), size[some].tolist(), held[some].tolist()):
                total[p], of[p] = total.get(p, 0) + n, of.get(p, 0) + h
        return np.array([p for p, n in total.items() if of[p] > covered * n], np.int64)


def chosen(kind: np.ndarray, bound: np.ndarray, hit: np.ndarray, wide: np.ndarray, covered: float, template: np.ndarray) -> list[int]:
    """The blocks of a page that are its main text, by which tokens are repeated and which all over the host, and which
    blocks are of the host's template."""
    size = np.diff(bound)

    def own_of(some: np.ndarray, by: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(by))[bound]
        return some[np.diff(upto)[some] <= covered * size[some]]

    inside, main = np.flatnonzero(kind > 1), np.flatnonzero(kind & 1)
    if len(inside):
        own = inside[~template[inside]]
        return (own if size[own].sum() >= (1 - COPIED) * size[inside].sum() else inside).tolist()
    some = main if len(main) else np.arange(len(kind))
    fresh = own_of(some, hit)
    if len(fresh) and size[fresh].sum() >= (1 - COPIED) * size[some].sum():
        return fresh.tolist()
    kept = own_of(some, wide)
    return (kept if len(kept) else some).tolist()


PARSED = "host string, salt long, page_id long, url string, name string, blocks binary, kinds binary, parts long, pages long, size long"


def _parse(batches):
    """Each page as its blocks, a line each (compressed), and their kinds."""
    for batch in batches:
        texts, kinds = [], []
        for html in batch.column("html").to_pylist():
            page = blocks(html or "")
            texts.append(zlib.compress("\n".join(b.text for b in page).encode("utf-8", "replace"), 1))
            kinds.append(np.array([[2 * b.article + b.main for b in page], [zlib.crc32(b.path.encode("utf-8", "replace")) >> 1 for b in page]], np.int32).tobytes())
        new = {"blocks": pa.array(texts, pa.binary()), "kinds": pa.array(kinds, pa.binary())}
        names = ["host", "salt", "page_id", "url", "name", "blocks", "kinds", "parts", "pages", "size"]
        yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)


def _group_of(table: pa.Table, length: int) -> Group:
    return Group([zlib.decompress(x) for x in table.column("blocks").to_pylist()], table.column("kinds").to_pylist(), table.column("name").to_pylist(), length)


def _one(function, *args) -> pa.Table:
    """function(*args), giving what it took back to the system."""
    [out] = lean(lambda calls: (function(*x) for x in calls))([args])
    return out


SENT = "host string, salt long, bucket long, runs binary"
SUMS = "host string, salt long, bucket long, hashes binary, n binary"
#: Bits of a run's hash beyond those that count the host's runs. Two runs of a host take each other's place with
#: a chance of 2^-SPARE, and two others a third one's, as repetition needs, with the square of that.
SPARE = 18


def _packed(hashes: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers with counts: the steps between them by byte planes, then the counts above 1."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    many = np.flatnonzero(n > 1).astype(np.uint32)
    head = np.array([len(hashes), len(many)], np.uint32)
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(head.tobytes() + planes.tobytes() + many.tobytes() + n[many].astype(np.uint32).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    size, many = np.frombuffer(data, np.uint32, 2).tolist()
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * size, 8).reshape(8, size).T).view(np.uint64).reshape(-1)
    n = np.ones(size, np.uint32)
    at, more = np.frombuffer(data, np.uint32, 2 * many, 8 + 8 * size).reshape(2, many)
    n[at] = more
    return np.cumsum(steps, dtype=np.uint64), n


def _shortened(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hashes' highest bits, as many as a host with so many characters of html needs, an eighth as many runs."""
    return hashes >> np.uint64(64 - min(64, SPARE + max(1, size >> 3).bit_length()))


def _send(length: int):
    """Of a group of a host that has several: its distinct runs with how many pages hold each, by bucket."""

    def call(key, table):
        parts = table.column("parts")[0].as_py()
        group = _group_of(table if parts > 1 else table.slice(0, 0), length)
        ranks, hashes = group.hashed()
        hashes = _shortened(hashes, table.column("size")[0].as_py() or 0)
        order = np.lexsort((hashes, hashes % np.uint64(parts)))
        hashes, n = hashes[order], group.runs.holders[ranks[order]]
        found, first = np.unique(hashes % np.uint64(parts), return_index=True)
        packed = [_packed(h // np.uint64(parts), k) for h, k in zip(np.split(hashes, first[1:]), np.split(n, first[1:]))] if len(found) else []
        k = len(found)
        return pa.table({"host": pa.array([key[0].as_py()] * k, pa.string()), "salt": pa.array([key[1].as_py()] * k, pa.int64()), "bucket": pa.array(found.astype(np.int64)), "runs": pa.array(packed, pa.binary())})

    def run(key, table):
        return _one(call, key, table)

    return run


def _add(least: int):
    """Adds up a bucket's runs over the groups of a host; each group gets the sums of its own, from least on."""

    def call(key, table):
        parts = [_unpacked(x) for x in table.column("runs").to_pylist()]
        _, of = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        total = np.bincount(of, np.concatenate([n for _, n in parts]))[of].astype(np.uint32)
        hashes, sums = [], []
        for (own, _), found in zip(parts, np.split(total, np.cumsum([len(h) for h, _ in parts])[:-1])):
            hashes.append(own[found >= least].tobytes())
            sums.append(found[found >= least].tobytes())
        buckets = [key[1].as_py()] * len(parts)
        return pa.table({"host": table.column("host"), "salt": table.column("salt"), "bucket": pa.array(buckets, pa.int64()), "hashes": pa.array(hashes, pa.binary()), "n": pa.array(sums, pa.binary())})

    def run(key, table):
        return _one(call, key, table)

    return run


def _extract(length: int, least: int, share: float, covered: float):
    def call(key, table, sums):
        group = _group_of(table, length)
        holders, pages = group.runs.holders, group.pages
        if table.num_rows and (parts := table.column("parts")[0].as_py()) > 1:
            pages = table.column("pages")[0].as_py()
            ranks, own = group.hashed()
            own = _shortened(own, table.column("size")[0].as_py())
            found = [np.frombuffer(x, np.uint64) * np.uint64(parts) + np.uint64(b) for b, x in zip(sums.column("bucket").to_pylist(), sums.column("hashes").to_pylist())]
            hashes = np.concatenate([np.zeros(0, np.uint64), *found])
            n = np.frombuffer(b"".join(sums.column("n").to_pylist()), np.uint32)
            order = np.argsort(hashes)
            at = np.searchsorted(hashes[order], own)
            at[at == len(hashes)] = 0
            same = hashes[order][at] == own if len(hashes) else np.zeros(len(own), bool)
            holders = np.zeros_like(holders)
            holders[ranks[same]] = n[order][at[same]]
        texts = group.main(holders, least, share, covered, pages)
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string())})

    def run(key, table, sums):
        return _one(call, key, table, sums)

    return run


def main_text(pages: DataFrame, length: int = REPEAT, least: int = PAGES, share: float = SHARE, covered: float = COVERED, group: int = GROUP) -> DataFrame:
    """page_id, url, text of every row of pages (page_id, url, html)."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    named = rows.withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("u"), "url"), F.lit("")))
    names = named.groupBy("host", "name").agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("size"))
    counts = names.groupBy("host").agg(F.sum("n").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("pages"))
    # A host above total / HOSTS pages or characters: there are fewer than 2 * HOSTS of them, so this side is small.
    whole = counts.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    heavy = counts.where((F.col("n") > max(group, (whole.n or 0) // HOSTS)) | (F.col("size") > max(GROUP_BYTES, (whole.size or 0) // HOSTS)))
    heavy = heavy.select("host", "pages", "size", F.greatest(F.ceil(F.col("n") / group), F.ceil(F.col("size") / GROUP_BYTES)).alias("parts"))
    spread = named.join(F.broadcast(heavy), "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("name"), "parts")).select("host", "salt", "page_id", "url", "name", "html", "parts", "pages", "size")
    # Both uses read one shuffle of the parsed pages, which is why the first one isn't filtered before.
    spread = spread.mapInArrow(lean(_parse), PARSED)
    sent = spread.groupBy("host", "salt").applyInArrow(_send(length), SENT)
    sums = sent.groupBy("host", "bucket").applyInArrow(_add(least), SUMS)
    return spread.groupBy("host", "salt").cogroup(sums.groupBy("host", "salt")).applyInArrow(_extract(length, least, share, covered), "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
