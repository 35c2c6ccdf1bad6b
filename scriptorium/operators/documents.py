"""From raw files to documents and chunks: front matter, projection, duplicates, quarantine, chunking."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import policy, text
from .lineage import cut

_BLANKS = " \n\t\r\x0b\x0c"
DOCUMENT = ("doc_id", "title", "text", "doc_type", "product", "region", "effective_date", "version", "authority", "status", "disclosure", "language", "allowed_roles", "tags", "references", "trust_score", "quality_score", "quarantine_reason", "metadata", "ordinal")
#: What a document has where its front matter has no such key.
DEFAULTS = {"doc_type": "note", "product": "", "region": "global", "effective_date": "", "version": "", "authority": "reference", "status": "active", "disclosure": "internal", "language": "en"}


def newlines(x: Column) -> Column:
    """Line ends of any kind as one newline."""
    return F.regexp_replace(x, "\\r\\n|\\r|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x85|\\u2028|\\u2029", "\n")


def front_matter(raw: DataFrame, column: str = "raw") -> DataFrame:
    """raw with metadata (map, the last of equal keys wins) and body; without a front matter block all is body."""
    pattern = "(?s)\\A---\\n(.*?)\\n---\\n(.*)\\z"
    x = F.regexp_replace(F.col(column), "\\r\\n|\\r", "\n")
    has = x.rlike(pattern)
    lines = F.filter(F.split(F.regexp_extract(x, pattern, 1), "\\n"), lambda s: s.contains(":"))
    pair = F.transform(lines, lambda s: F.struct(F.btrim(F.substring_index(s, ":", 1)).alias("key"), F.btrim(F.substr(s, F.locate(":", s) + 1)).alias("value")))
    # The last of equal keys: kept here, as the map's policy for duplicates is a session setting.
    last = F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, i + 2, F.greatest(F.size(pair), F.lit(1))), lambda q: q["key"] == p["key"]))
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return raw.withColumn("metadata", F.when(has, F.map_from_entries(last)).otherwise(empty)).withColumn("body", F.when(has, F.regexp_extract(x, pattern, 2)).otherwise(x))


def build_documents(raw: DataFrame) -> DataFrame:
    """Documents from rows (path, body, metadata, ordinal). Present but empty keys stay empty, save for title."""
    meta = lambda k, default=None: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(default))
    stem = F.regexp_extract("path", "([^/]*?)(?:\\.[^./]*)?$", 1)
    title = F.coalesce(F.when(meta("title") != "", meta("title")), text.title_from_stem(stem))
    ocr = F.coalesce(F.try_to_number(meta("ocr_confidence"), F.lit("9.999999")).cast("double"), F.lit(1.0))
    out = raw.select(
        meta("doc_id", None).alias("given"), stem.alias("stem"), title.alias("title"), F.col("body"), *(meta(k, v).alias(k) for k, v in DEFAULTS.items()),
        text.comma_list(meta("allowed_roles", "field_support"), ("field_support",)).alias("allowed_roles"), text.comma_list(meta("tags")).alias("tags"), text.comma_list(meta("references")).alias("references"),
        policy.trust_score("body", title).alias("trust_score"), policy.quality_score("body", title, ocr).alias("quality_score"), policy.quarantine_reason("body", title, ocr).alias("quarantine_reason"), "metadata", "ordinal",
    )
    return out.withColumn("doc_id", F.coalesce("given", "stem")).withColumn("text", text.normalize_whitespace("body")).select(*DOCUMENT)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with duplicate_of: the first document of equal title, product (lower-cased) and text; null if it is that one.

    The first per key comes from an aggregation, so a hot key shuffles one row a task, not all its rows. Classes of
    more than a thousandth of all rows, fewer than a thousand then, are sent to all tasks; the others are joined."""
    key = [F.lower("title").alias("k1"), F.lower("product").alias("k2"), F.sha2("text", 256).alias("k3")]
    first = docs.select(*key, "doc_id", "ordinal").groupBy("k1", "k2", "k3").agg(F.min_by("doc_id", "ordinal").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    often = max(1000, docs.count() // 1000 + 1)
    hot = first.where(F.col("n") >= often).select("k1", "k2", "k3", F.col("first_id").alias("hot_id"))
    rest = first.where(F.col("n") < often).drop("n")
    keyed, names = docs.select("*", *key), ["k1", "k2", "k3"]
    few = keyed.join(F.broadcast(hot.drop("hot_id")), names, "left_anti").join(rest, names, "left")
    many = keyed.join(F.broadcast(hot.withColumnRenamed("hot_id", "first_id")), names)
    joined = few.unionByName(many).drop(*names)
    return joined.withColumn("duplicate_of", F.when(F.col("first_id") != F.col("doc_id"), F.col("first_id"))).drop("first_id")


def token_sets(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, ordinal, more, set (distinct tokens of title and text without stop words, sorted), h (its digest)."""
    tokens = F.array_sort(F.array_except(F.array_distinct(text.tokenize(F.concat_ws(" ", "title", "text"))), F.array(*map(F.lit, fixed.STOPWORDS))))
    return docs.select("doc_id", "ordinal", *more, tokens.alias("set")).withColumn("h", F.sha2(F.array_join("set", " "), 256))


def set_classes(sets: DataFrame) -> DataFrame:
    """A row per distinct token set: h, first (the least ordinal), first_id, set, members, n. Copies meet as partial sums."""
    return sets.groupBy("h").agg(F.min("ordinal").alias("first"), F.min_by("doc_id", "ordinal").alias("first_id"), F.first("set").alias("set"), F.count("*").alias("members")).withColumn("n", F.size("set"))


def signatures(classes: DataFrame, threshold: float = fixed.NEAR_DUPLICATE) -> DataFrame:
    """(w, first, n): two sets that reach the threshold have a w in common, whatever other sets there are.

    Words are dealt into parts by their hash. Sets that reach the threshold differ in at most (1 - t) / (1 + t) of the sum of
    their sizes, so with one part more than that there is one in which they do not differ: w is the digest of a part's words.
    Sizes are put into steps of 1 / t, so that such sets are in one step or in two that follow each other, and each set is
    dealt out for its own step and for the next; a step has as many parts as its largest sizes need. A set is dealt out where it
    is read, and nothing is shuffled."""
    step = max(-math.log(threshold), 1e-3) * 1.0001
    parts = lambda level: (F.floor(2 * F.floor(F.exp((level + 1) * step) + 1e-6) * ((1 - threshold) / (1 + threshold)) + 1e-6) + 1).cast("long")
    kind = classes.schema["first"].dataType.simpleString()
    hashed = classes.where("n > 0").select("first", "n", F.floor(F.log("n") / step).alias("level"), F.transform("set", lambda w: F.xxhash64(w)).alias("hs"))
    ready = hashed.select("first", "n", "level", parts(F.col("level")).alias("parts"), parts(F.col("level") + 1).alias("next_parts"), "hs", F.transform("hs", lambda h: F.xxhash64(h)).alias("xs"))
    digest = ready.mapInArrow(_dealt(), f"first {kind}, n int, level long, part long, digest long")
    return digest.select(F.xxhash64("level", "part", "digest").alias("w"), "first", "n")


def _dealt():
    """Over batches of (first, n, level, parts, next_parts, hs, xs): for the level and the next a row a part with the digest of
    its words, of which hs decide the part and xs are added up; a part without words counts as well."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                hs, xs = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("hs", "xs"))
                level = batch.column("level").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(level)), np.diff(batch.column("hs").offsets.to_numpy()))
                for k, c in enumerate(("parts", "next_parts")):
                    n = batch.column(c).to_numpy(zero_copy_only=False)
                    first = np.cumsum(n) - n
                    digest = np.zeros(int(n.sum()), np.int64)
                    np.bitwise_xor.at(digest, first[row] + hs % n[row], xs)
                    of = np.repeat(np.arange(len(n)), n)
                    at = pa.array(of)
                    yield pa.RecordBatch.from_arrays([batch.column("first").take(at), batch.column("n").take(at), pa.array(level[of] + k), pa.array(np.arange(len(of)) - first[of]), pa.array(digest)], names=["first", "n", "level", "part", "digest"])

    return run


#: Ids that are sent to all tasks at once.
IDS = 300_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose key is in ids (a written table of that column), or with left_anti the others. Ids are sent to where
    df is read, so that no row of it is shuffled; they go in parts of about IDS, for each of which df is read again."""
    n, ids, out = max(1, -(-ids.count() // IDS)), ids.distinct(), None
    for i in range(n):
        mine = F.pmod(F.xxhash64(key), F.lit(n)) == i
        found = df.where(mine).join(F.broadcast(ids.where(mine)), key, how)
        out = found if out is None else out.unionByName(found)
    return out


def _verified(pairs: DataFrame, later: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """first, to, to_id, similarity: of pairs (first, to) those whose full sets reach the threshold. Pairs are written down
    first, and only sets that are in one are shuffled."""
    pairs = cut(pairs)
    mine = by_ids(later.select("first", "first_id", F.col("set").alias("a")), pairs.select("first"), "first")
    other = by_ids(earlier.select(F.col("first").alias("to"), F.col("first_id").alias("to_id"), F.col("set").alias("b")), pairs.select("to"), "to")
    full = pairs.join(mine, "first").join(other, "to")
    return full.where("first_id <> to_id").withColumn("similarity", text.jaccard("a", "b")).where(F.col("similarity") >= threshold).select("first", "to", "to_id", "similarity")


def earliest_links(later: DataFrame, earlier: DataFrame, signed: DataFrame, threshold: float = fixed.NEAR_DUPLICATE) -> DataFrame:
    """first, to, to_id, similarity: for each class of later the earliest one of earlier (itself not among them) whose
    Jaccard reaches the threshold. signed: the signatures of earlier, which has all of later too, with new, whether it is of later.

    Most signatures are of one class: those that are not, less each one's earliest, are written down, and nothing else is read
    again. First all are held against the earliest class with the same signature: members of a group of variants find its head
    there and leave, so the group gives no pairs. Only those that may have a link to something earlier than what they
    found are joined with all that share a signature."""
    by = Window.partitionBy("w")
    shared = signed.select("w", "first", "n", "new", F.min("first").over(by).alias("head"), F.max("new").over(by).alias("wanted"))
    shared = cut(shared.where("wanted and head < first").drop("wanted"))
    mine = shared.where("new")
    to_head = cut(_verified(mine.select("first", F.col("head").alias("to")).distinct(), later, earlier, threshold))
    found = to_head.groupBy("first").agg(F.min_by(F.struct("to", "to_id", "similarity"), "to").alias("link"))
    # A signature whose earliest class is the link, or later than it, can't give an earlier one.
    open_ = mine.join(found, "first", "left").where(F.col("link").isNull() | (F.col("head") < F.col("link.to")))
    others = shared.select("w", F.col("first").alias("to"), F.col("n").alias("n2"))
    fits = F.least("n", "n2") >= F.greatest("n", "n2") * threshold - 1e-9
    pairs = open_.join(others, "w").where((F.col("to") < F.coalesce(F.col("link.to"), F.col("first"))) & fits).select("first", "to").distinct()
    more = _verified(pairs, later, earlier, threshold)
    return to_head.unionByName(more).groupBy("first").agg(F.min_by(F.struct("to", "to_id", "similarity"), "to").alias("link")).select("first", "link.*")


def near_duplicates(docs: DataFrame, threshold: float = fixed.NEAR_DUPLICATE) -> DataFrame:
    """(doc_id, near_duplicate_of, similarity) of documents with an earlier one of Jaccard >= threshold: the
    first such one, not the best. Doc ids are distinct.

    Equal token sets are one class, whose first member stands for it: what is earlier than that and near to it is
    the first for all members, and without such the first member is, for the others. Classes and signatures are
    read several times, so they are written down."""
    sets = token_sets(docs)
    classes = cut(set_classes(sets))
    signed = cut(signatures(classes, threshold))
    links = earliest_links(classes, classes, signed.withColumn("new", F.lit(True)), threshold)
    marked = classes.select("h", "first", "first_id", "members", F.when(F.col("members") == 1, F.col("first_id")).alias("lone")).join(links, "first", "left").where("members > 1 or to_id is not null")
    return mark(sets, marked)


def mark(sets: DataFrame, linked: DataFrame, salts: int = 16) -> DataFrame:
    """doc_id, near_duplicate_of, similarity from each class's first member and link. A hot class is salted; lone is the member
    of a class that has one."""
    salt = lambda c: F.pmod(F.hash(c), F.lit(salts))
    of = linked.select("h", "first", "first_id", "to_id", "similarity", F.explode(F.when(F.col("lone").isNotNull(), F.array(salt("lone"))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("salt"))
    members = sets.select("doc_id", "ordinal", "h", salt("doc_id").alias("salt")).join(of, ["h", "salt"])
    to = F.when(F.col("to_id").isNotNull(), F.col("to_id")).when(F.col("ordinal") > F.col("first"), F.col("first_id"))
    similarity = F.when(F.col("to_id").isNotNull(), F.col("similarity")).otherwise(F.lit(1.0))
    return members.select("doc_id", to.alias("near_duplicate_of"), F.round(similarity, 3).alias("similarity")).where(F.col("near_duplicate_of").isNotNull() & (F.col("near_duplicate_of") != F.col("doc_id")))


def split_quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined). A low score without a reason does not quarantine."""
    reason = F.coalesce("quarantine_reason", F.lit(""))
    return docs.where(reason == ""), docs.where(reason != "")


def sections(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, section_order, section, body: the text under each Markdown heading; before the first one it is 'Body'.

    Lines are numbered by a window over each document's own lines."""
    line = docs.select(*keys, F.posexplode(F.split(newlines(F.col("text")), "\\n")).alias("pos", "line"))
    heading = F.col("line").rlike("^#{1,6}\\s+.*$")
    w = Window.partitionBy(*keys).orderBy("pos")
    line = line.withColumn("heading", F.when(heading, F.btrim(F.regexp_extract("line", "^#{1,6}\\s+(.*)$", 1)))).withColumn("nr", F.sum(heading.cast("int")).over(w))
    part = line.groupBy(*keys, "nr").agg(F.max("heading").alias("section"), F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line")))).alias("lines"))
    part = part.select(*keys, "nr", F.coalesce("section", F.lit("Body")).alias("section"), F.btrim(F.array_join("lines.line", "\n"), F.lit(_BLANKS)).alias("body"))
    found = part.where("body <> ''")
    # A text of headings alone is one section.
    none = docs.select(*keys, F.btrim(F.col("text"), F.lit(_BLANKS)).alias("body")).join(found.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit(0).alias("nr"), F.lit("Body").alias("section"), "body")
    every = found.unionByName(none)
    return every.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("nr")) - 1).alias("section_order"), "section", "body")


def table_rows(parts: DataFrame, keys: tuple[str, ...] = ("doc_id", "section_order")) -> DataFrame:
    """keys, section, row_order, body: a line per row of each Markdown table, 'column: value; ...'.

    A table is a run of at least two lines with two bars or more, blank lines left out; its second line is
    the rule, and rows with another number of cells than the first are dropped."""
    line = parts.select(*keys, "section", F.posexplode(F.split("body", "\\n")).alias("pos", "line")).where("trim(line) <> ''")
    bars = F.length("line") - F.length(F.replace(F.col("line"), F.lit("|"), F.lit("")))
    w = Window.partitionBy(*keys).orderBy("pos")
    line = line.withColumn("is_row", bars >= 2).withColumn("run", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "is_row").orderBy("pos"))).where("is_row")
    run = line.groupBy(*keys, "section", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines")).where("size(lines) >= 2")
    cells = lambda s: F.transform(F.split(F.btrim(F.btrim(s), F.lit("|")), "\\|"), lambda c: F.btrim(c))
    body = run.select(*keys, "section", cells(F.col("lines")[0]["line"]).alias("head"), F.posexplode(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(1)))).alias("nth", "row"))
    body = body.select(*keys, "section", F.col("row.pos").alias("row_order"), "head", cells(F.col("row.line")).alias("cells")).where("size(head) = size(cells)")
    return body.select(*keys, F.concat("section", F.lit(" table row")).alias("section"), "row_order", F.array_join(F.zip_with("head", "cells", lambda h, c: F.concat(h, F.lit(": "), c)), "; ").alias("body"))


#: Texts whose terms a task holds at once.
TEXTS = 128


def _lines_of_windows(most: int, size: int, step: int):
    """For texts as their lines and the terms of each line as written (null: left out), the windows of size and step over the terms: the
    first most lines that share a term with each, joined by spaces. A line among these is among the first most that hold
    that term, so a window looks up its own terms alone."""

    def few(lines, terms):
        import numpy as np
        import pyarrow.compute as pc

        n_lines = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = terms.flatten()
        in_line = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.cumsum(n_lines) - n_lines
        line = np.repeat(np.arange(len(own)), in_line)
        row = np.repeat(np.arange(len(terms)), n_lines)[line]
        coded = own.flatten().dictionary_encode()
        lower = pc.ascii_lower(coded.dictionary).dictionary_encode()
        key = row * max(1, len(lower.dictionary)) + lower.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        # The first lines of each term of a text, each line once, one after the other.
        used, key = np.unique(key, return_inverse=True)
        cell = np.unique(key * max(1, len(own)) + line)
        of, held = np.divmod(cell, max(1, len(own)))
        first = np.searchsorted(of, np.arange(len(used)))
        early = np.arange(len(of)) - first[of] < most
        of, held = of[early], held[early]
        first = np.searchsorted(of, np.arange(len(used) + 1))
        # Windows, and their terms' places.
        total = np.bincount(row, minlength=len(terms))
        begin = np.cumsum(total) - total
        count = np.where(total > size, -(-(total - size) // step) + 1, 0)
        mine = np.repeat(np.arange(len(terms)), count)
        start = (np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count)) * step
        ends, texts = np.append(0, np.cumsum(count)), []
        values = lines.flatten()
        for low in range(0, len(mine), 2048):
            m, s = mine[low : low + 2048], start[low : low + 2048]
            width = np.minimum(size, total[m] - s)
            which = np.repeat(np.arange(len(m)), width)
            at = np.repeat(begin[m] + s - (np.cumsum(width) - width), width) + np.arange(len(which))
            pair = np.unique(which * max(1, len(used)) + key[at])
            which, term = np.divmod(pair, max(1, len(used)))
            n = first[term + 1] - first[term]
            there = np.repeat(first[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            which, found = np.divmod(np.unique(np.repeat(which, n) * max(1, len(own)) + held[there]), max(1, len(own)))
            rank = np.arange(len(which)) - np.searchsorted(which, which)
            which, found = which[rank < most], found[rank < most]
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(len(m) + 1)).astype(np.int32)), values.take(pa.array(found)))
            texts.append(pc.binary_join(listed, " "))
        joined = pa.chunked_array(texts, pa.string()).combine_chunks() if texts else pa.array([], pa.string())
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), joined)

    def run(lines: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.chunked_array([few(lines.slice(i, TEXTS), terms.slice(i, TEXTS)) for i in range(0, len(lines), TEXTS)], pa.list_(pa.string())).combine_chunks()

    return F.arrow_udf(run, "array<string>")


def windows(parts: DataFrame, column: str = "body", size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP, by_lines: bool = True) -> DataFrame:
    """parts exploded to window_order and window.

    Up to size tokens the whole text; else a window every size - overlap tokens. With by_lines a window is
    the first size // 24 lines that share a token with it (so lines can repeat or vanish); else its tokens. A text's work
    grows with its length, and its tokens are not copied to its windows."""
    step = max(size - overlap, 1)
    whole = F.array(F.btrim(F.col(column), F.lit(_BLANKS)))
    if by_lines:
        lines = F.filter(F.transform(F.split(newlines(F.col(column)), "\\n"), lambda s: F.btrim(s, F.lit(_BLANKS))), lambda s: s != "")
        # No term goes over the end of a line.
        tok = parts.withColumn("_lines", lines).withColumn("_terms", F.transform("_lines", lambda s: text.find_all(s, fixed.WORD)))
        tok = tok.withColumn("_n", F.aggregate("_terms", F.lit(0), lambda n, t: n + F.size(t)))
        long = tok.withColumns({c: F.when(F.col("_n") > size, F.col(c)) for c in ("_lines", "_terms")})
        chosen = _lines_of_windows(max(1, size // fixed.LINES_PER), size, step)("_lines", "_terms")
        made = long.withColumn("_w", F.when(F.col("_n") > size, chosen).otherwise(whole))
    else:
        tok = parts.withColumn("_terms", text.tokenize(column)).withColumn("_n", F.size("_terms"))
        starts = F.sequence(F.lit(0), (F.ceil((F.col("_n") - size) / step) * step).cast("int"), F.lit(step))
        cut_up = text.let(F.col("_terms"), lambda t: F.transform(starts, lambda s: F.array_join(F.slice(t, s + 1, F.lit(size)), " ")))
        made = tok.withColumn("_w", F.when(F.col("_n") > size, cut_up).otherwise(whole))
    made = made.drop("_lines", "_terms", "_n")
    # Every text has a window; a plain posexplode would make them once more, to filter by their number.
    return made.select("*", F.posexplode_outer("_w").alias("window_order", "window")).drop("_w")


#: A comma and its cell; a cell that begins with a quote goes to the quote that ends it, or to the end of the line.
_CELL = r',(?:"(?:[^"]++|"")*+(?:"[^,]*+|\z)|[^,]*+)'
_OPEN = r'^,"(?:[^"]++|"")*+\z'


def csv_records(docs: DataFrame) -> DataFrame:
    """doc_id, record (from 0), cells of texts in CSV, blank records left out. Null and empty texts have none.

    A quote opens a cell only at its beginning; in a quoted cell two quotes stand for one, commas stay and line breaks
    vanish; what follows the closing quote is taken as it is. A quote that nothing closes runs to the text's end.

    Whether a line begins in quotes depends on the lines before it: each of them leaves that as it is, turns it round,
    or sets it. So it is what the last line that set it gave, turned round as often as there were turning lines since:
    running sums in place of a walk."""
    cells = lambda s: F.regexp_extract_all(s, F.lit(_CELL), F.lit(0))
    ends_open = lambda start: F.element_at(cells(F.concat(F.lit(start), "line")), -1).rlike(_OPEN)
    quoted = F.col("line").contains('"')
    line = docs.select("doc_id", F.posexplode(F.split(newlines(F.coalesce("text", F.lit(""))), "\\n")).alias("pos", "line"))
    line = line.withColumn("out", F.when(quoted, ends_open(",")).otherwise(F.lit(False))).withColumn("in", F.when(quoted, ends_open(',"')).otherwise(F.lit(True)))
    by = Window.partitionBy("doc_id").orderBy("pos")
    line = line.withColumn("turns", F.sum((F.col("out") & ~F.col("in")).cast("int")).over(by))
    # What a line sets, with the turns up to it, as one value.
    line = line.withColumn("set", F.last(F.when(F.col("out") == F.col("in"), F.struct("out", "turns")), ignorenulls=True).over(by))
    after = (F.coalesce("set.out", F.lit(False)).cast("int") + F.col("turns") - F.coalesce("set.turns", F.lit(0))) % 2
    line = line.withColumn("after", after).withColumn("begins", F.coalesce(F.lag("after").over(by), F.lit(0)) == 0)
    line = line.withColumn("record", F.sum(F.col("begins").cast("int")).over(by) - 1)
    whole = line.groupBy("doc_id", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("line")).where("line <> ''")
    plain = lambda c: F.when(c.startswith(',"'), F.concat(F.replace(F.regexp_extract(c, r'^,"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, r'^,"(?:[^"]++|"")*+"?([^,]*+)\z', 1))).otherwise(F.substr(c, F.lit(2)))
    return whole.select("doc_id", "record", F.transform(cells(F.concat(F.lit(","), "line")), plain).alias("cells"))


def csv_rows(docs: DataFrame) -> DataFrame:
    """doc_id, nth (from 1), head, cells, more: the records after each text's first, which names the columns. cells has
    a value for each distinct name (the last of a name that comes again), null where the record is too short; more
    has what goes beyond the names."""
    by = Window.partitionBy("doc_id").orderBy("record")
    r = csv_records(docs).withColumn("names", F.first("cells").over(by)).withColumn("nth", F.row_number().over(by) - 1).where("nth > 0")
    last = lambda name: F.size("names") - F.array_position(F.reverse("names"), name)
    head = F.array_distinct("names")
    return r.select("doc_id", "nth", head.alias("head"), F.transform(head, lambda k: F.get("cells", last(k).cast("int"))).alias("cells"), F.slice("cells", F.size("names") + 1, F.greatest(F.size("cells") - F.size("names"), F.lit(0))).alias("more"))


def csv_fields(head: str = "head", cells: str = "cells", more: str = "more") -> Column:
    """'name: value; ...' of a row: None for what is missing, and what is too much as a list under None."""
    escaped = lambda s: F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t"))
    shown = lambda s: F.when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), escaped(s), F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped(s), F.lit("'"), F.lit("\\'")), F.lit("'")))
    named = F.zip_with(head, cells, lambda h, c: F.concat(h, F.lit(": "), F.coalesce(c, F.lit("None"))))
    rest = F.when(F.size(more) > 0, F.array(F.concat(F.lit("None: ["), F.array_join(F.transform(more, shown), ", "), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(named, rest), "; ")


_INHERIT = ("title", "product", "region", "effective_date", "version", "authority", "status", "disclosure", "allowed_roles", "tags", "references", "trust_score", "quality_score")


def chunk_documents(docs: DataFrame, size: int = fixed.CHUNK_TOKENS, overlap: int = fixed.CHUNK_OVERLAP) -> DataFrame:
    """Chunks: per section its table rows, then its windows; per row for CSV documents. Texts start with title and section."""
    prose, table = docs.where("doc_type <> 'csv'"), docs.where("doc_type = 'csv'")
    part = sections(prose)
    rows = table_rows(part).select("doc_id", "section_order", F.lit(0).alias("kind"), F.col("row_order").alias("nth"), "section", "body")
    wins = windows(part, "body", size, overlap).select("doc_id", "section_order", F.lit(1).alias("kind"), F.col("window_order").alias("nth"), "section", F.col("window").alias("body"))
    every = rows.unionByName(wins)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_order", "kind", "nth")) - 1
    keep = docs.select("doc_id", *_INHERIT)
    chunks = every.withColumn("order", place).join(keep, "doc_id").withColumn("text", F.concat("title", F.lit(". "), "section", F.lit(". "), "body")).withColumn("chunk_id", F.format_string("%s:chunk-%02d", "doc_id", "order"))
    line = csv_rows(table)
    csv = line.join(keep, "doc_id").select("*", (F.col("nth") - 1).alias("order"), F.lit("row").alias("section"), F.concat("title", F.format_string(". Row %d. ", "nth"), csv_fields()).alias("text"), F.format_string("%s:row-%02d", "doc_id", "nth").alias("chunk_id"))
    columns = ["chunk_id", "doc_id", "text", "section", "order", *_INHERIT]
    both = chunks.select(*columns).unionByName(csv.select(*columns))
    return both.withColumn("token_count", F.size(text.tokenize("text")))
