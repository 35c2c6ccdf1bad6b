"""Text, date and number functions as Columns: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def find_all(x: ColumnOrName, pattern: str) -> Column:
    return F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(0))


def tokenize(x: ColumnOrName) -> Column:
    """Lower-case terms; identifiers, and with them trailing . : / -, stay whole."""
    return F.transform(find_all(x, fixed.WORD), F.lower)


def normalize_whitespace(x: ColumnOrName) -> Column:
    """Dashes to -, no-break spaces and runs of blanks to one space, at most one empty line, stripped."""
    plain = F.translate(_c(x), "–—− ", "--- ")
    plain = F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.btrim(plain, F.lit(" \n\t\r\x0b\x0c"))


normalize_query = normalize_whitespace


def identifiers(x: ColumnOrName) -> Column:
    return find_all(x, fixed.IDENTIFIER)


def exact_identifiers(x: ColumnOrName) -> Column:
    return find_all(x, fixed.EXACT_IDENTIFIER)


def numbers(x: ColumnOrName) -> Column:
    return F.array_distinct(find_all(x, fixed.NUMBER))


def split_sentences(x: ColumnOrName) -> Column:
    parts = F.transform(F.split(normalize_whitespace(x), fixed.SENTENCE_GAP), lambda s: F.btrim(s, F.lit(" \n\t\r\x0b\x0c")))
    return F.filter(parts, lambda s: s != "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda would compute it again for every element."""
    return F.transform(F.array(value), body)[0]


def upper_each(x: ColumnOrName) -> Column:
    """Upper case character by character; one that has no single upper character, as ß, stays."""
    return F.array_join(F.transform(F.split(_c(x), ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def padded(x: ColumnOrName) -> Column:
    """What character n-grams are taken from."""
    return F.concat(F.lit("  "), F.lower(normalize_whitespace(x)), F.lit("  "))


def char_ngrams(x: ColumnOrName, n: int = 3) -> Column:
    # From an array of characters: a substring by number would walk the text from its start each time.
    return let(F.filter(F.split(padded(x), ""), lambda c: c != ""), lambda cs: F.transform(F.slice(cs, F.lit(1), F.greatest(F.size(cs) - (n - 1), F.lit(0))), lambda c, i: F.concat(c, *(F.get(cs, i + k) for k in range(1, n)))))


def jaccard(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Of two sets as arrays; 1 for two empty ones."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def value_density(score: ColumnOrName, cost: ColumnOrName) -> Column:
    return _c(score) / F.greatest(F.lit(1), _c(cost))


def stable_hash_mod(x: ColumnOrName, modulus: int) -> Column:
    """SHA-256 as a number modulo modulus: its eight 32-bit words folded from the left."""
    step = pow(2, 32, modulus)
    words = let(F.sha2(_c(x), 256), lambda h: F.array(*(F.conv(F.substr(h, F.lit(i * 8 + 1), F.lit(8)), 16, 10).cast("long") for i in range(8))))
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: (acc * step + w) % modulus)


def stable_hash_sign(x: ColumnOrName) -> Column:
    """-1 where bit 8 of the hash is set, else 1."""
    last = F.conv(F.substr(F.sha2(_c(x), 256), F.lit(57), F.lit(8)), 16, 10).cast("long")
    return F.when(last.bitwiseAND(256) > 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def title_from_stem(x: ColumnOrName) -> Column:
    return F.initcap(F.replace(_c(x), F.lit("_"), F.lit(" ")))


def comma_list(x: ColumnOrName, default: tuple[str, ...] = ()) -> Column:
    items = F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda s: F.btrim(s)), lambda s: s != "")
    return F.when(F.size(items) == 0, F.array(*map(F.lit, default)).cast("array<string>")).otherwise(items)


def loose_date(x: ColumnOrName) -> Column:
    """struct(y, m, d) that compares like a date; missing parts are 1, no date is (0, 0, 0)."""
    parts = F.filter(F.split(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("/"), F.lit("-")), "-"), lambda s: s.rlike("^[0-9]+$"))
    none = F.size(parts) == 0
    part = lambda k: F.when(none, F.lit(0)).otherwise(F.coalesce(F.try_element_at(parts, F.lit(k)).cast("int"), F.lit(1)))
    return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))


def after_date(x: ColumnOrName) -> Column:
    """'after <month> <year>' as yyyy-mm-01, else null."""
    month = F.lower(F.regexp_extract(_c(x), fixed.AFTER_DATE, 1))
    number = F.array_position(F.array(*map(F.lit, fixed.MONTHS)), month)
    return F.when(month != "", F.format_string("%04d-%02d-01", F.try_to_number(F.regexp_extract(_c(x), fixed.AFTER_DATE, 2), F.lit("9999")).cast("int"), number))


def rrf_term(rank: ColumnOrName, constant: int = fixed.RRF) -> Column:
    return 1.0 / (constant + _c(rank))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def contains_any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def duration_ms(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Milliseconds between two timestamps to three places, null for an open span."""
    return F.round((F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / 1000.0, 3)
