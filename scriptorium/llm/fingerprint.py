"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in Spark functions only.

A text's shingles are its five-word runs (a text of fewer words, but not none, is one shingle), hashed to 32
bits; the sketch is the K smallest distinct hashes in ascending order. Sketches of parts merge into the
sketch of the whole, and two of them give estimates of resemblance, containment and the number of distinct
shingles. The fingerprint is the sketch in hexadecimal, eight digits each.

The query compares each document with the next one by falling doc_id without an unpartitioned window: ids
are cut at quantiles into about MAX_BUCKETS ranges at most, the first row of each range is also sent as a guest to the end of
the range before it (the first of all to the last), and one window per range sees every successor. That is
one shuffle of the texts; the table of ranges is bounded, so it is broadcast.

Defined cases. A null text is empty. No words: an empty sketch and fingerprint; two empty sketches resemble
with 1, an empty and a full one with 0. Null doc_ids come last in the order, by a hash of their texts.
Equal doc_ids follow each other by that hash. A single row is its own successor. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
ROWS_A_BUCKET, MAX_BUCKETS, QUANTILES = 2000, 200_000, 4096
_RANGE = float(1 << 32)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<long>: the k smallest distinct 32-bit hashes of the text's shingles."""
    pieces = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def of(h: Column) -> Column:
        full = F.transform(F.slice(h, 1, F.greatest(F.size(h) - (words - 1), F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, words))), 32))
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 32))
        return F.when(F.size(h) >= words, full).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(_let(F.transform(pieces, lambda w: F.xxhash64(w)), of))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, column: str, k: int = K, salts: int = 64) -> DataFrame:
    """(key, column): one sketch per key of all its parts' sketches. Hashes are thinned to the k smallest per
    key and salt before they meet, so a hot key sends salts * k hashes at most."""
    one = parts.select(key, F.explode(column).alias("h")).withColumn("salt", F.pmod("h", F.lit(salts))).distinct()
    some = one.withColumn("r", F.row_number().over(Window.partitionBy(key, "salt").orderBy("h"))).where(F.col("r") <= k)
    return some.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of intersection / union: the share of the union's k smallest hashes that both hold."""
    return _let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * _RANGE / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b holds."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def _buckets(docs: DataFrame, rows_a_bucket: int, max_buckets: int) -> Column:
    """Numbers of ranges by falling doc_id, those of null ids, by hash, after all others.

    Ranges are cut at quantiles of the ids, so that outliers and clusters do not fill one of them; where more
    ranges than quantiles are needed, each is cut into equal widths."""
    falling = F.bitwise_not("doc_id")  # unlike the negative, within a long for every id
    shares = [k / QUANTILES for k in range(1, QUANTILES)]
    size = docs.agg(F.min(falling).alias("lo"), F.max(falling).alias("hi"), F.count("*").alias("n"), F.percentile_approx(falling, shares, 8 * QUANTILES).alias("bounds")).first()
    want = max(1, min(max_buckets, size.n // rows_a_bucket))
    every = max(1, QUANTILES // want)
    cuts = sorted(set((size.bounds or [])[every - 1 :: every])) if want > 1 else []
    fine = -(-want // (len(cuts) + 1))
    table = lambda values: F.from_json(F.lit(json.dumps(values)), "array<bigint>")

    # How many cuts are not above the id: a binary search, from the largest step down.
    at = F.lit(0)
    if cuts:
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
        at = F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(table(cuts), found + step - 1) <= falling, found + step).otherwise(found))
    if fine > 1 and size.lo is not None:

        def within(r: Column) -> Column:
            low, high = (F.get(table(x), r).cast("double") for x in ([size.lo, *cuts], [*cuts, size.hi]))
            return r * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((falling.cast("double") - low) / (high - low + 1) * fine)))

        at = _let(at, within)
    nulls = (len(cuts) + 1) * fine + F.floor(_hashed() / F.lit((1 << 63) // 64 + 1))
    return F.when(F.col("doc_id").isNotNull(), at).otherwise(nulls).cast("long")


def _hashed() -> Column:
    return F.shiftrightunsigned(F.xxhash64("text"), 1)


def with_successor(docs: DataFrame, rows_a_bucket: int = ROWS_A_BUCKET, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """docs (doc_id, text, sketch) with next_text and next_sketch, those of the next row by falling doc_id."""
    bucket = _buckets(docs, rows_a_bucket, max_buckets)
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id").alias("o"), _hashed().alias("h"))
    rows = docs.withColumns({"bucket": bucket, "place": place})
    narrow = docs.select("doc_id", "text").withColumns({"bucket": bucket, "place": place})
    first = narrow.groupBy("bucket").agg(F.min("place").alias("first"))
    order = Window.orderBy("bucket")  # max_buckets + 64 rows at most, about
    last = F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = first.withColumn("before", F.coalesce(F.lag("bucket").over(order), last))
    guests = F.when(F.col("place") == F.col("first"), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest"))))
    sent = rows.join(F.broadcast(first), "bucket").select("doc_id", "text", "sketch", "place", F.explode(guests).alias("at"))
    sent = sent.select("doc_id", "text", "sketch", "place", F.col("at.bucket").alias("bucket"), F.col("at.guest").alias("guest"))
    w = Window.partitionBy("bucket").orderBy("guest", "place")
    return sent.withColumns({"next_text": F.lead("text").over(w), "next_sketch": F.lead("sketch").over(w)}).where("not guest").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: its sketch, its successor's, and that of the text with its last half replaced by the successor's start."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = with_successor(base.withColumn("sketch", sketch(F.col("text"), k)))
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.left("next_text", F.floor(n / 2).cast("int")))
    out = base.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return out.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k).alias("edited_sketch"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    near = {"near_edited": resemblance(F.col("sketch"), F.col("edited_sketch")), "near_next": resemblance(F.col("sketch"), F.col("next_sketch"))}
    prints = {"fingerprint": fingerprint(F.col("sketch")), "edited_fingerprint": fingerprint(F.col("edited_sketch"))}
    return out.withColumns(prints | near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
