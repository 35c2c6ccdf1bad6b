"""Session memory as a table keyed by (session_id, key): the last write counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text


def latest(entries: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last entry per key, by an aggregation: a hot key shuffles a row a task."""
    rest = [c for c in entries.columns if c not in keys]
    return entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("e")).select(*keys, "e.*")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    return latest(memory.unionByName(new), "session_id", "key")


def prune(memory: DataFrame, keep_scopes: list[str]) -> DataFrame:
    return memory.where(F.col("scope").isin(keep_scopes))


def apply_to(intents: DataFrame, memory: DataFrame) -> DataFrame:
    """intents (session_id, product, region, ...) with product and region filled from memory where they are null."""
    m = latest(memory, "session_id", "key").groupBy("session_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"m_{k}") for k in ("product", "region")))
    out = intents.join(m, "session_id", "left")
    return out.withColumns({k: F.coalesce(k, f"m_{k}") for k in ("product", "region")}).drop("m_product", "m_region")


def recall(intents: DataFrame, memory: DataFrame, query: str = "normalized") -> DataFrame:
    """intents (session_id, product, region, normalized, ...) filled from memory (session_id, key, value, scope, seq),
    with remembered (array of what was filled in) and conflict.

    A product is taken from any scope, a region only from entries of the task or the session. conflict: the session
    remembers a product, the query names another model, and what the product was set to is not in the query; pass
    those sessions to forget. Entries without a value are forgotten ones. A null session remembers nothing."""
    e = latest(memory, "session_id", "key").where("value is not null")
    taken = F.when(F.col("key") == "product", F.col("value")), F.when((F.col("key") == "region") & F.col("scope").isin("task", "session"), F.col("value"))
    m = e.groupBy("session_id").agg(F.max(taken[0]).alias("m_product"), F.max(taken[1]).alias("m_region"))
    out = intents.join(m, "session_id", "left")
    low = F.lower(query)
    fills = [F.when(F.col(k).isNull() & F.col(f"m_{k}").isNotNull(), F.concat(F.lit(f"{k}="), f"m_{k}")) for k in ("product", "region")]
    out = out.withColumn("remembered", F.array_compact(F.array(*fills))).withColumns({k: F.coalesce(k, f"m_{k}") for k in ("product", "region")})
    other = F.col("m_product").isNotNull() & ~low.contains(F.lower("product")) & text.contains_any(low, fixed.MODEL_WORDS)
    return out.withColumn("conflict", F.coalesce(other, F.lit(False))).drop("m_product", "m_region")


def forget(memory: DataFrame, sessions: DataFrame, keep_scopes: tuple[str, ...] = ("profile",)) -> DataFrame:
    """The entries that remain once the named sessions (session_id, repeated or not) have lost what is of other scopes."""
    e = latest(memory, "session_id", "key")
    hit = sessions.select("session_id").distinct().withColumn("hit", F.lit(True))
    gone = F.coalesce("hit", F.lit(False)) & ~F.coalesce(F.col("scope").isin(*keep_scopes), F.lit(False))
    return e.join(hit, "session_id", "left").where(~gone & F.col("value").isNotNull()).drop("hit")
