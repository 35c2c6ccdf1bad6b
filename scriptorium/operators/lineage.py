"""Results that later steps read several times, cut off from the plan that gave them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the folder that spark.checkpoint.dir names. Where it is unset, a local master gets a
    temporary one; a cluster needs a shared one, so it has to be named. (checkpoint() keeps the plan's constraints, which
    unions of such results cannot be rewritten with.)"""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    path = f"{(base or tempfile.mkdtemp(prefix='cut-')).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
