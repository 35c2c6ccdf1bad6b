"""Incremental ingest of a table of documents: takes the files that are new since the last run, marks duplicates
against everything taken before, sets questionable documents apart and cuts the others into overlapping chunks.

    python jobs/ingest_documents.py --input DOCUMENTS --output FOLDER --checkpoint FOLDER [--config FILE]

DOCUMENTS is a folder of Parquet files (doc_id, text, lang, source, more), or one file. The output has

  documents/batch=N/lang=L   doc_id, source, trust, quality, status (kept, quarantined, duplicate), duplicate_of,
                             near_duplicate_of, similarity, n_tokens
  chunks/batch=N/lang=L      doc_id, chunk, text: of kept documents only
  keys, sets, signatures, links   what later batches are held against

A file stream with availableNow and a checkpoint decides what is new. A batch that failed runs again with the same
files and replaces its own folders; a run without new files changes nothing. The output belongs to its checkpoint:
use both again, or neither. Doc ids are distinct. A null text is empty, a null lang is `und`."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptorium.functions import policy, text  # noqa: E402
from scriptorium.operators import documents  # noqa: E402
from scriptorium.streaming import incremental  # noqa: E402

log = logging.getLogger("ingest_documents")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "ingest_documents.json")
DOCUMENTS = "doc_id long, text string, lang string, source string"
#: Columns of the output's tables, with their partitions.
TABLES = {
    "documents": "doc_id long, source string, trust double, quality double, status string, duplicate_of long, near_duplicate_of long, similarity double, n_tokens int, batch int, lang string",
    "chunks": "doc_id long, chunk int, text string, batch int, lang string",
}


def load_config(path: str | None = None) -> dict:
    with open(path or CONFIG) as f:
        return json.load(f)


def read_back(spark: SparkSession, output: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{output}/{name}")


def ingest_batch(batch: DataFrame, batch_id: int, output: str, config: dict) -> int:
    """One micro-batch: documents with marks, and chunks; the number of documents. The batch is read again by each step and
    not kept, and its texts are not shuffled."""
    spark = batch.sparkSession
    docs = batch.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("source", F.lit("")).alias("title"), F.lit("").alias("product"), F.coalesce("text", F.lit("")).alias("text"))
    marks = incremental.mark_batch(docs, output, batch_id, config["near_duplicate"])
    scored = docs.select(
        "doc_id", "lang", F.col("title").alias("source"), policy.trust_score("text", "title").alias("trust"), policy.quality_score("text", "title").alias("quality"),
        policy.quarantine_reason("text", "title", F.lit(1.0)).alias("reason"), F.size(text.tokenize("text")).alias("n_tokens"),
    )
    status = F.when(F.col("reason") != "", "quarantined").when(F.coalesce("duplicate_of", "near_duplicate_of").isNotNull(), "duplicate").otherwise("kept")
    out = scored.join(marks, "doc_id", "left").select("doc_id", "lang", "source", "trust", "quality", F.coalesce(status, F.lit("kept")).alias("status"), "duplicate_of", "near_duplicate_of", "similarity", "n_tokens")
    out.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/documents/batch={batch_id}")
    left = read_back(spark, output, "documents").where((F.col("batch") == batch_id) & (F.col("status") != "kept")).select("doc_id")
    kept = documents.by_ids(docs.select("doc_id", "lang", F.col("text").alias("body")), left, "doc_id", "left_anti")
    parts = documents.windows(kept, "body", config["window"], config["overlap"], by_lines=False)
    chunks = parts.select("doc_id", "lang", F.col("window_order").alias("chunk"), F.col("window").alias("text"))
    chunks.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/chunks/batch={batch_id}")
    n_docs, n_chunks = (read_back(spark, output, t).where(F.col("batch") == batch_id).count() for t in TABLES)
    log.info("batch %d: wrote %d documents and %d chunks below %s", batch_id, n_docs, n_chunks, output)
    return n_docs


def as_pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a folder by its path, but one file by a pattern only."""
    path = path.rstrip("/")
    return path if set("*?[{") & set(path) else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input_path: str, output: str, checkpoint: str, config: dict | None = None) -> int:
    """Takes what is new below input_path; the number of rows read."""
    config = config or load_config()
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(as_pattern(input_path))
    taken = []  # rows by batch: the stream's own figure counts a row each time that it is read
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: taken.append(ingest_batch(batch, batch_id, output, config)))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new rows of %s in %d batches", sum(taken), input_path, len(taken))
    return sum(taken)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_documents").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
