"""Reading corpora and side tables; writing tables and small JSON files.

Corpus files, tables and JSON lines go through Spark's readers, so any file system works. Pointers and
manifests are a few hundred bytes and are written by the driver through the Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import documents

#: Side tables by their file's stem. An unknown stem is read with Spark's own inference.
SIDE_SCHEMAS = {
    "service_centers": "name string, region string, models array<string>, warranty_programs array<string>, city string",
    "runbooks": "environment string, procedure_name string, steps array<string>, source_id string",
    "product_catalog": "model string, region string, warranty_program string",
    "users": "user_id string, role string, region string, language string, allowed_disclosures array<string>, source_preference string, high_stakes boolean",
}
QUERY_SCHEMA = "query_id string, query string, task string, route string, user_id string, relevant_doc_ids array<string>, expected_fragments array<string>, assumptions map<string,string>, needs_clarification boolean"


def fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    f, p = fs(spark, path)
    return f.exists(p)


def read_corpus(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, raw, root, ordinal of the .md, .txt and .csv files below the roots, in order of root and path."""
    out = None
    for k, root in enumerate(roots):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt,csv}").load(root)
        one = one.select("path", F.decode("content", "UTF-8").alias("raw"), F.lit(k).alias("root"))
        out = one if out is None else out.unionByName(one)
    # Files are numbered within their folder, then folders in order: no window spans the corpus.
    folder = out.withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
    sizes = folder.groupBy("root", "folder").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("root", "folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("before", before).drop("n")
    rank = F.row_number().over(Window.partitionBy("root", "folder").orderBy("path")) - 1
    return folder.withColumn("rank", rank).join(offsets, ["root", "folder"]).withColumn("ordinal", F.col("before") + F.col("rank")).select("path", "raw", "root", "ordinal")


def load_documents(spark: SparkSession, roots: list[str]) -> DataFrame:
    raw = documents.front_matter(read_corpus(spark, roots))
    is_csv = F.lower("path").endswith(".csv")
    kind = F.map_from_arrays(F.array(F.lit("doc_type")), F.array(F.lit("csv")))
    merged = F.when(is_csv & ~F.map_contains_key("metadata", "doc_type"), F.map_concat("metadata", kind)).otherwise(F.col("metadata"))
    return documents.build_documents(raw.withColumn("metadata", merged))


def read_side_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One table per JSON file of an array of objects, also a temporary view of that name."""
    f, p = fs(spark, folder)
    out = {}
    for s in f.listStatus(p) if f.exists(p) else []:
        name = s.getPath().getName()
        if name.endswith(".json"):
            stem = name[:-5]
            reader = spark.read.option("multiLine", "true")
            out[stem] = (reader.schema(SIDE_SCHEMAS[stem]) if stem in SIDE_SCHEMAS else reader).json(s.getPath().toString())
            out[stem].createOrReplaceTempView(stem)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped, a missing file is empty."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json(spark: SparkSession, path: str, payload) -> None:
    """A small JSON file with sorted keys, replaced as a whole by a rename."""
    f, p = fs(spark, path)
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = f.create(tmp, True)
    out.write(bytearray(json.dumps(payload, sort_keys=True, indent=2, ensure_ascii=False).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    # In one step, so that a reader finds the old file or the new one.
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, p, over)


def read_json(spark: SparkSession, path: str, default=None):
    """A small JSON file; default where it is missing, FileNotFoundError without one."""
    if not exists(spark, path):
        if default is None:
            raise FileNotFoundError(path)
        return default
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def cached(df: DataFrame) -> tuple[str, DataFrame]:
    """df kept in executor memory and disk, and the key of its plan."""
    import hashlib

    return hashlib.sha256(df._jdf.queryExecution().logical().toString().encode()).hexdigest(), df.persist()
