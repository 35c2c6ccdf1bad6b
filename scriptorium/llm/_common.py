"""What the operators share: tables in and out, scratch tables that survive a lost executor, code shipping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch, and its bytes where Spark can bound them: a worker holds one batch at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_shipped: set[str] = set()
_scratch: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ships the package to the executors, once for each application, and bounds the Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001  an older Spark has no such setting
        pass
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def lean(function: Callable) -> Callable:
    """function over Arrow batches, giving what a batch took back to the system before the next one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL("libc.so.6")
            trim = libc.malloc_trim
            # Arrays of a batch take turns in the heap instead of mapping fresh pages each time (M_MMAP_THRESHOLD).
            libc.mallopt(-3, 1 << 28)
        except (OSError, AttributeError):
            trim = id

        def each() -> Iterator:
            for batch in batches:
                yield batch
                del batch
                trim(0)

        yield from function(each())
        gc.collect()
        trim(0)

    return run


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which driver and executors share. Where
    that is unset, as in tests on one machine, a temporary folder; on a cluster that is an error. It goes when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="scratch-")
        _scratch[app] = f"{base.rstrip('/')}/tables-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_clean, spark, _scratch[app])
    return _scratch[app]


def _clean(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended already
        pass


class Table:
    """A written table: .df reads it anew, drop() deletes its files."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        fs, p = _filesystem(self.spark, self.path)
        fs.delete(p, True)


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> Table:
    """Writes df to the shared scratch folder: cuts the lineage and outlives the executor that made it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return Table(spark, path, df.schema)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file is: in folder, in $TOKENIZER_DIR, or in the installed package."""
    if folder := folder or os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
