"""Written intermediate tables in the shared folder of the session.

Wide steps cut their lineage here: a lost executor then rereads a table instead
of repeating everything before it. The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a temporary
folder is made and used for the rest of the session.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

#: Rows of a batch between the JVM and Python: some megabytes of usual texts.
BATCH_ROWS = 1_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; on one machine (tests, a laptop) a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    # The schema is given, since an empty table leaves no file to infer it from; partition columns come last.
    fields = sorted(df.schema.fields, key=lambda f: f.name == partition_by)
    return spark.read.schema(T.StructType(fields)).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let tasks exchange at most BATCH_ROWS rows at a time with Python, as texts are long; a smaller setting of the caller stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS or int(spark.conf.get(setting)) <= 0:
        spark.conf.set(setting, BATCH_ROWS)


def release(spark: SparkSession) -> None:
    """Give back what earlier work left in the driver: unreferenced frames and broadcasts, Arrow's pool, and free heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every table written by this library; call it when no result is in use any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quarry")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
