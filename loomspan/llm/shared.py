"""What several operators use: tables in the shared folder and the key of a document."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir. Where that is unset, a temporary one, but on a
    local master only: elsewhere a local folder isn't shared."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended first
        pass


#: Spark's setting that a statement's shuffle files go when it ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage, and a lost executor costs no recomputation. The shuffle files
    of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: SQL: what tells documents apart. Rows without an id that share a text are one document.
ROW_KEY = "coalesce(cast(doc_id AS string), concat('#', coalesce(md5(cast(text AS binary)), '')))"
