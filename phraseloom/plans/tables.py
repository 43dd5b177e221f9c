"""Tables between the steps of a plan: written to the shared folder, so that a loop's lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (tests on one machine) a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = tempfile.mkdtemp(prefix="phraseloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """df, computed once and stored; reading it again costs a scan, and no executor's loss costs more than its tasks.

    The shuffle files that made it go at once, not when the driver next collects garbage: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/phraseloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(stored: DataFrame) -> None:
    """Delete what settle stored, once nothing reads it any more."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
