"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quizspark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, batch_rows: int = 512, file_rows: int = 0) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts lineage and survives lost executors.

    Arrow batches hold at most batch_rows rows meanwhile, a file at most file_rows (0: any number). The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quizspark-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, batch_rows)
    try:
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)  # also what a failed write left
    return spark.read.schema(df.schema).parquet(path)
