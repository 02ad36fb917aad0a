"""Small intermediate tables in the folder that the session's executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it uses its warehouse folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written_once(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back.

    For derived tables bounded by a dimension that several later steps use: the work
    behind them is done once, when this is called, survives lost executors, and their
    real size is known when joins are planned.  The files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/placemetrics-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
