"""Stored tables of respondents: partitioned by year, bucketed by their key.

What harmonising gives is used by every later block.  Stored once like this, a block of one
year reads that year's folders, and blocks that join tables of the same key and number of
buckets, or group by the key, move no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.storage import shared_folder

__all__ = ["with_key", "store_table", "attach_table"]


def with_key(df: DataFrame, key: str, into: str) -> DataFrame:
    """A key for every row: ``key`` itself, or a negative number where it is missing.

    Surveys without ids would otherwise lie in one bucket.  The number stays with the row once
    the table is stored.
    """
    return df.withColumn(into, F.coalesce(F.col(key).cast("bigint"),
                                          -1 - F.monotonically_increasing_id()))


def store_table(df: DataFrame, key: str, buckets: int | None = None, partition: str | None = "year",
                name: str | None = None, path: str | None = None) -> DataFrame:
    """Write a table in buckets of ``key``, sorted by it, one folder per ``partition``.

    Each bucket of a partition is one file, written by the task that holds the bucket.
    Tables that are to be joined without a shuffle need the same number of buckets, by
    default the session's number of shuffle partitions: choose it for the largest of them.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"placemetrics_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{name}"
    writer = (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
              .option("path", path).bucketBy(buckets, key).sortBy(key))
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return spark.table(name)


def attach_table(spark: SparkSession, path: str, schema: str, key: str, buckets: int,
                 partition: Sequence[str] = ("year",), name: str | None = None) -> DataFrame:
    """A stored table in a session whose catalog does not know it: the same buckets and folders."""
    name = name or f"placemetrics_{uuid.uuid4().hex}"
    by = f"PARTITIONED BY ({', '.join(partition)})" if partition else ""
    spark.sql(f"""CREATE TABLE {name} ({schema}) USING parquet {by}
        CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'""")
    if partition:
        spark.catalog.recoverPartitions(name)
    return spark.table(name)
