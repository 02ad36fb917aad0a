"""CSV and Parquet readers, and the report's sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.functions.semantics import as_column

__all__ = ["read_csv", "read_csv_after", "keep_named_rows", "inline_table", "write_csv",
           "write_by_year", "rewrite_years", "write_features", "feature_lines"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             types: Mapping[str, str] | None = None) -> DataFrame:
    """Headered CSV.  ``NA`` and blanks are NULL; ``n/a`` stays text (rule S8).

    Give a schema wherever it is known: without one Spark reads the file twice to
    infer types.  ``types`` casts single columns of an inferred file.
    """
    reader = (spark.read.option("header", True).option("nullValue", "NA")
              .option("emptyValue", None))
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", types is None).csv(path)
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()}) if types else df


def read_csv_after(spark: SparkSession, path: str, schema: T.StructType, skip: int) -> DataFrame:
    """CSV files, each without its first ``skip`` records (titles, headers, second headers).

    A quoted field may hold line breaks (read back as ``\\n``) and quotes written twice, and a
    file is still read in splits: a first narrow pass counts the lines and quotes of every split,
    sums over a file's splits tell which record and whether inside quotes a split begins.
    Files whose lines have all their quotes in pairs need no more, their lines are records.
    Lines of other files are numbered within their split, and only records of several
    lines are put together.  A quote that a file never closes is an error.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__line"),
        ((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2).alias("__odd"))
    split, in_file = ["__file", "__start"], Window.partitionBy("__file").orderBy("__start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*split).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__line").alias("__first"), F.sum("__odd").alias("__quotes"))
    splits = splits.withColumns({
        "__records": F.coalesce(F.sum("__n").over(before), F.lit(0)),
        "__open": F.coalesce(F.sum("__quotes").over(before), F.lit(0)) % 2,
        "__in_file": F.sum("__quotes").over(Window.partitionBy("__file"))})
    plain = (lines.join(splits.filter("__in_file = 0"), split)
             .filter(F.col("__records") + F.col("__line") - F.col("__first") >= skip).select("value"))
    broken = _records_of_lines(lines, splits.filter("__in_file > 0").drop("__records"), skip)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"nullValue": "NA", "escape": '"'}
    return plain.union(broken).select(F.from_csv("value", ddl, options).alias("r")).select("r.*")


def _records_of_lines(lines: DataFrame, splits: DataFrame, skip: int) -> DataFrame:
    """Records of files in which some lie on several lines, without the first ``skip`` of a file.

    A line begins a record if the quotes before it are in pairs.
    """
    split = ["__file", "__start"]
    in_split = Window.partitionBy(*split).orderBy("__line")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.join(splits, split).withColumn(
        "__begins", (F.col("__open") + F.coalesce(F.sum("__odd").over(earlier), F.lit(0))) % 2 == 0)
    placed = placed.withColumns({
        "__record": F.max(F.when(F.col("__begins"), F.col("__line"))).over(so_far),
        "__number": F.count_if("__begins").over(so_far)})
    # What a split hands on: how many records began in it, and the one that is still open.
    before = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    handed = placed.groupBy(*split).agg(
        F.count_if("__begins").alias("__n"), F.max(F.when(F.col("__begins"), F.col("__line"))).alias("__last"))
    handed = handed.select(
        *split, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__records"),
        F.last("__last", ignorenulls=True).over(before).alias("__still_open"))
    closed = F.when(F.col("__in_file") % 2 == 1, F.raise_error(F.concat(F.lit("a quote is never closed in "), "__file")))
    placed = placed.join(handed, split).select(
        "__file", "__start", "__line", F.coalesce(closed, "value").alias("value"),
        F.coalesce("__record", "__still_open").alias("__record"),
        (F.col("__begins") & (F.col("__odd") == 0)).alias("__whole"),
        (F.col("__number") + F.col("__records") > skip).alias("__wanted")).filter("__wanted")
    pieces = F.sort_array(F.collect_list(F.struct("__start", "__line", "value")))
    together = (placed.filter("NOT __whole").groupBy("__file", "__record")
                .agg(F.array_join(F.transform(pieces, lambda piece: piece["value"]), "\n").alias("value")))
    return placed.filter("__whole").select("value").union(together.select("value"))


def keep_named_rows(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """The rows a sheet really has, by name rather than by position."""
    return df.filter(F.lower(column).isin(list(names)))


_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(),
                "double": pa.float64(), "boolean": pa.bool_()}


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal lookup table, given ``"name type, ..."``.

    It goes in as an Arrow table, which Spark keeps as a local relation of known size;
    rows handed over as Python objects would have no size, and a join with them would
    shuffle the other side.
    """
    fields = [field.strip().rsplit(" ", 1) for field in schema.split(",")]
    columns = zip(*rows) if rows else [()] * len(fields)
    table = pa.table({name: pa.array(list(column), _ARROW_TYPES[kind])
                      for (name, kind), column in zip(fields, columns)})
    return spark.createDataFrame(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_year(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Partitioned by year, so that a one-year query reads one directory."""
    _by_year(df, format).save(path)


def rewrite_years(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write the years of ``df`` again; folders of other years stay as they are.

    The new files are staged and moved in when the job commits, so that a run that fails
    leaves the old year.  Years without a row in ``df`` are not touched.
    """
    _by_year(df, format).option("partitionOverwriteMode", "dynamic").save(path)


def _by_year(df: DataFrame, format: str) -> DataFrameWriter:
    writer = df.write.mode("overwrite").partitionBy("year").format(format)
    return writer.option("header", True) if format == "csv" else writer


def feature_lines(df: DataFrame, properties: Sequence[str], lon: Column | str = "lon",
                  lat: Column | str = "lat") -> DataFrame:
    """One GeoJSON point feature per row, as text lines."""
    point = F.when(as_column(lon).isNotNull() & as_column(lat).isNotNull(), F.struct(
        F.lit("Point").alias("type"),
        F.array(as_column(lon).cast("double"), as_column(lat).cast("double")).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"),
                       F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_features(df: DataFrame, path: str, properties: Sequence[str], lon: Column | str = "lon",
                   lat: Column | str = "lat") -> None:
    feature_lines(df, properties, lon, lat).write.mode("overwrite").text(path)
