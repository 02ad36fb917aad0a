"""Readers and sinks on whole tables: each query writes files to the shared folder and reads them back.

Writing is part of building these queries; every other query stays lazy unless it asks for
medians or ranks over many members, which take their passes when called.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.functions.text import slug_names, times_label, ratio_label, to_ascii
from placemetrics.queries import tables as t
from placemetrics.queries.registry import register
from placemetrics.sources.files import (keep_named_rows, read_csv, read_csv_after, rewrite_years, write_by_year, write_csv,
                                        write_features)
from placemetrics.sources.mappings import read_mapping
from placemetrics.sources.points import read_points, write_points
from placemetrics.sources.workbooks import read_workbook, write_workbooks
from placemetrics.storage import shared_folder


#: Rows of one file with headers, about.
ROWS_PER_FILE = 10_000


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{name}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Missing and special texts through a CSV file and a given schema."""
    path = _new_path(spark, "csv")
    region = F.when(F.col("n_regionkey") == 0, None).when(F.col("n_regionkey") == 1, "n/a").otherwise(
        F.concat(F.lit('a "quoted", '), F.col("n_name")))
    write_csv(t.read(spark, folder, "nation").select("n_nationkey", region.alias("note"), F.col("n_name")), path)
    return read_csv(spark, path, "n_nationkey int, note string, n_name string")


def csv_with_types(spark: SparkSession, folder: str) -> DataFrame:
    """Single columns forced to a type; text that is no number becomes missing."""
    path = _new_path(spark, "types")
    answer = F.when(F.col("c_acctbal") < 0, "refused").otherwise(F.floor("c_acctbal").cast("string"))
    write_csv(t.read(spark, folder, "customer").select("c_custkey", answer.alias("balance")), path)
    return read_csv(spark, path, types={"c_custkey": "bigint", "balance": "double"})


def csv_after_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Several files, each with a title and a second header to skip."""
    path = _new_path(spark, "headers")
    suppliers = t.read(spark, folder, "supplier")
    files = max(3, -(-suppliers.count() // ROWS_PER_FILE))
    lines = suppliers.select(F.pmod(F.xxhash64("s_suppkey"), F.lit(files)).alias("file"), F.lit(1).alias("place"),
                             F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey").alias("value"))
    heads = spark.range(2 * files).select(F.floor(F.col("id") / 2).alias("file"), F.lit(0).alias("place"),
                                          F.concat(F.lit("title "), F.col("id") % 2).alias("value"))
    # a file's rows are in one partition, so its two heads stand first
    dealt = heads.union(lines).repartition("file").sortWithinPartitions("file", "place")
    dealt.select("file", "value").write.option("maxRecordsPerFile", 0).partitionBy("file").text(path)
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType()),
                           T.StructField("s_nationkey", T.IntegerType())])
    return read_csv_after(spark, f"{path}/file=*", schema, 2)


def csv_with_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """All orders with comments of up to three lines, two head records a file, read in many splits."""
    path = _new_path(spark, "breaks")
    orders = t.read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    note = F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('",\n'), F.repeat(F.lit("so on\n"), F.col("o_custkey").cast("int") % 3))
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('"'), F.replace(note, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(
        F.col("o_orderpriority"))
    files = F.pmod(F.xxhash64("o_orderkey"), F.lit(3))
    rows = orders.select(files.alias("file"), F.lit(1).alias("place"), F.concat_ws(",", "o_orderkey", text, "o_custkey").alias("value"))
    heads = spark.range(6).select((F.col("id") % 3).alias("file"), F.lit(0).alias("place"), F.lit('key,"a\nnote",customer').alias("value"))
    dealt = heads.union(rows).repartition("file").sortWithinPartitions("file", "place")
    dealt.select("file", "value").write.partitionBy("file").text(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("note", T.StringType()), T.StructField("o_custkey", T.LongType())])
    read = read_csv_after(spark, f"{path}/file=*", schema, 2)
    return read.select("o_orderkey", F.md5("note").alias("note"), "o_custkey")


def one_year_written_again(spark: SparkSession, folder: str) -> DataFrame:
    """All orders by year as CSV; then one year again with other answers, the others kept."""
    path = _new_path(spark, "again")
    orders = t.read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    write_by_year(orders, path, "csv")
    rewrite_years(orders.filter("year = 1997").withColumn("o_orderstatus", F.lit("again")), path, "csv")
    back = spark.read.schema("o_orderkey bigint, o_orderstatus string, year int").option("header", True).csv(path)
    return back.groupBy("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"))


def named_rows(spark: SparkSession, folder: str) -> DataFrame:
    return keep_named_rows(t.read(spark, folder, "nation").select("n_nationkey", "n_name"), "n_name",
                           ["nation_1", "nation_7", "nation_99"])


def mapping_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup file by its kind: columns go by position."""
    path = _new_path(spark, "mapping")
    rows = t.read(spark, folder, "nation").join(t.read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    write_csv(rows.select(F.lower("n_name").alias("anything"), F.col("r_regionkey") > 2, F.lower("r_name")), path)
    return read_mapping(spark, path, "country metadata")


def written_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """All orders partitioned by year; one year is read back through its own folder."""
    path = _new_path(spark, "years")
    orders = t.read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    write_by_year(orders, path)
    return spark.read.parquet(path).groupBy("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


def written_features(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as GeoJSON lines, read back as text."""
    path = _new_path(spark, "features")
    rows = t.read(spark, folder, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").cast("double").alias("lon"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.5)).alias("lat"))
    write_features(rows, path, ["name"])
    read = F.from_json("value", "geometry struct<coordinates: array<double>>, properties struct<name: string>")
    return spark.read.text(path).select(read.alias("f")).select(
        F.col("f.properties.name").alias("name"), F.get("f.geometry.coordinates", F.lit(0)).alias("lon"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def written_points(spark: SparkSession, folder: str) -> DataFrame:
    """All customers as a point layer, read back: names cut and numbered, points missing where a coordinate is."""
    path = _new_path(spark, "points")
    rows = t.read(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("customer_name"), F.col("c_acctbal").cast("double").alias("balance"),
        (F.col("c_acctbal") < 0).alias("in_debt"), F.col("c_nationkey").cast("double").alias("lon"),
        F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") / 7).alias("lat"))
    write_points(rows, path, ["customer_key", "customer_name", "balance", "in_debt"])
    return read_points(spark, path)


def workbook_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """All orders in workbooks with a title and a header, read back with the types wanted."""
    path = _new_path(spark, "books")
    orders = t.read(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit(" <"), "o_orderpriority", F.lit("> & so on"))).alias("note"),
        F.col("o_totalprice").cast("double").alias("price"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("done"))
    write_workbooks(orders, path, "Orders", ["all orders"])
    return read_workbook(spark, path, "Orders", 1, "o_orderkey bigint, note string, price double, day date, done boolean")


def slugged_names(spark: SparkSession, folder: str) -> DataFrame:
    """Headers made from texts with accents, blanks and repeats."""
    headers = ["Région Clé", "region  cle", "2017 Name!"]
    return t.read(spark, folder, "region").select("r_regionkey", "r_regionkey", "r_name").toDF(*slug_names(headers))


def ratio_labels(spark: SparkSession, folder: str) -> DataFrame:
    ratio = F.col("o_totalprice") / 1000
    return t.read(spark, folder, "orders").select("o_orderkey", times_label(ratio).alias("times"), ratio_label(ratio).alias("to_one"))


def folded_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    """Curly quotes, dashes and marks put around every part name and folded again."""
    odd = F.concat(F.lit("“"), F.col("p_name"), F.lit("” – i don’t know… é © "), F.col("p_brand"))
    return t.read(spark, folder, "part").select("p_partkey", to_ascii(odd).alias("folded"))


register("csv_round_trip", csv_round_trip,
         """SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN NULL WHEN 1 THEN 'n/a'
         ELSE 'a "quoted", ' || n_name END AS note, n_name FROM nation""")
register("csv_with_types", csv_with_types,
         """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal) END AS balance
         FROM customer""")
register("csv_after_headers", csv_after_headers, "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
register("csv_with_line_breaks", csv_with_line_breaks,
         """SELECT o_orderkey, md5(CASE WHEN o_orderkey % 4 = 0 THEN 'said "' || o_orderpriority || '",' || chr(10)
         || repeat('so on' || chr(10), CAST(o_custkey % 3 AS INTEGER)) ELSE o_orderpriority END) AS note, o_custkey FROM orders""")
register("one_year_written_again", one_year_written_again,
         """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN year(o_orderdate) = 1997 THEN 'again'
         ELSE o_orderstatus END AS o_orderstatus, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys
         FROM orders GROUP BY 1, 2""")
register("named_rows", named_rows,
         "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) IN ('nation_1', 'nation_7', 'nation_99')")
register("mapping_round_trip", mapping_round_trip,
         """SELECT lower(n_name) AS country, r_regionkey > 2 AS is_eu, lower(r_name) AS currency_code
         FROM nation JOIN region ON n_regionkey = r_regionkey""")
register("written_by_year", written_by_year,
         """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS orders
         FROM orders GROUP BY 1, 2""")
register("written_features", written_features,
         """SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS DOUBLE) END AS lon,
         CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS lat FROM supplier""")
register("written_points", written_points,
         """SELECT CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey AS DOUBLE) END AS lon,
         CASE WHEN c_custkey % 3 > 0 THEN c_custkey / 7 END AS lat, CAST(c_custkey AS BIGINT) AS customer_k,
         c_name AS customer_n, CAST(c_acctbal AS DOUBLE) AS balance, c_acctbal < 0 AS in_debt FROM customer""")
register("workbook_sheets", workbook_sheets,
         """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN '<' || o_orderpriority || '> & so on' END AS note,
         CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS done FROM orders""")
register("slugged_names", slugged_names,
         "SELECT r_regionkey AS region_cle, r_regionkey AS region_cle1, r_name AS x2017_name FROM region")
register("ratio_labels", ratio_labels,
         """SELECT o_orderkey, format('{:,.2f}x', round_even(o_totalprice / 1000, 2)) AS times,
         format('{:,.1f}:1', round_even(o_totalprice / 1000, 1)) AS to_one FROM orders""")
register("folded_punctuation", folded_punctuation,
         """SELECT p_partkey, '"' || p_name || '" - i don''t know... e (C) ' || p_brand AS folded FROM part""")
