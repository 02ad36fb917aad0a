"""Readers and sinks on small files."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.operators import drop_matching, rename_by, select_matching
from placemetrics.sources import (SCHEMAS, inline_table, keep_named_rows, read_csv, read_csv_after,
                                  read_mapping, read_mappings, write_by_year, write_csv,
                                  write_features)
from placemetrics.storage import written_once


def test_mapping_with_mark_and_missing_values(spark, tmp_path):
    text = "﻿city_in_traffic,city_consolidated\rcalgary,calgary\rvancouver_city,NA\r"
    (tmp_path / "cities.csv").write_text(text, encoding="utf-8")
    df = read_mapping(spark, str(tmp_path / "cities.csv"), "traffic cities")
    assert sorted(map(tuple, df.collect())) == [("calgary", "calgary"), ("vancouver_city", None)]


def test_not_available_text_stays(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\nstudent,n/a\nx,432e3\n")
    df = read_csv(spark, str(tmp_path / "m.csv"), "a string, b string")
    assert df.filter("b = 'n/a'").count() == 1
    typed = read_csv(spark, str(tmp_path / "m.csv"), types={"b": "double"})
    assert {r["b"] for r in typed.collect()} == {None, 432000.0}


def test_leading_lines_are_skipped_also_over_many_splits(spark, tmp_path):
    lines = ["a title", "n,s", "second,header"] + [f"{i},row {i}" for i in range(2000)]
    (tmp_path / "sheet.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_csv_after(spark, str(tmp_path / "sheet.csv"), schema, 3)
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 2000 and df.agg(F.sum("n")).first()[0] == 1999000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_inline_table_has_a_known_size(spark):
    df = inline_table(spark, [("a", 1, None), ("b", None, 2.5)], "k string, n int, Some x double")
    assert sorted(map(tuple, df.collect())) == [("a", 1, None), ("b", None, 2.5)]
    joined = spark.range(10).selectExpr("CAST(id AS STRING) AS k").join(df, "k", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert keep_named_rows(df, "k", ["b"]).count() == 1


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a1 int, a2 int, b int")
    assert select_matching(df, "^a").columns == ["a1", "a2"]
    assert drop_matching(df, "^a").columns == ["b"]
    assert rename_by(df, lambda names: [n.upper() for n in names]).columns == ["A1", "A2", "B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("paris", 2016, 1.5), ("rome", 2017, None)],
                               "city string, year int, v double")
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    write_by_year(df, str(tmp_path / "years"))
    one = spark.read.parquet(str(tmp_path / "years")).filter("year = 2017")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()
    write_features(df.withColumns({"lon": F.lit(2.5), "lat": F.lit(48.75)}),
                   str(tmp_path / "map"), ["city"])
    features = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "map")).collect()]
    assert {f["properties"]["city"] for f in features} == {"paris", "rome"}
    assert features[0]["geometry"] == {"type": "Point", "coordinates": [2.5, 48.75]}


def test_skipped_lines_are_skipped_in_every_file(spark, tmp_path):
    from pyspark.sql import types as T

    from placemetrics.sources import read_csv_after

    (tmp_path / "in").mkdir()
    for name, first in (("a", 1), ("b", 4)):
        lines = ["title", "x,y", *(f"{k},v{k}" for k in range(first, first + 3))]
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())])
    found = read_csv_after(spark, str(tmp_path / "in"), schema, 2)
    assert sorted(tuple(r) for r in found.collect()) == [(k, f"v{k}") for k in range(1, 7)]


def test_written_once_uses_the_checkpoint_folder(spark):
    df = written_once(spark.range(5).withColumn("x", F.col("id") * 2))
    folder = spark.conf.get("spark.checkpoint.dir")
    assert df.count() == 5 and all(folder in f for f in df.inputFiles())


def test_mappings(spark, tmp_path):
    samples = {
        "country corrections": "korea south,south korea", "country metadata": "canada,FALSE,cad",
        "industries": "internet,web", "employment statuses": "retired,retired",
        "currencies": "Canadian dollars (C$),cad,1.32", "purchasing power": "Korea South,890.5"}
    paths = {kind: str(tmp_path / f"{kind.replace(' ', '-')}.csv") for kind in samples}
    for kind, line in samples.items():
        header = ",".join(c.split()[0] for c in SCHEMAS[kind].split(", "))
        with open(paths[kind], "w") as file:
            file.write(f"{header}\n{line}\n")
    found = read_mappings(spark, paths)
    assert found.currencies.first()["currency_name"] == "canadian dollars"
    assert tuple(found.purchasing_power.first()) == ("south korea", 890.5)
    assert found.country_metadata.first()["is_eu"] is False
