"""Point layers written by tasks and read back."""

import datetime
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from placemetrics.queries.catalogue import QUERIES
from placemetrics.sources import points, read_points, short_names, write_points

SCHEMA = "name string, people bigint, rate double, capital boolean, since date, x double, y double"
ROWS = [("Montréal", 1704694, 0.1 + 0.2, False, datetime.date(1642, 5, 17), -73.5, 45.5),
        (None, None, None, None, None, None, 1.0),
        ("", -2**63, -2.2250738585072014e-308, True, datetime.date(900, 1, 1), math.nan, 1.0),
        ("é" * 127, 2**63 - 1, math.inf, True, None, 180.0, -90.0)]
PROPERTIES = ["name", "people", "rate", "capital", "since"]


def test_names_are_cut_and_stay_different():
    assert short_names(["location_quotient", "Location_Quality", "location_q", "city"]) == [
        "location_q", "Location_1", "location_2", "city"]
    assert all(len(n.encode()) <= 10 for n in short_names(["é" * 9] * 12)) and len(set(short_names(["é" * 9] * 12))) == 12


def test_every_kind_of_column_comes_back(spark, tmp_path):
    path = str(tmp_path / "layer")
    write_points(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, PROPERTIES, "x", "y")
    back = sorted(map(tuple, read_points(spark, path).collect()), key=repr)
    want = [(x, y, n or None, p, None if r == math.inf else r, c, s) if x == x and x is not None
            else (None, None, n or None, p, r, c, s) for n, p, r, c, s, x, y in ROWS]
    assert back == sorted(want, key=repr)
    assert not list(Path(path).glob("_staged*"))


def test_parts_are_bounded_and_files_agree(spark, tmp_path):
    path = str(tmp_path / "many")
    df = spark.range(0, 2 * points.ROWS_PER_PART + 5, 1, 1).select("id", (F.col("id") % 180).cast("double").alias("lon"), F.lit(1.5).alias("lat"))
    write_points(df, path, ["id"])
    assert len(list(Path(path).glob("*.shp"))) == 3
    for shapes in Path(path).glob("*.shp"):
        data, index = shapes.read_bytes(), shapes.with_suffix(".shx").read_bytes()
        assert int.from_bytes(data[24:28]) * 2 == len(data) and int.from_bytes(index[24:28]) * 2 == len(index)
        at = int.from_bytes(index[-8:-4]) * 2
        assert int.from_bytes(data[at : at + 4]) == (len(index) - 100) // 8
    back = read_points(spark, path)
    assert back.agg(F.count_distinct("id"), F.sum(F.col("lon") - F.col("id") % 180)).first() == (2 * points.ROWS_PER_PART + 5, 0.0)


def test_write_modes_and_failed_jobs(spark, tmp_path):
    path = str(tmp_path / "modes")
    df = spark.createDataFrame([("a", 1.0, 2.0)], "city string, lon double, lat double")
    write_points(df, path, ["city"])
    write_points(df.withColumn("city", F.lit("b")), path, ["city"], mode="append")
    assert sorted(r["city"] for r in read_points(spark, path).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="254 bytes"):
        write_points(df.withColumn("city", F.repeat(F.lit("x"), 255)), path, ["city"])
    assert sorted(r["city"] for r in read_points(spark, path).collect()) == ["a", "b"]
    assert not list(Path(path).glob("_staged*"))
    write_points(df.filter("false"), path, ["city"])
    assert read_points(spark, path).collect() == [] and read_points(spark, path).columns == ["lon", "lat", "city"]


@pytest.mark.parametrize("change, message", [({"city": "array(1)"}, "can't hold"), ({"Lat": "1"}, "coordinates")])
def test_columns_a_layer_cannot_hold(spark, tmp_path, change, message):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "city string, x double, y double").withColumns({k: F.expr(v) for k, v in change.items()})
    with pytest.raises(Exception, match=message):
        write_points(df, str(tmp_path / "no"), list(change), "x", "y")


def test_map_cities_come_back(spark, tmp_path):
    cities = QUERIES["map_city_attributes"](spark, "/root/testdata/sf0.01")
    kept = [c for c in cities.columns if c not in ("lon", "lat")]
    path = str(tmp_path / "cities")
    write_points(cities, path, kept)
    back = read_points(spark, path).toDF("lon", "lat", *kept).select(*cities.columns)
    assert back.count() == cities.count() > 0
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, map(tuple, cities.collect())))
