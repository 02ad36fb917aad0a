import csv
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.queries import files
from placemetrics.sources.files import read_csv_after, rewrite_years, write_by_year


def test_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_FILE", 50, raising=False)
    where = str(tmp_path / "written")
    monkeypatch.setattr(files, "_new_path", lambda spark, name: where)
    spark.range(1000).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 25 as int) as s_nationkey").write.parquet(
        f"{tmp_path}/supplier.parquet")
    got = files.csv_after_headers(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(k, f"s{k}", k % 25) for k in range(1000)]
    written = [p.read_text().splitlines() for p in Path(where).rglob("*.txt")]
    assert len(written) == 20 and all(lines[:2] == ["title 0", "title 1"] for lines in written)
    assert max(map(len, written)) < 150


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("note", T.StringType()), T.StructField("n", T.IntegerType())])


def written(folder, draw, plain):
    """Two files of 300 records after two head records; returns the records by Python's own reader."""
    expected = []
    for name in ("a", "b"):
        notes = ["one", "two words", "comma, inside", 'quote " inside', 'all "" of,\nit "'] + ([] if plain else ["line\nbreak", "\n\n", 'x\n"y"\n,z'])
        notes = [n for n in notes if not plain or "\n" not in n]
        with open(folder / f"{name}.csv", "w", newline="") as out:
            sheet = csv.writer(out, lineterminator="\n")
            sheet.writerow(["k", "the note" if plain else "the\nnote", "n"])
            sheet.writerow(["key", 'long "head"', "number"])
            for k in range(300):
                sheet.writerow([k, draw.choice(notes) + f" {k}", "NA" if k % 7 == 0 else k % 5])
        with open(folder / f"{name}.csv", newline="") as back:
            expected += [(int(k), note, None if n == "NA" else int(n)) for k, note, n in list(csv.reader(back))[2:]]
    return sorted(expected, key=repr)


@pytest.mark.parametrize("split_bytes", [64, 1000, 1 << 20])
@pytest.mark.parametrize("plain", [True, False])
def test_records_over_several_lines_and_splits(spark, tmp_path, split_bytes, plain):
    expected = written(tmp_path, random.Random(split_bytes), plain)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_csv_after(spark, str(tmp_path), SCHEMA, 2)
        assert split_bytes > 1000 or spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 10
        assert sorted(map(tuple, df.collect()), key=repr) == expected
        for skip in (0, 40):
            assert read_csv_after(spark, str(tmp_path), SCHEMA, skip).count() == 604 - 2 * skip
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_quote_never_closed_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text('head\n1,"open,2\n3,b,4\n')
    with pytest.raises(Exception, match="a quote is never closed in"):
        read_csv_after(spark, str(tmp_path), SCHEMA, 1).collect()
    (tmp_path / "x.csv").write_text("")
    assert read_csv_after(spark, str(tmp_path), SCHEMA, 1).collect() == []


@pytest.mark.parametrize("format", ["csv", "parquet"])
def test_one_year_again_leaves_the_others(spark, tmp_path, format):
    where = tmp_path / "years"
    df = spark.range(300).selectExpr("id", "cast(2015 + id % 3 as int) as year")
    write_by_year(df, str(where), format)
    seen = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in where.rglob(f"*.{format}")}
    rewrite_years(df.filter("year = 2016 and id < 50"), str(where), format)
    after = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in where.rglob(f"*.{format}")}
    kept = {p: v for p, v in seen.items() if "year=2016" not in str(p)}
    assert kept and all(after[p] == v for p, v in kept.items())
    back = spark.read.option("header", True).schema("id bigint, year int").format(format).load(str(where))
    assert back.filter("year = 2016").count() == 17 and back.count() == 217
    broken = df.filter("year = 2015").withColumn("id", F.when(F.col("id") > 90, F.raise_error("stop")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        rewrite_years(broken, str(where), format)
    assert back.filter("year = 2015").count() == 100
