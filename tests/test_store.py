"""Stored respondents, counted lookups, and distinct counts from bitmaps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from placemetrics.operators import LookupReport, distinct_counts, lookup, member_shares
from placemetrics.plans.survey import harmonise, store_respondents
from placemetrics.queries import surveys
from placemetrics.sources.mappings import purchasing_power
from placemetrics.sources.store import attach_table, store_table, with_key

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def people(spark):
    return store_respondents(surveys.yearly_tables(spark, FOLDER), surveys.mappings(spark, FOLDER), buckets=4)


def test_one_year_is_read_from_its_folder(people):
    text = plan(people.filter("year = 2017").select("country"))
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]* = 2017", text)


def test_stored_tables_meet_without_a_shuffle(spark, people):
    visits = store_table(spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_quantity"), "l_orderkey", 4, None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = people.filter("year = 2017").join(visits, F.col("respondent_key") == F.col("l_orderkey"))
        assert "Exchange" not in plan(met) and "SortMergeJoin" in plan(met)
        per_person = people.groupBy("respondent_key").agg(F.count(F.lit(1)).alias("n"))
        assert "Exchange" not in plan(per_person) and per_person.filter("n > 1").isEmpty()
        other = met.join(people.select(F.col("respondent_key").alias("again"), "gender"), F.col("l_orderkey") == F.col("again"))
        assert "Exchange" not in plan(other) and other.count() == met.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_respondents_without_an_id_are_spread(spark, people):
    """Three surveys of four had no ids; their rows lie in all buckets."""
    missing = people.filter("respondent_id IS NULL")
    assert missing.count() > 0 and missing.filter("respondent_key >= 0").isEmpty()
    buckets = missing.groupBy(F.pmod(F.hash("respondent_key"), F.lit(4)).alias("b")).count()
    sizes = [r["count"] for r in buckets.collect()]
    assert len(sizes) == 4 and max(sizes) < missing.count() / 2
    keyed = with_key(spark.createDataFrame([(None,), (None,), (3.0,)], "id double"), "id", "k")
    assert sorted(r["k"] >= 0 for r in keyed.collect()) == [False, False, True]


def test_a_stored_table_can_be_attached_again(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("year"))
    where = str(tmp_path / "table")
    first = store_table(df, "k", 3, path=where)
    again = attach_table(spark, where, "k BIGINT, year INT", "k", 3)
    assert rows(again.select("k", "year")) == rows(df) == rows(first.select("k", "year"))
    assert "Exchange" not in plan(again.groupBy("k").agg(F.max("year")))
    assert len(list((tmp_path / "table" / "year=1").glob("*.parquet"))) == 3  # one file per bucket


def test_harmonise_reports_its_lookups(spark):
    tables, mappings = surveys.yearly_tables(spark, FOLDER), surveys.mappings(spark, FOLDER)
    report = LookupReport()
    with_report = harmonise(tables, mappings, report)
    n = with_report.count()
    counts = report.counts()
    assert set(counts) == {"country_corrections", "industries", "employment_statuses", "currencies", "rates",
                           "country_metadata", "purchasing_power"}
    assert all(c["added"] == 0 for c in counts.values())
    plain = harmonise(tables, mappings)
    countries = {r["country"] for r in mappings.country_metadata.collect()}
    assert counts["country_metadata"]["unmatched"] == plain.filter(
        F.col("country").isNotNull() & ~F.col("country").isin(countries)).count() > 0
    assert counts["purchasing_power"]["unmatched"] == 0 and plain.count() == n
    report.check(["purchasing_power"])
    with pytest.raises(ValueError, match="country_metadata: .* rows without a match"):
        report.check(["country_metadata"])


def test_repeated_keys_fail_the_run_that_stores(spark):
    tables, good = surveys.yearly_tables(spark, FOLDER), surveys.mappings(spark, FOLDER)
    twice = good.industries.union(good.industries)
    wrong = type(good)(**{**good.__dict__, "industries": twice})
    with pytest.raises(ValueError, match="industries: repeated keys added"):
        store_respondents(tables, wrong, buckets=2)


def test_reported_lookup_is_the_lookup(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("z", 4)], "k string, v int")
    table = spark.createDataFrame([("a", "A"), ("b", None), (None, "none")], "key string, name string")
    report = LookupReport()
    mine = report.lookup("names", report.start(df), table, {"k": "key"}, {"name": "label"})
    assert rows(mine) == rows(lookup(df, table, {"k": "key"}, {"name": "label"}))
    assert report.counts() == {"names": {"unmatched": 1, "added": 0}}


def test_one_rate_per_country(spark):
    rates = spark.createDataFrame([("Beta", 2.0), ("alpha", 1.0), ("Canada ", 3.0), ("Ünder", 4.0), ("under 2", 5.0)], "n string, r double")
    corrections = spark.createDataFrame([("beta", "canada"), ("alpha", "canada"), ("unter", "x"), ("under 2", "both"), ("under", "both")],
                                        "original_country_label string, corrected_country_label string")
    assert rows(purchasing_power(rates, corrections)) == [("both", 4.0), ("canada", 3.0)]


@pytest.fixture(scope="module")
def answers(spark):
    draw = random.Random(3)
    ids = [draw.choice([0, 1, -1, 32768, 32769, 65536, 10**9, draw.randrange(-70_000, 70_000)]) for _ in range(4000)] + [None] * 50
    data = [(i, draw.choice(["x", "y", None]), draw.randrange(3),
             draw.choice([None, [], ["a"], ["a", "b"], ["b", None, "c"], ["a", "a"]])) for i in ids]
    return data, spark.createDataFrame(data, "id bigint, g string, h int, l array<string>").repartition(6)


def test_distinct_counts_of_all_groupings(spark, answers):
    _, df = answers
    groupings = [[], ["g"], ["h"], ["g", "h"]]
    for by, mine in zip(groupings, distinct_counts(df, "id", groupings), strict=True):
        assert rows(mine) == rows(df.groupBy(*by).agg(F.count_distinct("id").alias("entities")).filter("entities > 0"))
        assert "bitmap" in plan(mine) and "4-" not in re.findall(r"FileScan parquet \[([^\]]*)", plan(mine))
    empty = distinct_counts(df.filter("false"), "id", [[], ["g"]])
    assert rows(empty[0]) == [(0,)] and rows(empty[1]) == []


def test_member_shares_of_all_groupings(answers):
    data, df = answers
    for by, mine in zip([[], ["g"], ["h"]], member_shares(df, "id", "l", [[], ["g"], ["h"]], "m"), strict=True):
        place = {"g": 1, "h": 2}.get(by[0]) if by else None
        named, answered = {}, {}
        for row in data:
            if row[0] is None or row[3] is None:
                continue
            group = row[place] if by else None
            answered.setdefault(group, set()).add(row[0])
            for m in row[3]:
                named.setdefault((m, group), set()).add(row[0])
        found = {(r["m"], r[by[0]] if by else None): (r["respondents"], r["total_respondents"], r["respondents_share"]) for r in mine.collect()}
        assert found == {k: (len(v), len(answered[k[1]]), len(v) / len(answered[k[1]])) for k, v in named.items()}
