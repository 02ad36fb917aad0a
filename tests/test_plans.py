"""Golden figures of published tables, and the shape of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from placemetrics.operators.measures import PARENT_ROLES_AS_PUBLISHED
from placemetrics.plans import places, roles
from placemetrics.queries import tables as t
from placemetrics.queries.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def sheet(spark):
    """Two provinces and the nation, re-typed from a published table."""
    columns = "dev_role string, alberta int, yukon int, canada int"
    return spark.createDataFrame([
        ("all developers", 49022, 200, 609940), ("mobile developers", 2164, 4, 31062),
        ("back-end web", 6531, 30, 83650), ("qa engineers", 10, 1, 100)], columns)


def test_province_export(spark, sheet):
    labels = spark.createDataFrame(
        [("all developers", "Developer"), ("back-end web", "Back-End Web Developer"),
         ("mobile developers", "Mobile Developer")], "dev_role string, dev_role_label string")
    rows = {(r["province"], r["dev_role"]): r for r in roles.role_province_export(
        sheet, labels, PARENT_ROLES_AS_PUBLISHED).collect()}
    assert len(rows) == 6  # the unusable role is left out
    mobile = rows["alberta", "Mobile Developers"]
    assert mobile["dev_role_parent_group"] == "All Developers"
    assert abs(mobile["province_visitors_share"] - 0.044143445799844964) < 1e-15
    assert rows["alberta", "All Developers"]["location_quotient"] == 1.0
    web = rows["alberta", "Back-End Web Developers"]
    assert web["dev_role_parent_group"] == "Other Kinds of Developers"
    now = roles.role_province_export(sheet, labels).filter(
        "dev_role = 'Back-End Web Developers'").first()
    assert now["dev_role_parent_group"] == "Web Developers"


def test_province_employment(spark):
    provinces = spark.createDataFrame([("Canada", 18273.3), ("Canada", 18288.6),
                                       ("Nova Scotia", 452.7), ("Nova Scotia", 445.9)],
                                      "GEOGRAPHY string, Value double")
    territories = spark.createDataFrame([("Yukon", 20.7), ("Yukon", 20.9)],
                                        "GEO string, Value double")
    found = {r["province"]: r["employees"]
             for r in places.province_employment(provinces, territories).collect()}
    assert abs(found["nova_scotia"] - 44930) < 1e-6 and abs(found["yukon"] - 2080) < 1e-6


def test_world_city_key_includes_the_country(spark):
    cities = spark.createDataFrame(
        [("london", "united kingdom", 2017, 300.0), ("london", "canada", 2017, 10.0),
         ("toronto", "canada", 2017, 150.0)], "city string, country string, year int, visitors double")
    found = {(r["city"], r["country"]): (r["city_group"], r["city_label"], r["visitors_ind"])
             for r in places.global_city_comparison(cities, n=1).collect()}
    assert found["london", "united kingdom"] == ("Top 1 Cities Globally", "1. London, UK", 2.0)
    assert found["london", "canada"][:2] == ("Other Canadian Cities", "London, ON")


@pytest.mark.parametrize("name", ["top_countries_with_ties", "country_prodev_summary",
                                  "role_city_quotients", "language_years", "ethnicities",
                                  "rank_with_many_members", "medians_per_group",
                                  "harmonised_respondents", "share_with_many_members"])
def test_no_python_workers_and_no_pair_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for operator in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "InPandas",
                     "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text, operator


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["industry_sample_size"](spark, FOLDER))
    scan = re.search(r"Scan parquet.*?orders\.parquet.*?ReadSchema: (\S+)", text, re.S)
    assert "o_orderdate" in scan.group(1) and "o_totalprice" not in scan.group(1)
    exact = plan(t.read(spark, FOLDER, "lineitem").filter("l_quantity > 40").groupBy().count())
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in exact


def test_top_n_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["top_n_per_group_with_ties"](spark, FOLDER))
    assert text.count("WindowGroupLimit") >= 2


def test_raw_rows_are_read_at_most_twice_for_medians(spark):
    df = QUERIES["medians_per_group"](spark, FOLDER)
    scans = re.findall(r"Location: InMemoryFileIndex \[file:\S*lineitem", plan(df))
    assert not scans  # both passes ran when the medians were asked for; one row per group is left


@pytest.mark.parametrize("name, scans", [("harmonised_respondents", 4)])
def test_survey_years_reach_the_scan(spark, name, scans):
    pushed = re.findall(r"PushedFilters: \[[^\]]*", plan(QUERIES[name](spark, FOLDER)))
    assert sum("(o_orderdate," in p for p in pushed) >= scans


def test_one_year_of_respondents_reaches_the_scan(spark):
    pushed = re.findall(r"PushedFilters: \[[^\]]*", plan(t.respondents(spark, FOLDER, 2017)))
    assert any("GreaterThanOrEqual(o_orderdate," in p and "LessThan(o_orderdate," in p for p in pushed)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)
    assert len(QUERIES) > 150


def test_entry(spark):
    import __spark_entry__ as driver
    df = driver.entry(spark)
    assert df.columns == ["country", "country_label", "region_carow_label", "respondents",
                          "respondents_share"]
    assert df.filter(F.col("respondents_share") > 0).count() >= 10
