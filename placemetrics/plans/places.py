"""Provinces and cities: traffic against employment, scaling, ranks and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import divide, growth, matches, strict_sum
from placemetrics.functions.text import (CITY_RULES, rank_label, replace_all, slug, times_label,
                                         title_case, to_ascii)
from placemetrics.operators.joins import join_null_safe, lookup, scalar
from placemetrics.operators.measures import concentration, scaled_share
from placemetrics.operators.ranking import add_position, add_rank, arrange, top_n
from placemetrics.operators.reshape import (keep_first, select_between, stack_tables, to_long,
                                            to_wide, with_literal_order)
from placemetrics.plans.common import LATEST_YEAR, present

ALL_ROLES = "all developers"

# Order of the consolidated provinces in results, lowest first.
PROVINCE_ORDER = ["territories", "british columbia", "alberta", "saskatchewan", "manitoba",
                  "ontario", "quebec", "atlantic canada"]

# Column ranges of the national traffic sheet.
PROVINCE_RANGE = ("alberta", "yukon")
CITY_RANGE = ("calgary", "waterloo_kitchener_cambridge", "victoria_bc")

# Fixed value: halves of a city that straddles two provinces.
CITY_PARTS = "(ontario|quebec) part"


def all_roles_row(sheet: DataFrame) -> DataFrame:
    return sheet.filter(F.col("dev_role") == ALL_ROLES)


def province_employment(provinces: DataFrame, territories: DataFrame,
                        unit: float = 100) -> DataFrame:
    """Mean of the monthly figures per province, from two statistical tables."""
    both = stack_tables(provinces, territories.withColumnRenamed("GEO", "GEOGRAPHY"))
    return (both.groupBy(slug("GEOGRAPHY").alias("province"))
            .agg((F.avg("Value") * unit).alias("employees")))


def province_shares(sheet: DataFrame, employment: DataFrame,
                    consolidations: DataFrame) -> DataFrame:
    """Consolidated provinces: share of traffic over share of employment."""
    traffic = to_long(select_between(all_roles_row(sheet), *PROVINCE_RANGE), "province", "visitors")
    joined = lookup(traffic, employment, "province", ["employees"])
    joined = lookup(joined, consolidations, {"province": "province_original"})
    totals = joined.groupBy("province_consolidated").agg(
        strict_sum("visitors").alias("visitors"), strict_sum("employees").alias("employees"))
    return concentration(totals, "visitors", "employees", "visitor_employee_ratio",
                         "visitors_share", "employees_share")


def provinces_in_order(shares: DataFrame) -> DataFrame:
    labelled = shares.withColumns({
        "province_ord": with_literal_order("province_consolidated", PROVINCE_ORDER),
        "province_label": title_case("province_consolidated")})
    return arrange(labelled, "province_ord")


def national_visitors(sheet: DataFrame, nation: str = "canada") -> Column:
    return scalar(all_roles_row(sheet), F.max(nation))


def canonical_city(column: Column | str) -> Column:
    return replace_all(to_ascii(column), CITY_RULES)


def city_statistics(employment: DataFrame, population: DataFrame,
                    unit: float = 1000) -> DataFrame:
    """Employment and population per city under one spelling; the halves left out."""
    long = stack_tables(
        employment.select(F.col("GEO").alias("city"), F.col("Value").alias("value"),
                          F.lit("employees").alias("variable")),
        population.select(F.col("GEO").alias("city"), F.col("Value").alias("value"),
                          F.lit("population").alias("variable")))
    wide = to_wide(long, ["city"], "variable", "value", ["employees", "population"])
    named = wide.filter(~matches("city", CITY_PARTS, ignore_case=True)).withColumns(
        {"city": canonical_city("city"), "employees": F.col("employees") * unit})
    return named.groupBy("city").agg(F.sum("employees").alias("employees"),
                                     F.sum("population").alias("population"))


def city_traffic(sheet: DataFrame, city_names: DataFrame) -> DataFrame:
    """Traffic per role and consolidated city, in long form."""
    long = to_long(select_between(sheet, *CITY_RANGE, ids=["dev_role"]), "city", "visitors",
                   ids=["dev_role"])
    joined = join_null_safe(long, city_names, {"city": "city_in_traffic"}, "inner")
    return joined.groupBy("dev_role", "city_consolidated").agg(
        strict_sum("visitors").alias("visitors"))


def city_table(sheet: DataFrame, statistics: DataFrame, city_names: DataFrame,
               statistics_names: DataFrame, provinces: DataFrame) -> DataFrame:
    """Cities with traffic scaled to the nation and their concentration ratio."""
    traffic = all_roles_row(city_traffic(sheet, city_names)).drop("dev_role")
    names = statistics_names.withColumn("city_in_statistics", canonical_city("city_in_statistics"))
    named = join_null_safe(statistics, names, {"city": "city_in_statistics"}, "full")
    employed = named.groupBy("city_consolidated").agg(
        strict_sum("employees").alias("employees"), strict_sum("population").alias("population"))
    cities = join_null_safe(traffic, employed, ["city_consolidated"], "inner")
    cities = scaled_share(cities.filter(present("city_consolidated")), "visitors",
                          national_visitors(sheet), scalar(provinces, F.sum("visitors")),
                          "visitors_scaled", "visitors_share_scaled")
    nation = scalar(statistics.filter(F.col("city") == "Canada"), F.max("employees"))
    return (cities.withColumn("employees_share", divide("employees", nation))
            .withColumn("visitor_employee_ratio",
                        divide("visitors_share_scaled", "employees_share")))


def city_export(cities: DataFrame) -> DataFrame:
    return cities.select(F.col("city_consolidated").alias("city"), "visitors", "visitors_scaled",
                         "visitors_share_scaled", "employees", "employees_share",
                         "visitor_employee_ratio")


def cities_sorted(cities: DataFrame, by: str) -> DataFrame:
    label = title_case(F.regexp_replace("city_consolidated", "_", "-"))
    return arrange(cities.select("city_consolidated", label.alias("city_label"), by), by)


def most_populous_share(cities: DataFrame, n: int = 3) -> DataFrame:
    """Combined shares of the n most populous cities."""
    top = top_n(cities, n, "population", members="few")
    return top.agg(F.sum("visitors_share_scaled").alias("visitors_share_scaled"),
                   F.sum("employees_share").alias("employees_share"))


def city_years(sheet: DataFrame, prefix: str = "Developers") -> DataFrame:
    """International traffic: one column per year to one row per city and year."""
    years = {c: c.removeprefix(prefix) for c in sheet.columns if c.startswith(prefix)}
    named = sheet.select(F.lower("CityName").alias("city"), F.lower("CountryName").alias("country"),
                         *[F.col(c).alias(y) for c, y in years.items()])
    long = to_long(named, "year", "visitors", ids=["city", "country"])
    return long.withColumn("year", F.col("year").cast("int"))


# Cities shown under another name, as (city, country, label).
CITY_LABELS = [
    ("london", "united kingdom", "London, UK"),
    ("london", "canada", "London, ON"),
    ("central district", None, "Hong Kong"),
    ("waterloo", None, "Kitchener-Waterloo"),
]


# The growth figure renames two cities only.
GROWTH_CITY_LABELS = [
    ("london", "united kingdom", "London, UK"),
    ("central district", None, "Hong Kong"),
]


def city_label(city: Column, country: Column) -> Column:
    """Label in the comparison of cities."""
    label = F.when(matches(city, "qu.*bec"), "Quebec City").otherwise(title_case(city))
    return _renamed(label, city, country, CITY_LABELS)


def growth_city_label(city: Column, country: Column) -> Column:
    return _renamed(title_case(city), city, country, GROWTH_CITY_LABELS)


def _renamed(label: Column, city: Column, country: Column, labels: list[tuple]) -> Column:
    for name, nation, text in reversed(labels):
        test = city == name if nation is None else (city == name) & (country == nation)
        label = F.when(test, text).otherwise(label)
    return label


def global_city_comparison(cities: DataFrame, reference: tuple[str, str] = ("toronto", "canada"),
                           home: str = "canada", n: int = 20, year: int = LATEST_YEAR) -> DataFrame:
    """The n largest cities and all of one country, relative to a reference city.

    A city in both sets stays in the first one; the largest n are numbered.
    """
    rows = cities.filter(F.col("year") == year)
    largest = top_n(rows, n, "visitors").withColumns(
        {"city_group": F.lit(f"Top {n} Cities Globally"), "source": F.lit(1)})
    national = rows.filter(F.col("country") == home).withColumns(
        {"city_group": F.lit("Other Canadian Cities"), "source": F.lit(2)})
    both = keep_first(stack_tables(largest, national), ["city", "country"], ["source"])
    is_reference = (F.col("city") == reference[0]) & (F.col("country") == reference[1])
    base = scalar(rows.filter(is_reference), F.max("visitors"))
    # Every one of the first n positions is among the largest; only those are numbered.
    numbered = (add_position(largest, "visitors", "position", ["city", "country"])
                .filter(F.col("position") <= n).select("city", "country", "position"))
    placed = join_null_safe(both, numbered, ["city", "country"], "left")
    label = city_label(F.col("city"), F.col("country"))
    label = F.when(F.col("position").isNotNull(), rank_label("position", label)).otherwise(label)
    placed = placed.withColumns({"city_label": label, "visitors_ind": divide("visitors", base)})
    return arrange(placed.select("city", "country", "city_group", "city_label", "visitors",
                                 "visitors_ind", times_label("visitors_ind").alias("text")),
                   "visitors")


def city_ranks(cities: DataFrame, home: str = "canada", year: int = LATEST_YEAR) -> DataFrame:
    """Rank among all cities of the year, shown for one country."""
    ranked = add_rank(cities.filter(F.col("year") == year), "visitors", "rank", ties="min",
                      members="many")
    return ranked.filter(F.col("country") == home)


def city_growth(cities: DataFrame, minimum: float = 1e5, first: int = 2016,
                last: int = LATEST_YEAR) -> DataFrame:
    """Growth between two years of the cities that were large enough in the first."""
    years = cities.filter(F.col("year").isin(first, last))
    wide = to_wide(years, ["city", "country"], "year", "visitors",
                   {first: "visitors_first", last: "visitors_last"})
    grown = wide.filter(F.col("visitors_first") >= minimum).withColumns({
        "pc_growth": growth("visitors_last", "visitors_first"),
        "city_label": growth_city_label(F.col("city"), F.col("country"))})
    return arrange(grown, "pc_growth")


def scale_factor(sheet: DataFrame, provinces: DataFrame) -> DataFrame:
    """National visitors over the sum of the provinces."""
    return provinces.agg(divide(F.max(national_visitors(sheet)), F.sum("visitors"))
                         .alias("scale_factor"))
