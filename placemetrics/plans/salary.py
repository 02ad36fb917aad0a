"""Salaries by country, in market and purchasing-power terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import not_in, ratio_of_counts
from placemetrics.functions.text import money_label, rank_label, title_case
from placemetrics.operators.measures import relative_to
from placemetrics.operators.ranking import add_rank, arrange, suppress_small, top_n
from placemetrics.operators.reshape import to_long
from placemetrics.plans.common import HOME_COUNTRY, LATEST_YEAR, present, row_count
from placemetrics.plans.survey import HOME

MIN_SALARIES = 20
MARKET = "Market Exchange Rates"
PPP = "PPP Exchange Rates"


def _year(countries: DataFrame, year: int) -> DataFrame:
    return countries.filter(F.col("year") == year)


def _enough(countries: DataFrame, year: int, minimum: int, ppp: bool = False) -> DataFrame:
    counts = ["n_salary_responses"] + (["n_salary_intl_dollar_responses"] if ppp else [])
    return suppress_small(_year(countries, year), minimum, *counts)


def top_salary_countries(countries: DataFrame, minimum: int = MIN_SALARIES, n: int = 20,
                         year: int = LATEST_YEAR) -> DataFrame:
    top = top_n(_enough(countries, year, minimum), n, "median_salary_cad", members="few")
    return arrange(top.select("country", title_case("country").alias("country_label"),
                              "median_salary_cad", money_label("median_salary_cad").alias("text")),
                   "median_salary_cad")


def n_salary_countries(countries: DataFrame, minimum: int = MIN_SALARIES, ppp: bool = False,
                       year: int = LATEST_YEAR) -> DataFrame:
    return row_count(_enough(countries, year, minimum, ppp), "countries")


def salary_rank(countries: DataFrame, country: str = HOME_COUNTRY, minimum: int = MIN_SALARIES,
                year: int = LATEST_YEAR) -> DataFrame:
    ranked = add_rank(_enough(countries, year, minimum), "median_salary_cad", "rank", ties="min")
    return ranked.filter(F.col("country") == country).select(
        "country", "rank", "median_salary_cad", "n_salary_responses")


def one_country_salary(countries: DataFrame, country: str = "united states",
                       year: int = LATEST_YEAR) -> DataFrame:
    return _year(countries, year).filter(F.col("country") == country).select(
        "country", "mean_salary_cad", "median_salary_cad", "n_salary_responses")


def market_and_ppp(countries: DataFrame, minimum: int = MIN_SALARIES, n: int = 20,
                   home: str = HOME_COUNTRY, year: int = LATEST_YEAR) -> DataFrame:
    """Salaries relative to home on both bases, ranked and cut to the top on each."""
    is_home = F.col("country") == home
    rows = _year(countries, year)
    rows = relative_to(rows, "median_salary_cad", is_home, MARKET)
    rows = relative_to(rows, "median_salary_intl_dollar", is_home, PPP)
    relative = _enough(rows, year, minimum, ppp=True).select("country", "region_carow_label",
                                                             MARKET, PPP)
    long = to_long(relative, "currency", "median_salary_ind", [MARKET, PPP],
                   ids=["country", "region_carow_label"])
    ranked = add_rank(long, "median_salary_ind", "median_salary_rank", ["currency"])
    top = top_n(ranked, n, "median_salary_ind", ["currency"], members="few")
    rank = F.regexp_replace(F.col("median_salary_rank").cast("string"), r"\.0$", "")
    return arrange(top.withColumn("country_label", rank_label(rank, title_case("country"))),
                   "median_salary_ind")


def ppp_rank(countries: DataFrame, country: str = HOME_COUNTRY, minimum: int = MIN_SALARIES,
             year: int = LATEST_YEAR) -> DataFrame:
    ranked = add_rank(_enough(countries, year, minimum, ppp=True), "median_salary_intl_dollar",
                      "median_salary_intl_dollar_rank")
    return ranked.filter(F.col("country") == country).select("median_salary_intl_dollar_rank")


def currency_mismatch(respondents: DataFrame, year: int = LATEST_YEAR) -> DataFrame:
    """Share of salaries not given in the currency of the respondent's country."""
    rows = _year(respondents, year).filter(present("salary_usd", "country"))
    own, paid = F.col("country_currency_code"), F.col("local_currency_code")
    mismatch = F.coalesce(own != paid, F.lit(True))
    return rows.agg(ratio_of_counts(mismatch, F.lit(True)).alias("mismatch_ratio"))


def salary_by(table: DataFrame, label: str, minimum: int = MIN_SALARIES,
              key: str | None = None, left_out: Sequence[str] = ()) -> DataFrame:
    """Home rows of an industry or company table with enough salaries, by median."""
    rows = suppress_small(table.filter(F.col("region_carow_label") == HOME), minimum,
                          "n_salary_responses")
    if key is not None:
        rows = rows.filter(not_in(key, left_out))
    return arrange(rows.select(label, "median_salary_cad", "n_salary_responses",
                               money_label("median_salary_cad").alias("text")),
                   "median_salary_cad")
