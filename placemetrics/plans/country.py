"""Respondents by country, region and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import (count_present, divide, growth, is_in, money_mean,
                                              ratio_of_counts)
from placemetrics.functions.text import title_case
from placemetrics.operators.distribution import summarise
from placemetrics.operators.joins import lookup, recode_by_lookup
from placemetrics.operators.measures import (add_share, index_to_base, relative_to,
                                             share_of_group)
from placemetrics.operators.ranking import arrange, suppress_small, top_n
from placemetrics.operators.reshape import with_literal_order
from placemetrics.plans.common import (HOME_COUNTRY, LATEST_YEAR, PRO_DEV, present, row_count,
                                       total)

COUNTRY_KEYS = ["year", "country", "region", "region_carow_label"]

# Order of the country groups in results.
REGION_ORDER = ["ROW", "EU", "US", "Canada"]


def country_years(respondents: DataFrame, population: DataFrame,
                  country_names: DataFrame | None = None) -> DataFrame:
    """Respondents, their share of the year and respondents per inhabitant."""
    shares = share_of_group(respondents.filter(present("country")), COUNTRY_KEYS, ["year"])
    population = population.withColumn("country", F.lower("country"))
    if country_names is not None:
        population = recode_by_lookup(population, country_names, "country", "country_in_population",
                                      "country_in_survey")
    joined = lookup(shares, population, "country", ["population_2016"])
    return joined.withColumn("respondents_per_capita", divide("respondents", "population_2016"))


MEDIANS = ["median_salary_cad", "median_salary_usd", "median_salary_intl_dollar",
           "median_pro_experience_years", "median_salary_cad_males", "median_salary_cad_females"]


def country_years_prodevs(respondents: DataFrame, wanted: Sequence[str] = MEDIANS) -> DataFrame:
    """Salary and experience of professional developers per country and year.

    All counts, means and medians, also those split by gender, come from one
    summary instead of a join per pivoted statistic.  Callers name the medians they
    use, because medians take a second pass.
    """
    rows = respondents.filter(present("country") & (F.col("pro_status") == PRO_DEV))
    male, female = (F.when(F.col("gender") == g, F.col("salary_cad")) for g in ("male", "female"))
    medians = {
        "median_salary_cad": "salary_cad",
        "median_salary_usd": "salary_usd",
        "median_salary_intl_dollar": "salary_intl_dollar",
        "median_pro_experience_years": "pro_experience_mid_year",
        "median_salary_cad_males": male,
        "median_salary_cad_females": female,
    }
    summary = summarise(rows, COUNTRY_KEYS, [
        F.count(F.lit(1)).alias("respondents"),
        money_mean("salary_cad").alias("mean_salary_cad"),
        money_mean("salary_usd").alias("mean_salary_usd"),
        count_present("salary_cad").alias("n_salary_responses"),
        count_present("salary_intl_dollar").alias("n_salary_intl_dollar_responses"),
        F.avg("pro_experience_mid_year").alias("mean_pro_experience_years"),
        ratio_of_counts(F.col("pro_experience_bin_above_15"),
                        present("pro_experience_bin"))
        .alias("respondents_share_pro_experience_bin_above_15"),
        count_present(male).alias("n_salary_responses_males"),
        count_present(female).alias("n_salary_responses_females"),
    ], {name: medians[name] for name in wanted})
    shares = add_share(summary, "respondents", "respondents_share", ["year"])
    if {"median_salary_cad_males", "median_salary_cad_females"} - set(wanted):
        return shares
    return shares.withColumn("salary_pc_diff_females_males", growth(
        "median_salary_cad_females", "median_salary_cad_males"))


def region_years(respondents: DataFrame) -> DataFrame:
    """Country shares added up per region, in one further aggregate."""
    counts = (respondents.filter(present("country")).groupBy("year", "region")
              .agg(F.count(F.lit(1)).alias("respondents")))
    return add_share(counts, "respondents", "respondents_share", ["year"])


def top_countries(countries: DataFrame, n: int = 10, year: int = LATEST_YEAR) -> DataFrame:
    rows = top_n(countries.filter(F.col("year") == year), n, "respondents_share", members="few")
    return arrange(rows.select("country", title_case("country").alias("country_label"),
                               "region_carow_label", "respondents", "respondents_share"),
                   "respondents_share")


def sample_size(countries: DataFrame, year: int = LATEST_YEAR) -> DataFrame:
    return total(countries.filter(F.col("year") == year), "respondents", "respondents")


def per_capita_relative(countries: DataFrame, minimum: int = 50, n: int = 10,
                        reference: str = HOME_COUNTRY, year: int = LATEST_YEAR) -> DataFrame:
    """Respondents per inhabitant relative to one country, among the n highest.

    The reference is looked up among the selected rows, so it must be one of them.
    """
    rows = top_n(suppress_small(countries.filter(F.col("year") == year), minimum, "respondents"),
                 n, "respondents_per_capita", members="few")
    rows = relative_to(rows, "respondents_per_capita", F.col("country") == reference,
                       "respondents_per_capita_ind")
    return arrange(rows.select("country", "region_carow_label", "respondents_per_capita",
                               "respondents_per_capita_ind"), "respondents_per_capita")


def n_countries(countries: DataFrame, minimum: int = 50, year: int = LATEST_YEAR) -> DataFrame:
    return row_count(suppress_small(countries.filter(F.col("year") == year), minimum,
                                    "respondents"), "countries")


def region_index(regions: DataFrame) -> DataFrame:
    """Share of each region with its own first year at 100."""
    indexed = index_to_base(regions, "respondents_share", ["region"], "year",
                            "respondents_share_ind")
    return indexed.withColumn("region_ord", with_literal_order("region", REGION_ORDER))


def growth_of_leading_countries(countries: DataFrame, first: int = 2015, last: int = LATEST_YEAR,
                                n: int = 15) -> DataFrame:
    """Change of share between two years among the countries with the largest mean share."""
    share = F.when(is_in("year", [first, last]), F.col("respondents_share"))
    end = F.when(is_in("year", [first, last]), F.col("year"))
    per_country = countries.groupBy("country").agg(
        F.avg(F.when(F.col("year") >= first, F.col("respondents_share"))).alias("mean_share"),
        growth(F.max_by(share, end), F.min_by(share, end)).alias("respondents_share_pc_change"),
        F.count(end).alias("ends"))
    leading = top_n(per_country, n, "mean_share", members="few").filter(F.col("ends") > 0)
    return arrange(leading.select("country", "respondents_share_pc_change"),
                   "-respondents_share_pc_change")
