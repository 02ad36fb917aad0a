"""Programming languages: shares by region, counts per person, change over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.semantics import divide
from placemetrics.functions.text import times_label
from placemetrics.operators.joins import lookup
from placemetrics.operators.measures import (count_histogram, growth_on_previous, index_to_base,
                                             member_share, members_per_entity)
from placemetrics.operators.ranking import add_rank, arrange, keep_maximum, top_n
from placemetrics.operators.reshape import explode_members, to_long, to_wide
from placemetrics.plans.common import (HOME_COUNTRY, LATEST_YEAR, PRO_DEV, latest,
                                       pro_devs_at_home, row_count)
from placemetrics.plans.survey import HOME, REST_OF_WORLD

# Thresholds of the report.
MIN_RESPONDENTS = 50
MIN_MEAN_SHARE = 0.1
MOST_LANGUAGES_SHOWN = 10.5


def language_regions(respondents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Share of each region's respondents naming a language."""
    rows = latest(respondents, "region_carow_label", pro_status=PRO_DEV)
    shares = member_share(rows, "languages", by=["region_carow_label"], into="language")
    return lookup(shares, metadata, "language")


def top_languages(regions: DataFrame, n: int = 10) -> DataFrame:
    """The n languages ranked highest at home, with their rank elsewhere."""
    wide = to_wide(regions, ["language_label"], "region_carow_label", "respondents_share",
                   [HOME, REST_OF_WORLD])
    ranked = add_rank(wide, HOME, "canada_rank", missing_last=True)
    ranked = add_rank(ranked, REST_OF_WORLD, "row_rank", missing_last=True)
    return arrange(top_n(ranked, n, "canada_rank", smallest=True, members="few"), "-canada_rank")


def top_language_shares(regions: DataFrame, n: int = 10) -> DataFrame:
    """Both regions' shares of the n languages ranked highest at home."""
    top = to_long(top_languages(regions, n), "region_carow_label", "respondents_share",
                  [HOME, REST_OF_WORLD], ids=["language_label", "canada_rank"])
    return arrange(top.filter(F.col("respondents_share").isNotNull()), "respondents_share")


def n_language_respondents(regions: DataFrame, region: str = HOME) -> DataFrame:
    return regions.filter(F.col("region_carow_label") == region).select(
        "total_respondents").distinct()


def one_language(regions: DataFrame, language: str, region: str = HOME) -> DataFrame:
    return regions.filter((F.col("region_carow_label") == region)
                          & (F.col("language") == language)).select("respondents_share")


def languages_per_person(respondents: DataFrame) -> DataFrame:
    """Number of languages of each professional developer at home."""
    rows = pro_devs_at_home(respondents, "languages").filter(F.size("languages") > 0)
    return rows.groupBy("respondent_id").agg(F.sum(F.size("languages")).alias("n_languages"))


def language_count_histogram(respondents: DataFrame) -> DataFrame:
    return count_histogram(languages_per_person(respondents), "n_languages").select(
        "n_languages", F.col("respondents_share").alias("n_languages_share"))


def n_language_answers(respondents: DataFrame) -> DataFrame:
    return row_count(pro_devs_at_home(respondents, "languages"))


def n_over_limit(respondents: DataFrame, limit: float = MOST_LANGUAGES_SHOWN) -> DataFrame:
    return row_count(languages_per_person(respondents).filter(F.col("n_languages") > limit))


def at_least_languages(respondents: DataFrame, least: int = 2) -> DataFrame:
    histogram = count_histogram(languages_per_person(respondents), "n_languages")
    return histogram.filter(F.col("n_languages") >= least).agg(
        F.sum("respondents_share").alias("respondents_share"))


def language_years(respondents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Yearly share of each language at home, its index and its yearly growth."""
    rows = respondents.filter((F.col("country") == HOME_COUNTRY) & F.col("languages").isNotNull())
    rows = rows.withColumn("languages", F.transform("languages", F.trim))
    shares = member_share(rows, "languages", by=["year"], into="language")
    shares = index_to_base(shares, "respondents_share", ["language"], "year",
                           "respondents_share_ind")
    shares = growth_on_previous(shares, "respondents_share", ["language"], "year",
                                "respondents_share_pc_growth_yoy")
    return lookup(shares, metadata, "language")


def language_averages(years: DataFrame) -> DataFrame:
    return years.groupBy("language", "language_label").agg(
        F.avg("respondents_share").alias("avg_respondents_share"),
        F.count(F.lit(1)).alias("survey_years"))


def widely_used(years: DataFrame, minimum: float = MIN_MEAN_SHARE) -> DataFrame:
    """Languages in every survey year with a large enough mean share."""
    complete = keep_maximum(language_averages(years), "survey_years")
    return arrange(complete.filter(F.col("avg_respondents_share") >= minimum),
                   "-avg_respondents_share")


def widely_used_years(years: DataFrame, minimum: float = MIN_MEAN_SHARE) -> DataFrame:
    """The yearly rows of the widely used languages."""
    language = Window.partitionBy("language")
    rows = years.withColumns({"__mean": F.avg("respondents_share").over(language),
                              "__years": F.count(F.lit(1)).over(language)})
    return keep_maximum(rows, "__years").filter(F.col("__mean") >= minimum).drop(
        "__mean", "__years")


def latest_growth(years: DataFrame, minimum: float = MIN_MEAN_SHARE,
                  year: int = LATEST_YEAR) -> DataFrame:
    rows = widely_used_years(years, minimum).filter(F.col("year") == year)
    return arrange(rows.select("language", "respondents_share", "respondents_share_pc_growth_yoy"),
                   "-respondents_share_pc_growth_yoy")


def home_to_world_ratio(regions: DataFrame, minimum: int = MIN_RESPONDENTS) -> DataFrame:
    """Share at home over share elsewhere, for languages with enough respondents."""
    is_home = F.col("region_carow_label") == HOME
    wide = regions.groupBy("language", "language_label").agg(
        F.max(F.when(is_home, F.col("respondents"))).alias("__respondents"),
        F.max(F.when(is_home, F.col("respondents_share"))).alias(HOME),
        F.max(F.when(~is_home, F.col("respondents_share"))).alias(REST_OF_WORLD))
    ratio = divide(HOME, REST_OF_WORLD)
    enough = wide.filter(F.col("__respondents") >= minimum).drop("__respondents")
    return arrange(enough.withColumns({"carow_ratio": ratio, "text": times_label(ratio)}),
                   "carow_ratio")
