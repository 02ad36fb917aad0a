"""Company type and size, industry and employment status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.semantics import (count_present, divide, growth, is_in, matches, not_in,
                                              recode_by_pattern)
from placemetrics.functions.text import title_case
from placemetrics.operators.distribution import summarise
from placemetrics.operators.joins import lookup
from placemetrics.operators.measures import (add_share, growth_on_previous, index_to_base,
                                             running_share, share_of_group)
from placemetrics.operators.ranking import add_rank, arrange, suppress_small
from placemetrics.operators.reshape import to_wide, with_literal_order
from placemetrics.plans.common import (HOME_COUNTRY, LATEST_YEAR, PRO_DEV, latest, pro_devs_at_home,
                                       total)
from placemetrics.plans.survey import HOME, REST_OF_WORLD

# Answers about the company that say nothing.
NO_ANSWER = ["i don't know", "i prefer not to answer"]

# Company type labels broken into two lines, by pattern.
COMPANY_TYPE_RULES = [
    ("non-profit", "Non-profit/non-governmental organization\nor private school/university"),
    ("government agency", "Government agency\nor public school/university"),
    ("proprietorship", "Sole proprietorship or partnership,\nnot in startup mode"),
    ("privately-held", "Privately-held limited company,\nnot in startup mode"),
]

# Company sizes in order.
COMPANY_SIZES = ["fewer than 10", "10 to 19", "20 to 99", "100 to 499", "500 to 999",
                 "1,000 to 4,999", "5,000 to 9,999", "10,000 or more"]

# Regions in the order of result columns.
REGIONS = ["Canada", "US", "EU", "ROW"]

# Industry labels, by pattern.
INDUSTRY_RULES = [
    ("advertising", "Media, Advertising,\nPublishing, or Entertainment"),
    ("finance", "Finance, Banking,\nor Insurance"),
    ("military", "Government\n(Including Military)"),
    ("other", "Other"),
]

# Industry subsets reported by name.
SOFTWARE_AND_WEB = ["software", "internet or web services"]
OTHER_LEADING = ["finance, banking, or insurance", "health care services", "consulting",
                 "media, advertising, publishing, or entertainment"]

# Industries whose survey options changed over the years.
INCONSISTENT_INDUSTRIES = ["consulting", "manufacturing", "government", "other"]

# Employment statuses in order, and those left out.
STATUS_ORDER = ["employed full-time", "independent contractor, freelancer, or self-employed",
                "employed part-time", "not employed, but looking for work",
                "not employed, and not looking for work"]
STATUSES_LEFT_OUT = ["retired", "i prefer not to say"]


def _counts(rows: DataFrame, keys: list[str], with_salary: bool) -> DataFrame:
    """Respondents per group; salary figures only on request, as medians read the rows again."""
    counts = [F.count(F.lit(1)).alias("respondents")]
    if not with_salary:
        return summarise(rows, keys, counts, {})
    return summarise(rows, keys, [*counts, count_present("salary_cad").alias("n_salary_responses")],
                     {"median_salary_cad": "salary_cad"})


# --- company --------------------------------------------------------------------

def company_types(respondents: DataFrame, labels: DataFrame,
                  with_salary: bool = True) -> DataFrame:
    known = F.when(F.col("company_type") == "something else: ", "other").otherwise(
        F.col("company_type"))
    rows = respondents.withColumn("company_type", F.when(not_in("company_type", NO_ANSWER), known))
    rows = latest(rows, "region_carow_label", "company_type", pro_status=PRO_DEV)
    counts = _counts(rows, ["region_carow_label", "company_type"], with_salary)
    counts = lookup(counts, labels, "company_type", ["company_type_label"])
    return add_share(counts, "respondents", "respondents_share", ["region_carow_label"]).withColumn(
        "company_type_label", recode_by_pattern("company_type", COMPANY_TYPE_RULES,
                                                F.col("company_type_label")))


def company_types_sorted(types: DataFrame) -> DataFrame:
    return arrange(types.filter(F.col("company_type") != "other").select(
        "company_type_label", "region_carow_label", "respondents_share"), "respondents_share")


def company_types_wide(types: DataFrame) -> DataFrame:
    return to_wide(types, ["company_type"], "region_carow_label", "respondents_share",
                   [HOME, REST_OF_WORLD])


def company_sizes(respondents: DataFrame) -> DataFrame:
    rows = respondents.withColumn("company_size", F.when(not_in("company_size", NO_ANSWER),
                                                         F.col("company_size")))
    rows = latest(rows, "region", "company_size", pro_status=PRO_DEV)
    shares = share_of_group(rows, ["region", "company_size"], ["region"])
    return shares.withColumn("size_ord", with_literal_order("company_size", COMPANY_SIZES))


def company_sizes_running(sizes: DataFrame) -> DataFrame:
    """Running share from the smallest size upwards, one column per region."""
    running = running_share(sizes, "respondents_share", "size_ord", "respondents_share_cumsum",
                            ["region"])
    return to_wide(running, ["company_size", "size_ord"], "region", "respondents_share_cumsum",
                   REGIONS)


def company_sizes_wide(sizes: DataFrame) -> DataFrame:
    return to_wide(sizes, ["company_size", "size_ord"], "region", "respondents_share", REGIONS)


# --- industry -------------------------------------------------------------------

def industries(respondents: DataFrame, with_salary: bool = True) -> DataFrame:
    rows = latest(respondents, "region_carow_label", "industry_original", pro_status=PRO_DEV)
    counts = _counts(rows, ["region_carow_label", "industry_original"], with_salary)
    return add_share(counts, "respondents", "respondents_share", ["region_carow_label"]).withColumn(
        "industry_original_label", recode_by_pattern("industry_original", INDUSTRY_RULES,
                                                     title_case("industry_original")))


def _at_home(table: DataFrame) -> DataFrame:
    return table.filter(F.col("region_carow_label") == HOME)


def top_industries(table: DataFrame, n: int = 10) -> DataFrame:
    """Every home row whose label is among those of the n largest industries."""
    ranked = add_rank(_at_home(table), "respondents_share", "__rank", ties="min")
    best = F.min("__rank").over(Window.partitionBy("industry_original_label"))
    return arrange(ranked.withColumn("__best", best).filter(F.col("__best") <= n).select(
        "industry_original", "industry_original_label", "respondents_share"), "respondents_share")


def n_industry_respondents(table: DataFrame) -> DataFrame:
    return total(_at_home(table), "respondents", "respondents")


def industry_subset_share(table: DataFrame, names: Sequence[str] = SOFTWARE_AND_WEB) -> DataFrame:
    return total(_at_home(table).filter(is_in("industry_original", names)), "respondents_share",
                 "respondents_share")


def industry_subset(table: DataFrame, names: Sequence[str] = OTHER_LEADING) -> DataFrame:
    return _at_home(table).filter(is_in("industry_original", names)).select(
        "industry_original", "respondents_share")


def industry_comparison(table: DataFrame) -> DataFrame:
    """Home and rest of the world side by side, from one conditional aggregate."""
    def cell(region: str, value: str, name: str):
        return F.max(F.when(F.col("region_carow_label") == region, F.col(value))).alias(name)

    wide = table.groupBy("industry_original_label").agg(*[
        cell(region, value, f"{value}_{suffix}")
        for value in ("respondents_share", "respondents", "median_salary_cad")
        for region, suffix in ((HOME, "ca"), (REST_OF_WORLD, "row"))])
    share, salary = "respondents_share", "median_salary_cad"
    return wide.withColumns({
        "respondents_total": F.col("respondents_ca") + F.col("respondents_row"),
        "pc_diff_carow": growth(f"{share}_ca", f"{share}_row"),
        "pp_diff_carow": F.col(f"{share}_ca") - F.col(f"{share}_row"),
        "pc_diff_median_salary_carow": growth(f"{salary}_ca", f"{salary}_row"),
        "diff_median_salary_carow": F.col(f"{salary}_ca") - F.col(f"{salary}_row")})


def industry_ratio(comparison: DataFrame, minimum: int = 50) -> DataFrame:
    rows = suppress_small(comparison, minimum, "respondents_ca").filter(
        ~matches("industry_original_label", "Other"))
    return arrange(rows.select("industry_original_label", divide(
        "respondents_share_ca", "respondents_share_row").alias("carow_ratio")), "carow_ratio")


def industry_years(respondents: DataFrame, first: int = 2015) -> DataFrame:
    """Yearly shares of consolidated industries at home, and their index."""
    rows = respondents.filter((F.col("year") >= first) & (F.col("country") == HOME_COUNTRY)
                              & F.col("industry_consolidated").isNotNull())
    shares = share_of_group(rows, ["year", "industry_consolidated"], ["year"])
    return index_to_base(shares, "respondents_share", ["industry_consolidated"], "year",
                         "respondents_share_ind")


def stable_industry_years(years: DataFrame, minimum: int = 20, n_years: int = 3,
                          left_out: Sequence[str] = INCONSISTENT_INDUSTRIES) -> DataFrame:
    """Rows of the industries with enough respondents in every one of the years."""
    industry = Window.partitionBy("industry_consolidated")
    steady = years.withColumns({"__least": F.min("respondents").over(industry),
                                "__years": F.count(F.lit(1)).over(industry)}).filter(
        (F.col("__least") >= minimum) & (F.col("__years") == n_years)
        & not_in("industry_consolidated", left_out)).drop("__least", "__years")
    return steady.withColumn("industry_label", title_case("industry_consolidated"))


def stable_industries(years: DataFrame, minimum: int = 20, n_years: int = 3) -> DataFrame:
    return stable_industry_years(years, minimum, n_years).select("industry_consolidated").distinct()


def industry_growth(years: DataFrame, first: int = 2015, previous: int = 2016,
                    last: int = LATEST_YEAR) -> DataFrame:
    wide = to_wide(years, ["industry_consolidated"], "year", "respondents_share",
                   {first: "share_first", previous: "share_previous", last: "share_last"})
    grown = wide.withColumns({"growth_year": growth("share_last", "share_previous"),
                              "growth_period": growth("share_last", "share_first")})
    return arrange(grown.select("industry_consolidated", "growth_year", "growth_period"),
                   "-growth_year")


def industry_growth_alternative(respondents: DataFrame, consolidations: DataFrame,
                                without: str = "pharma", industry: str = "health care",
                                first: int = 2015, year: int = LATEST_YEAR) -> DataFrame:
    """One industry's growth when some original industries are not folded into it."""
    rows = respondents.filter((F.col("year") >= first) & (F.col("country") == HOME_COUNTRY)
                              & F.col("industry_original").isNotNull())
    kept = consolidations.filter(~matches("industry_original", without))
    rows = lookup(rows.drop("industry_consolidated"), kept, "industry_original",
                  ["industry_consolidated"])
    shares = share_of_group(rows, ["year", "industry_consolidated"], ["year"])
    grown = growth_on_previous(shares, "respondents_share", ["industry_consolidated"], "year",
                               "respondents_share_pc_growth")
    return grown.filter((F.col("industry_consolidated") == industry) & (F.col("year") == year))


# --- employment -----------------------------------------------------------------

def employment_statuses(respondents: DataFrame) -> DataFrame:
    rows = pro_devs_at_home(respondents, "employment_status_original").filter(
        not_in("employment_status_original", STATUSES_LEFT_OUT))
    shares = share_of_group(rows, ["employment_status_original"])
    return shares.withColumn("status_ord", with_literal_order("employment_status_original",
                                                              STATUS_ORDER))


def n_employment_statuses(statuses: DataFrame) -> DataFrame:
    return total(statuses, "respondents", "respondents")
