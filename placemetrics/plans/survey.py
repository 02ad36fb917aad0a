"""Per-year survey tables to one table of respondents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import fill_missing, if_known, is_in, matches, recode
from placemetrics.functions.text import drop_parenthesised, title_case, to_ascii
from placemetrics.operators.joins import LookupReport
from placemetrics.operators.joins import lookup as plain_lookup
from placemetrics.operators.measures import normalise_salary, parse_experience
from placemetrics.operators.reshape import (drop_matching, pack_coded_options, pack_options,
                                            rename_by, stack_tables)
from placemetrics.sources.mappings import Mappings
from placemetrics.sources.store import store_table, with_key

__all__ = ["survey_2014", "survey_2015", "survey_2016", "survey_2017", "harmonise",
           "store_respondents", "region_of", "HOME", "REST_OF_WORLD"]

HOME = "Canada"
REST_OF_WORLD = "ROW"

# Names of the survey questions in the yearly files.
QUESTIONS_2014 = {
    "What Country do you live in?": "country",
    "What is your gender?": "gender",
    "How would you best describe the industry you currently work in?": "industry",
}
QUESTIONS_2015 = {"Country": "country", "Gender": "gender", "Industry": "industry",
                  "Employment Status": "employment_status"}
QUESTIONS_2017 = {
    "respondent_id": "respondent_id", "q0003": "country", "gender": "gender",
    "q0022": "industry", "q0001": "pro_status", "q0030": "web_dev_role",
    "q0023": "company_size", "q0024": "company_type", "q0017": "employment_status",
    "current_salary_USD": "salary_usd", "salary_conversion": "local_currency_per_usd",
    "q0063": "local_currency", "q0063_other": "local_currency_other",
    "q0041": "job_seeking_status", "q0061": "job_discovery_channel", "q0018": "educ_level",
    "ed_level": "educ_level_group", "ed_major": "major",
    "q0071": "unemployed_time_post_bootcamp", "q0027": "pro_experience",
}
MULTI_SELECT_2017 = {
    "dev_roles": ("q0029", "Selected"),
    "languages": ("q0074", "Worked with last year"),
    "informal_educ": ("q0069", "Selected"),
    "ethnicities": ("q0103", "Selected"),
}

# Answers that stand for a missing country or industry.
MISSING_COUNTRIES = ["i prefer not to say", "n/a"]
MISSING_INDUSTRIES = "(i prefer not to)|(not currently employed)|student"

# Labels and order of the education groups.
EDUCATION_LABELS = {
    "hs or lower": "High School or Lower",
    "some college": "Some College",
    "bachelor's": "Bachelor's Degree",
    "grad degree": "Graduate Degree",
}

# Answers that are folded to lower case (lists apart, being arrays here).
LOWER_CASE = ["country", "pro_status", "web_dev_role", "employment_status", "local_currency",
              "local_currency_other", "industry", "company_size", "company_type", "educ_level",
              "job_seeking_status", "job_discovery_channel", "educ_level_group",
              "unemployed_time_post_bootcamp", "pro_experience", "major", "gender"]
LOWER_CASE_LISTS = ["dev_roles", "languages"]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _answers(raw: DataFrame, questions: dict[str, str]) -> list[Column]:
    return [_quoted(q).alias(name) for q, name in questions.items()]


def survey_2014(raw: DataFrame, language_columns: Sequence[str] | None = None) -> DataFrame:
    """Languages stand in columns 43 to 54, one per option."""
    language_columns = raw.columns[42:54] if language_columns is None else language_columns
    return raw.select(*_answers(raw, QUESTIONS_2014),
                      pack_options([_quoted(c) for c in language_columns]).alias("languages"),
                      F.lit(2014).alias("year"))


def survey_2015(raw: DataFrame) -> DataFrame:
    language_columns = [c for c in raw.columns if "Current Lang" in c]
    return raw.select(*_answers(raw, QUESTIONS_2015),
                      pack_options([_quoted(c) for c in language_columns]).alias("languages"),
                      F.lit(2015).alias("year"))


def survey_2016(raw: DataFrame) -> DataFrame:
    """Languages come packed in one text."""
    return raw.select("country", "gender", "industry",
                      F.split("tech_do", ";", -1).alias("languages"), "employment_status",
                      F.lit(2016).alias("year"))


def survey_2017(raw: DataFrame, layout: DataFrame) -> DataFrame:
    """Answers are coded; the layout sheet has the label of every coded column."""
    raw = rename_by(raw, lambda names: [
        "respondent_id" if "RespondentID" in n else n for n in names])
    labelled = layout.filter(F.col("`Measurement Level`").isNotNull())
    lists = list(MULTI_SELECT_2017)
    df = raw
    for name, (code, chosen) in MULTI_SELECT_2017.items():
        columns = [c for c in raw.columns if code in c]
        df = pack_coded_options(df, columns, [chosen], labelled, "Variable", "Label", name)
    df = df.select(*_answers(raw, QUESTIONS_2017), *lists)
    df = df.withColumns({c: to_ascii(F.col(c).cast("string")) for c in QUESTIONS_2017.values()})
    df = df.withColumns({c: F.col(c).try_cast("double") for c in
                         ("respondent_id", "salary_usd", "local_currency_per_usd")})
    return df.withColumns({"company_size": F.regexp_replace("company_size", " employees", ""),
                           "year": F.lit(2017)})


def region_of(country: Column, is_eu: Column) -> Column:
    """Country group; NULL where the country is (rule N1)."""
    return if_known(country == "canada", F.lit(HOME), if_known(
        country == "united states", F.lit("US"), if_known(
            is_eu, F.lit("EU"), F.lit(REST_OF_WORLD))))


def harmonise(tables: Sequence[DataFrame], mappings: Mappings,
              report: LookupReport | None = None) -> DataFrame:
    """M-16: union of the years, corrected, enriched and scored, without a shuffle.

    Every join is a lookup in a small table.  The rate lookup uses the country as
    answered, the later ones the corrected country.  ``report`` counts in the same run
    which lookups miss rows or multiply them.
    """
    def lookup(df: DataFrame, name: str, *where: Any) -> DataFrame:
        table = rates if name == "rates" else getattr(mappings, name)
        return report.lookup(name, df, table, *where) if report else plain_lookup(df, table, *where)

    df = stack_tables(*tables)
    df = report.start(df) if report else df
    df = df.withColumns({c: F.lower(c) for c in LOWER_CASE if c in df.columns})
    df = df.withColumns({c: F.transform(c, F.lower) for c in LOWER_CASE_LISTS if c in df.columns})
    df = df.withColumn("local_currency", drop_parenthesised("local_currency"))

    df = lookup(df, "country_corrections", {"country": "original_country_label"})
    df = lookup(df, "industries", {"industry": "industry_original"})
    df = lookup(df, "employment_statuses",
                {"employment_status": "employment_status_original"})
    df = lookup(df, "currencies", {"local_currency": "currency_name"},
                {"currency_code": "local_currency_code_name"})
    rates = plain_lookup(mappings.currencies, mappings.country_metadata, "currency_code", ["country"])
    df = df.withColumn("__rate", F.col("local_currency_per_usd").cast("decimal(18,6)"))
    rates = rates.withColumn("__rate", F.col("currency_per_usd").cast("decimal(18,6)"))
    df = lookup(df, "rates", ["country", "__rate"], {"currency_code": "local_currency_code_rate"})
    df = df.drop("__rate").withColumnsRenamed({
        "industry": "industry_original", "employment_status": "employment_status_original"})

    consolidated = F.col("industry_consolidated")
    df = df.withColumns({
        "country": F.when(~is_in("country", MISSING_COUNTRIES),
                          F.coalesce("corrected_country_label", "country")),
        "dev_role_desktop_mobile": matches(F.array_join("dev_roles", ";"), "desktop|mobile"),
        "dev_role_dbs_sysadmin": matches(F.array_join("dev_roles", ";"), "dba|sys.*admin"),
        "industry_consolidated":
            F.when(~matches("industry_original", MISSING_INDUSTRIES),
                   F.when(consolidated.isNull(), F.col("industry_original"))
                   .when(consolidated != "n/a", consolidated)),
        "local_currency_code": F.coalesce(
            "local_currency_code_rate", "local_currency_code_name",
            F.when(F.col("local_currency").isNull() & (F.length("local_currency_other") == 3),
                   F.col("local_currency_other"))),
    })
    df = parse_experience(df)
    df = lookup(df, "country_metadata", "country",
                {"is_eu": "is_eu", "currency_code": "country_currency_code"})
    df = lookup(df, "purchasing_power", "country", ["local_currency_per_intl_dollar"])
    df = df.withColumn("is_eu", fill_missing("is_eu", False))
    df = df.withColumns({
        "region": region_of(F.col("country"), F.col("is_eu")),
        "region_carow_label": if_known(F.col("country") == "canada", F.lit(HOME),
                                       F.lit(REST_OF_WORLD)),
        "educ_level_group_label": recode("educ_level_group", EDUCATION_LABELS,
                                         title_case("educ_level_group")),
    })
    # An education group outside the four listed ones has no place in their order.
    df = df.withColumn("educ_level_group_label", F.when(
        is_in("educ_level_group_label", EDUCATION_LABELS.values()),
        F.col("educ_level_group_label")))
    return drop_matching(normalise_salary(df), "q0029")


def store_respondents(tables: Sequence[DataFrame], mappings: Mappings, complete: Sequence[str] = (),
                      buckets: int | None = None) -> DataFrame:
    """The harmonised table, written once: a folder per year, buckets by ``respondent_key``.

    The key is the respondent's id, or a number of its own where the survey had none.  The run
    that writes the table counts its lookups; it fails if a lookup has repeated keys, or if one
    named in ``complete`` leaves rows unmatched.
    """
    report = LookupReport()
    rows = with_key(harmonise(tables, mappings, report), "respondent_id", "respondent_key")
    stored = store_table(rows, "respondent_key", buckets)
    report.check(complete)
    return stored
