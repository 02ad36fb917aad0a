"""Harmonising: four yearly tables of different shape to one, on the whole order table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.plans.survey import (harmonise, store_respondents, survey_2014, survey_2015,
                                       survey_2016, survey_2017)
from placemetrics.queries import tables as t
from placemetrics.queries.registry import quoted, register
from placemetrics.sources.mappings import Mappings, currency_names, purchasing_power
from placemetrics.sources.store import store_table

# Small lookup tables in the shape of the mapping files.
CORRECTIONS = {"nation_1": "canada", "nation_6": "canada", "nation_24": "united states",
               "nation_5": "fifth land"}
METADATA = {"canada": (False, "cad"), "united states": (False, "usd"),
            "fifth land": (False, "ffl"), "nation_3": (True, "eur"), "nation_8": (True, "eur"),
            "nation_2": (False, "sen")}
INDUSTRIES = {"building": "construction", "machinery": "manufacturing", "household": "n/a"}
STATUSES = {"1-urgent": "urgent", "2-high": "urgent"}
CURRENCIES = {"Canadian dollars (C$)": ("cad", 1.32), "U.S. dollars ($)": ("usd", 1.0),
              "Euros": ("eur", 0.93), "Second sen": ("sen", None)}


# Ranges of the order date, which the scan can use to skip row groups.
YEARS = {2014: "o_orderdate < TIMESTAMP '1997-01-01 00:00:00'",
         2015: "o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00'",
         2016: "o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' AND o_orderdate < TIMESTAMP '2000-01-01 00:00:00'",
         2017: "o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'"}
COUNTRY = "CASE WHEN c_acctbal < -500 THEN 'I prefer not to say' ELSE n_name END"
CURRENCY = ("CASE WHEN o_orderstatus = 'F' THEN 'Euros' WHEN o_orderstatus = 'O' "
            "THEN 'Canadian Dollars (c$)' END")
OTHER = "CASE WHEN o_orderpriority = '5-LOW' THEN 'XBT' ELSE 'none' END"
RATE = "CASE WHEN o_orderstatus = 'F' THEN '0.93' WHEN o_orderstatus = 'O' THEN '1.32' END"
SALARY = "CASE WHEN o_totalprice > 20000 THEN CAST(o_totalprice AS STRING) ELSE 'secret' END"
PAST = {"SQL": "o_totalprice > 200000", "Java": "o_orderstatus = 'O'"}
CODES = {"q0029_1": "o_totalprice > 300000", "q0029_2": "o_orderstatus = 'F'",
         "q0074_1": "c_acctbal > 3000", "q0074_2": "o_orderpriority = '1-URGENT'",
         "q0069_1": "c_acctbal > 9000", "q0103_1": "o_totalprice < 90000"}
LABELS = {"q0029_1": "Desktop", "q0029_2": "Sys Admin", "q0074_1": "R", "q0074_2": "C#",
          "q0069_1": "Self-taught", "q0103_1": "East Asian"}


def yearly_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    languages = [F.expr(f"CASE WHEN {test} THEN {quoted(name)} END") for name, test in PAST.items()]
    country = F.expr(COUNTRY)
    answers = t.answers(spark, folder)
    first = answers.filter(YEARS[2014]).select(
        country.alias("What Country do you live in?"),
        F.col("o_orderstatus").alias("What is your gender?"),
        F.col("c_mktsegment").alias(
            "How would you best describe the industry you currently work in?"),
        *[c.alias(f"X{i}") for i, c in enumerate(languages)])
    second = answers.filter(YEARS[2015]).select(
        country.alias("Country"), F.col("o_orderstatus").alias("Gender"),
        F.col("c_mktsegment").alias("Industry"),
        F.col("o_orderpriority").alias("Employment Status"),
        *[c.alias(f"Current Lang {i}") for i, c in enumerate(languages)])
    third = answers.filter(YEARS[2016]).select(
        country.alias("country"), F.col("o_orderstatus").alias("gender"),
        F.col("c_mktsegment").alias("industry"),
        F.concat_ws("; ", *languages).alias("tech_do"),
        F.col("o_orderpriority").alias("employment_status"))
    coded = [F.expr(f"CASE WHEN {test} THEN '"
                    + ("Worked with last year" if code.startswith("q0074") else "Selected")
                    + "' ELSE '0' END").alias(code) for code, test in CODES.items()]
    texts = {"q0003": COUNTRY, "gender": "o_orderstatus", "q0022": "c_mktsegment",
             "q0001": "'Pro dev'", "q0030": "o_orderpriority", "q0023": "'10 to 19 employees'",
             "q0024": "c_mktsegment", "q0017": "o_orderpriority", "current_salary_USD": SALARY,
             "salary_conversion": RATE, "q0063": CURRENCY, "q0063_other": OTHER,
             "q0041": "o_orderstatus", "q0061": "o_orderstatus", "q0018": "c_mktsegment",
             "ed_level": "CASE WHEN c_acctbal > 5000 THEN 'Bachelor''s' ELSE 'other' END",
             "ed_major": "c_mktsegment", "q0071": "o_orderstatus",
             "q0027": "CASE WHEN c_acctbal < 0 THEN 'Less than a year' "
                      "ELSE '3 to 4 years' END"}
    fourth = answers.filter(YEARS[2017]).select(
        F.col("o_orderkey").alias("x_RespondentID"),
        *[F.expr(sql).alias(name) for name, sql in texts.items()], *coded)
    layout = t.pairs(spark, {k: (v, "Nominal") for k, v in LABELS.items()},
                     "Variable string, Label string, Measurement Level string")
    return [survey_2014(first, ["X0", "X1"]), survey_2015(second), survey_2016(third),
            survey_2017(fourth, layout)]


def mappings(spark: SparkSession, folder: str) -> Mappings:
    corrections = t.pairs(spark, CORRECTIONS,
                          "original_country_label string, corrected_country_label string")
    rates = t.read(spark, folder, "nation").select(
        F.col("n_name").alias("country"),
        (F.lit(0.5) + F.col("n_regionkey") * 0.125).alias("rate"))
    return Mappings(
        country_corrections=corrections,
        country_metadata=t.pairs(spark, METADATA,
                                 "country string, is_eu boolean, currency_code string"),
        industries=t.pairs(spark, INDUSTRIES,
                           "industry_original string, industry_consolidated string"),
        employment_statuses=t.pairs(
            spark, STATUSES,
            "employment_status_original string, employment_status_consolidated string"),
        currencies=currency_names(t.pairs(
            spark, CURRENCIES,
            "currency_name string, currency_code string, currency_per_usd double")),
        purchasing_power=purchasing_power(rates, corrections))


COLUMNS = ["year", "country", "region", "region_carow_label", "gender", "pro_status",
           "industry_original", "industry_consolidated", "employment_status_original",
           "employment_status_consolidated", "company_size", "local_currency_code",
           "country_currency_code", "salary_usd", "salary_intl_dollar",
           "dev_role_desktop_mobile", "dev_role_dbs_sysadmin", "pro_experience_mid_year",
           "pro_experience_bin", "educ_level_group_label"]


def harmonised(spark: SparkSession, folder: str) -> DataFrame:
    df = harmonise(yearly_tables(spark, folder), mappings(spark, folder))
    lists = ["dev_roles", "languages", "informal_educ", "ethnicities"]
    return df.select(F.col("respondent_id").cast("bigint").alias("respondent_id"), *COLUMNS,
                     *[F.array_join(c, ";").alias(c) for c in lists])


def _packed(options: dict[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {test} THEN {quoted(label)} END"
                      for label, test in options.items())
    return f"nullif(array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ';'), '')"


def _coded(prefix: str, lower: bool) -> str:
    packed = _packed({LABELS[c].lower() if lower else LABELS[c]: test
                      for c, test in CODES.items() if c.startswith(prefix)})
    return f"CASE WHEN year = 2017 THEN {packed} END"


_LANGUAGES_2016 = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), '; ')".format(
    ", ".join(f"CASE WHEN {test} THEN {quoted(k.lower())} END" for k, test in PAST.items()))


def _case(table: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(
        f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + " END"


_META = "(SELECT * FROM (VALUES " + ", ".join(
    f"({quoted(k)}, {str(v[0]).lower()}, {quoted(v[1])})" for k, v in METADATA.items()) \
    + ") v(country, is_eu, code))"

_SQL = f"""WITH q AS (SELECT *, CASE WHEN {YEARS[2014]} THEN 2014 WHEN {YEARS[2015]} THEN 2015
    WHEN {YEARS[2016]} THEN 2016 ELSE 2017 END AS year, lower({COUNTRY}) AS answered
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey),
  p AS (SELECT *, CASE WHEN answered = 'i prefer not to say' THEN NULL
      ELSE coalesce({_case(CORRECTIONS, 'answered')}, answered) END AS country,
    CASE WHEN year = 2017 THEN lower({CURRENCY}) END AS currency,
    CASE WHEN year = 2017 THEN lower({OTHER}) END AS other,
    CASE WHEN year = 2017 THEN CAST({RATE} AS DOUBLE) END AS rate,
    CASE WHEN year = 2017 THEN TRY_CAST({SALARY} AS DOUBLE) END AS salary_usd,
    CASE WHEN year = 2017 THEN CASE WHEN c_acctbal < 0 THEN 0.5 ELSE 3.5 END END::DOUBLE AS mid
    FROM q),
  cur AS (SELECT * FROM (VALUES ('canada', 1.32::DOUBLE, 'cad'),
      ('united states', 1.0, 'usd'), ('nation_3', 0.93, 'eur'), ('nation_8', 0.93, 'eur'),
      ('nation_2', NULL, 'sen')) v(cur_country, cur_rate, cur_code)),
  ppp AS (SELECT coalesce({_case(CORRECTIONS, 'lower(n_name)')}, lower(n_name)) AS ppp_country,
      arg_min(0.5 + n_regionkey * 0.125::DOUBLE, lower(n_name)) AS ppp FROM nation GROUP BY 1),
  j AS (SELECT p.*, is_eu, code AS country_currency_code, ppp,
      coalesce(cur_code, CASE WHEN currency = 'euros' THEN 'eur'
          WHEN currency LIKE 'canadian dollars%' THEN 'cad' END,
          CASE WHEN currency IS NULL AND length(other) = 3 THEN other END) AS local_currency_code
    FROM p LEFT JOIN cur ON answered = cur_country AND rate IS NOT DISTINCT FROM cur_rate
    LEFT JOIN {_META} m ON p.country = m.country
    LEFT JOIN ppp ON p.country = ppp_country)
SELECT CASE WHEN year = 2017 THEN o_orderkey END AS respondent_id, year, country,
  CASE WHEN country IS NULL THEN NULL WHEN country = 'canada' THEN 'Canada'
       WHEN country = 'united states' THEN 'US' WHEN is_eu THEN 'EU' ELSE 'ROW' END AS region,
  CASE WHEN country IS NULL THEN NULL WHEN country = 'canada' THEN 'Canada' ELSE 'ROW' END
    AS region_carow_label, lower(o_orderstatus) AS gender,
  CASE WHEN year = 2017 THEN 'pro dev' END AS pro_status,
  lower(c_mktsegment) AS industry_original,
  CASE lower(c_mktsegment) WHEN 'building' THEN 'construction' WHEN 'machinery'
    THEN 'manufacturing' WHEN 'household' THEN NULL ELSE lower(c_mktsegment) END
    AS industry_consolidated,
  CASE WHEN year > 2014 THEN lower(o_orderpriority) END AS employment_status_original,
  CASE WHEN year > 2014 AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' END
    AS employment_status_consolidated,
  CASE WHEN year = 2017 THEN '10 to 19' END AS company_size, local_currency_code,
  country_currency_code, salary_usd,
  CASE WHEN country_currency_code = local_currency_code THEN salary_usd * rate / ppp END
    AS salary_intl_dollar,
  coalesce(regexp_matches({_coded('q0029', True)}, 'desktop|mobile'), false)
    AS dev_role_desktop_mobile,
  coalesce(regexp_matches({_coded('q0029', True)}, 'dba|sys.*admin'), false)
    AS dev_role_dbs_sysadmin,
  mid AS pro_experience_mid_year,
  CASE WHEN mid IS NOT NULL THEN 'Under 5' END AS pro_experience_bin,
  CASE WHEN year = 2017 AND c_acctbal > 5000 THEN 'Bachelor''s Degree' END
    AS educ_level_group_label,
  {_coded('q0029', True)} AS dev_roles,
  CASE WHEN year = 2017 THEN {_coded('q0074', True)}
       WHEN year = 2016 THEN replace({_LANGUAGES_2016}, '; ', '; ')
       ELSE {_packed({k.lower(): v for k, v in PAST.items()})} END AS languages,
  {_coded('q0069', False)} AS informal_educ, {_coded('q0103', False)} AS ethnicities
FROM j"""

register("harmonised_respondents", harmonised, _SQL)


def stored_respondents(spark: SparkSession, folder: str) -> DataFrame:
    """Harmonised once, stored by year and key, then two years of one block from their folders.

    The answers of those years meet their visits, stored in the same buckets, without a shuffle.
    """
    people = store_respondents(yearly_tables(spark, folder), mappings(spark, folder))
    visits = store_table(t.read(spark, folder, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", partition=None)
    latest = people.filter("year = 2017").select("respondent_key", "country", "region", "salary_intl_dollar")
    met = latest.join(visits, F.col("respondent_key") == F.col("l_orderkey"))
    return met.groupBy("region").agg(
        F.count(F.lit(1)).alias("visits"), F.sum("l_quantity").cast("bigint").alias("quantity"),
        F.count_if(F.col("salary_intl_dollar").isNotNull()).alias("visits_with_salary"))


register("stored_respondents", stored_respondents, f"""WITH h AS ({_SQL})
SELECT region, count(*) AS visits, CAST(sum(l_quantity) AS BIGINT) AS quantity,
  count(salary_intl_dollar) AS visits_with_salary
FROM h JOIN lineitem ON l_orderkey = respondent_id WHERE year = 2017 GROUP BY 1""")


def respondents_per_year(spark: SparkSession, folder: str) -> DataFrame:
    """How many respondents each survey has, those without an id included, from the stored table."""
    people = store_respondents(yearly_tables(spark, folder), mappings(spark, folder))
    return people.groupBy("year").agg(F.count_distinct("respondent_key").alias("respondents"),
                                      F.count("respondent_id").alias("with_id"))


register("respondents_per_year", respondents_per_year, f"""WITH h AS ({_SQL})
SELECT year, count(*) AS respondents, count(respondent_id) AS with_id FROM h GROUP BY 1""")
