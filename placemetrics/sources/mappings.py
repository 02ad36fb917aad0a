"""Schemas of the lookup tables a survey project keeps as CSV files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemetrics.functions.text import drop_parenthesised, to_ascii
from placemetrics.operators.joins import recode_by_lookup
from placemetrics.sources.files import read_csv

__all__ = ["SCHEMAS", "read_mapping", "Mappings", "read_mappings", "currency_names",
           "purchasing_power"]

# Columns of each kind of lookup file, in file order.
SCHEMAS = {
    "traffic cities": "city_in_traffic string, city_consolidated string",
    "statistics cities": "city_in_statistics string, city_consolidated string",
    "company types": "company_type string, company_type_label string",
    "country corrections": "original_country_label string, corrected_country_label string",
    "country metadata": "country string, is_eu boolean, currency_code string",
    "population countries": "country_in_population string, country_in_survey string",
    "currencies": "currency_name string, currency_code string, currency_per_usd double",
    "survey roles": "dev_role string, dev_role_label string",
    "traffic roles": "dev_role string, dev_role_label string",
    "employment statuses":
        "employment_status_original string, employment_status_consolidated string",
    "industries": "industry_original string, industry_consolidated string",
    "world cities": "city string, country string",
    "languages": "language string, language_label string, "
                 "is_back_end_language boolean, is_front_end_language boolean",
    "majors": "major string, major_group string",
    "provinces": "province_original string, province_consolidated string",
    "purchasing power": "country string, local_currency_per_intl_dollar double",
}


@dataclass(frozen=True)
class Mappings:
    """The lookup tables that harmonising needs."""

    country_corrections: DataFrame
    country_metadata: DataFrame
    industries: DataFrame
    employment_statuses: DataFrame
    currencies: DataFrame
    purchasing_power: DataFrame


def read_mapping(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A lookup file of a known kind; columns go by position, whatever the header says."""
    return read_csv(spark, path, SCHEMAS[kind])


def currency_names(currencies: DataFrame) -> DataFrame:
    """Currency names without the sign in parentheses, in lower case."""
    return currencies.withColumn("currency_name", F.lower(drop_parenthesised("currency_name")))


def purchasing_power(rates: DataFrame, corrections: DataFrame) -> DataFrame:
    """One rate per country under the corrected country names.

    Where several names of the table mean one country, the corrected name's own rate counts,
    else that of the first name.
    """
    rates = rates.toDF("country", "local_currency_per_intl_dollar").withColumn(
        "country", F.lower(F.trim(to_ascii("country"))))
    named = recode_by_lookup(rates, corrections, "country", "original_country_label",
                             "corrected_country_label", "__corrected")
    first = F.struct(F.col("country") != F.col("__corrected"), "country")
    return named.groupBy(F.col("__corrected").alias("country")).agg(F.min_by(
        "local_currency_per_intl_dollar", first).alias("local_currency_per_intl_dollar"))


def read_mappings(spark: SparkSession, paths: Mapping[str, str]) -> Mappings:
    """The lookup tables of harmonising, given the path of each kind of file."""
    def read(kind: str) -> DataFrame:
        return read_mapping(spark, paths[kind], kind)

    corrections = read("country corrections")
    return Mappings(
        country_corrections=corrections,
        country_metadata=read("country metadata"),
        industries=read("industries"),
        employment_statuses=read("employment statuses"),
        currencies=currency_names(read("currencies")),
        purchasing_power=purchasing_power(read("purchasing power"), corrections))
