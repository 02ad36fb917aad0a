"""Filters and small steps that the report's blocks share."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import as_column

# Fixed values.
HOME_COUNTRY = "canada"
PRO_DEV = "pro dev"
LATEST_YEAR = 2017


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def present(*columns: str) -> Column:
    return all_of(*[F.col(c).isNotNull() for c in columns])


def latest(df: DataFrame, *needed: str, year: int = LATEST_YEAR, country: str | None = None,
           pro_status: str | None = None) -> DataFrame:
    """One year's respondents who answered ``needed``; optionally one country or status."""
    df = df.filter(F.col("year") == year)
    if country is not None:
        df = df.filter(F.col("country") == country)
    if pro_status is not None:
        df = df.filter(F.col("pro_status") == pro_status)
    return df.filter(present(*needed)) if needed else df


def pro_devs_at_home(df: DataFrame, *needed: str, year: int = LATEST_YEAR) -> DataFrame:
    return latest(df, *needed, year=year, country=HOME_COUNTRY, pro_status=PRO_DEV)


def total(df: DataFrame, value: str | Column, name: str) -> DataFrame:
    return df.agg(F.sum(as_column(value)).alias(name))


def row_count(df: DataFrame, name: str = "respondents") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
