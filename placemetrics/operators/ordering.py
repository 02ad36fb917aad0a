"""Orders and running totals over any number of rows.

A window without a group, or over a group with most of the rows, is one task.  Here the
rows are dealt to ranges of the order, as many as their number needs, the ranges' totals are
summed ahead and each range is finished on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.operators.joins import join_null_safe
from placemetrics.storage import written_once

__all__ = ["RANGE_ROWS", "in_ranges", "total_before", "numbered"]

#: Rows that one range holds, about; equal rows of the order always share a range.
RANGE_ROWS = 100_000


def in_ranges(df: DataFrame, *order: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """The table stored in ranges of an order, the range's number in ``__range``.

    ``df`` is read for its number of rows, for the cuts and for the rows themselves, so
    it should be a stored table.
    """
    ranges = max(1, -(-df.count() // rows))
    return written_once(df.repartitionByRange(ranges, *order)
                        .withColumn("__range", F.spark_partition_id()))


def total_before(df: DataFrame, value: str, into: str, by: Sequence[str],
                 within: Sequence[str] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group that come earlier in the order.

    Missing keys come first.  Rows that share group and order must have been added up
    before, so that no two rows tie.  Two passes of ``df``, which should be a stored
    table; a window holds at most one range, or one row per range of a group.
    """
    ordered = [F.col(c).asc_nulls_first() for c in (*within, *by)]
    placed = in_ranges(df, *ordered, rows=rows)
    all_before = Window.unboundedPreceding, -1
    totals = placed.groupBy(*within, "__range").agg(F.sum(value).alias("__n"))
    carried = F.sum("__n").over(
        Window.partitionBy(*within).orderBy("__range").rowsBetween(*all_before))
    borders = totals.select(*within, "__range", F.coalesce(carried, F.lit(0)).alias("__carried"))
    inside = F.sum(value).over(
        Window.partitionBy(*within, "__range").orderBy(*[F.col(c).asc_nulls_first() for c in by])
        .rowsBetween(*all_before))
    return (join_null_safe(placed, borders, [*within, "__range"], "inner")
            .withColumn(into, F.col("__carried") + F.coalesce(inside, F.lit(0)))
            .select(*df.columns, into))


def numbered(df: DataFrame, into: str, *order: Column, rows: int = RANGE_ROWS) -> DataFrame:
    """Add each row's place in an order of the whole table, from 1.

    Rows that tie are ordered by their contents, so no more than equal rows change places
    from run to run, and any number of ties is dealt to ranges like other rows.
    """
    order = (*order, F.xxhash64(*df.columns), F.col("__row"))
    stored = written_once(df.withColumn("__row", F.monotonically_increasing_id()))
    placed = in_ranges(stored, *order, rows=rows)
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    borders = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__carried"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return (placed.join(borders, "__range")
            .withColumn(into, F.col("__carried") + place).select(*df.columns, into))
