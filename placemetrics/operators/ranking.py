"""Ranks, ties-inclusive selections and orders derived from other results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from placemetrics.operators.distribution import value_positions
from placemetrics.operators.joins import join_null_safe, scalar
from placemetrics.operators.ordering import numbered

__all__ = ["whole_table", "top_n", "add_rank", "rank_of", "add_position", "arrange", "keep_maximum",
           "suppress_small"]


def whole_table(*within: str) -> WindowSpec:
    """Window over a group, or over the whole of a table that has one row per member.

    Without a group all rows meet in one task: only for results bounded by a dimension.
    """
    return Window.partitionBy(*within)


def top_n(df: DataFrame, n: int, by: str, within: Sequence[str] = (),
          smallest: bool = False, members: str = "many") -> DataFrame:
    """The n best rows per group with all ties; rows without a weight drop out (rule N15).

    Equal weights are counted with map-side partials.  Only the n best distinct weights
    of each partition and group are ordered; those with fewer than n better rows name
    the rows to keep, so any number of tied rows is neither moved nor sorted.  A result
    with one row per member of a dimension (``members="few"``) takes one window instead,
    cut to the n best of each partition ahead of it.
    """
    order = F.col(by).asc() if smallest else F.col(by).desc()
    window = (Window.partitionBy(*within) if within else Window).orderBy(order)
    if members == "few":
        return (df.filter(F.col(by).isNotNull()).withColumn("__rank", F.rank().over(window))
                .filter(F.col("__rank") <= n).drop("__rank"))
    weights = (df.filter(F.col(by).isNotNull()).groupBy(*within, by)
               .agg(F.count(F.lit(1)).alias("__n"))
               .withColumn("__place", F.row_number().over(window)).filter(F.col("__place") <= n))
    better = F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1))
    kept = (weights.withColumn("__better", F.coalesce(better, F.lit(0)))
            .filter(F.col("__better") < n).select(*within, by))
    return join_null_safe(df, kept, [*within, by], "left_semi")


def add_rank(df: DataFrame, by: str, into: str, within: Sequence[str] = (),
             descending: bool = True, ties: str = "average", missing_last: bool = False,
             members: str = "few") -> DataFrame:
    """Rank of each row in its group: ``average`` (rule N16) or ``min`` (rule N17) for ties.

    Rows without a value get no rank, or with ``missing_last`` the first place after
    all rows that have one.  With ``members="few"`` a group is one window partition,
    which suits results with one row per place; ``"many"`` orders ranges of the
    distinct values, as many as they need, and has no such limit.
    """
    if ties not in ("average", "min"):
        raise ValueError("ties must be 'average' or 'min'")
    if members == "few":
        group = whole_table(*within)
        order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
        rank = F.rank().over(group.orderBy(order))
        if ties == "average":
            equal = F.count(F.lit(1)).over(Window.partitionBy(*within, by))
            rank = rank + (equal - 1) / 2
        if missing_last:
            rank = F.when(F.col(by).isNull(), F.count(by).over(group) + 1).otherwise(rank)
        else:
            rank = F.when(F.col(by).isNotNull(), rank)
        return df.withColumn(into, rank)
    positions = value_positions(df, by, within)
    before = (F.col("n_group") - F.col("n_below") - F.col("n_equal") if descending
              else F.col("n_below"))
    rank = before + (F.col("n_equal") + 1) / 2 if ties == "average" else (before + 1).cast("int")
    ranked = join_null_safe(df, positions.select(*within, by, rank.alias(into)),
                            [*within, by], "left")
    if not missing_last:
        return ranked
    present = F.count(by) + 1
    if not within:
        return ranked.withColumn(into, F.coalesce(into, scalar(df, present)))
    after_all = df.groupBy(*within).agg(present.alias("__after_all"))
    return (join_null_safe(ranked, after_all, within, "left")
            .withColumn(into, F.coalesce(into, "__after_all")).drop("__after_all"))


def rank_of(df: DataFrame, by: str, is_member: Column) -> DataFrame:
    """The rows meeting a predicate with their smallest rank among all rows of ``df``.

    Only the better rows are counted, so nothing is sorted or gathered.
    """
    value = scalar(df.filter(is_member), F.max(by))
    better = scalar(df.withColumn("__value", value), F.count_if(F.col(by) > F.col("__value")))
    return df.filter(is_member).withColumn("rank", (better + 1).cast("int"))


def add_position(df: DataFrame, by: str, into: str, tie_breaker: Sequence[str] = (),
                 descending: bool = True, members: str = "few") -> DataFrame:
    """1-based row position.

    ``"few"`` is one window, for results a ``top_n`` has already bounded; ``"many"`` numbers
    ranges of the order separately, each range after the rows of those before it.
    """
    order = [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(),
             *[F.col(c).asc_nulls_last() for c in tie_breaker]]
    if members == "many":
        return numbered(df, into, *order)
    return df.withColumn(into, F.row_number().over(Window.orderBy(*order)))


def arrange(df: DataFrame, *columns: str) -> DataFrame:
    """Global sort with missing values last; ``-name`` sorts downwards."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-")
                        else F.col(c).asc_nulls_last() for c in columns])


def keep_maximum(df: DataFrame, column: str, members: str = "few") -> DataFrame:
    if members == "few":
        return (df.withColumn("__most", F.max(column).over(whole_table()))
                .filter(F.col(column) == F.col("__most")).drop("__most"))
    return df.filter(F.col(column) == scalar(df, F.max(column)))


def suppress_small(df: DataFrame, minimum: float, *counts: str) -> DataFrame:
    """Keep rows in which every named count reaches the minimum sample."""
    for count in counts:
        df = df.filter(F.col(count) >= minimum)
    return df
