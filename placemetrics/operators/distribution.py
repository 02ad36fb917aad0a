"""Exact order statistics that no single task has to hold a whole group for.

Ranks and medians need to know how many values lie below a value.  A window over
the group would bring all of it to one task, and Spark's exact median keeps every
distinct value of a group in one buffer.  Here a mergeable quantile sketch says
where to cut each group, equal values are counted with map-side partials, and what
lies between two cuts is cut again until few distinct values are left to order.  The
sketch decides how much work is left to a task, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placemetrics.functions.semantics import as_column
from placemetrics.operators.joins import join_null_safe, scalar
from placemetrics.operators.ordering import RANGE_ROWS, total_before
from placemetrics.storage import written_once

__all__ = ["value_positions", "summarise", "medians", "approximate_medians", "median_of_column"]

ACCURACY = 10000
# Distinct values of a group that are ordered in one task at most, and the ranges that
# more of them are cut into.
DISTINCT = 10_000
CUTS = 64
# Half the width of the first bracket around the middle, as a share of the group.
FIRST_WIDTH = 2.5 / ACCURACY


def _per_group(df: DataFrame, groups: DataFrame, within: Sequence[str],
               names: Sequence[str]) -> DataFrame:
    """Bring per-group columns to each row; a scalar subquery if there is one group."""
    if within:
        return join_null_safe(df, groups, within, "inner")
    packed = scalar(groups, F.first(F.struct(*names)))
    return df.withColumn("__packed", packed).select(
        *df.columns, *[F.col(f"__packed.{n}").alias(n) for n in names])


def value_positions(df: DataFrame, value: str, within: Sequence[str] = (),
                    rows: int = RANGE_ROWS) -> DataFrame:
    """Per distinct value of a group: how many rows equal it and how many lie below.

    Columns: ``within``, ``value``, ``n_equal``, ``n_below``, ``n_group``.  The counts of
    distinct values are written once, so that ``df`` itself is read a single time, and then
    added up in ranges of about ``rows`` values, as many as there have to be.
    """
    counts = written_once(df.filter(F.col(value).isNotNull())
                          .groupBy(*within, value).agg(F.count(F.lit(1)).alias("n_equal")))
    totals = counts.groupBy(*within).agg(F.sum("n_equal").alias("n_group"))
    located = total_before(counts, "n_equal", "n_below", [value], within, rows)
    return _per_group(located, totals, within, ["n_group"]).select(
        *within, value, "n_equal", "n_below", "n_group")


def summarise(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column],
              medians: Mapping[str, Column | str]) -> DataFrame:
    """Aggregates and exact medians per group, NULLs left out (rules N8, N21).

    First pass: the aggregates, and from a sketch a bracket around the middle of every
    column.  Second pass: values below a bracket are only counted, those inside are
    counted one by one and ordered.  The counts tell whether the middle ranks lie
    inside the bracket.  Groups where one does not are passed again with a bracket
    that is wider on both sides, in the end the whole group.  All columns share the
    passes, which run when this function is called; without any median there is one
    ordinary lazy aggregate.
    """
    if not medians:
        return df.groupBy(*keys).agg(*aggregates)
    names = list(medians)
    rows = df.withColumns({f"__v{i}": as_column(c).cast("double")
                           for i, c in enumerate(medians.values())})
    # One small row per group, written once: the second pass joins it at its known size,
    # normally as a broadcast, so the raw rows are read twice and never moved by key.
    first = written_once(rows.groupBy(*keys).agg(
        *aggregates, *[F.expr(_bracket(i, FIRST_WIDTH)) for i in range(len(names))]))
    brackets = [f"__b{i}" for i in range(len(names))]
    found = written_once(_middles(rows, first.select(*keys, *brackets), keys, names))
    settled, width = found.filter("__inside"), FIRST_WIDTH
    while not (missed := found.filter("NOT __inside").select(*keys)).isEmpty():
        width *= 20
        again = join_null_safe(rows, missed, keys, "left_semi") if keys else rows
        wider = written_once(again.groupBy(*keys).agg(
            *[F.expr(_bracket(i, width)) for i in range(len(names))]))
        found = written_once(_middles(again, wider, keys, names))
        settled = settled.union(found.filter("__inside"))
    middles = settled.drop("__inside")
    summary = first.drop(*brackets)
    if keys:
        return join_null_safe(summary, middles, keys, "left")
    return summary.withColumn("__m", scalar(middles, F.first(F.struct(*names)))).select(
        *summary.columns, *[F.col(f"__m.{n}").alias(n) for n in names])


def _bracket(i: int, width: float) -> str:
    """Count and two cuts around the middle of column ``__v<i>``, as plain SQL text."""
    if width >= 0.5:
        cuts = f"min(__v{i}), 'high', max(__v{i})"
    else:
        cut = f"percentile_approx(__v{i}, array({0.5 - width}D, {0.5 + width}D), {ACCURACY})"
        cuts = f"get({cut}, 0), 'high', get({cut}, 1)"
    return f"named_struct('n', count(__v{i}), 'low', {cuts}) AS __b{i}"


def _middles(rows: DataFrame, brackets: DataFrame, keys: Sequence[str],
             names: Sequence[str]) -> DataFrame:
    """Per group the median of every column, and whether all middles lay in their brackets."""
    n = range(len(names))
    placed = _per_group(rows.select(*keys, *[f"__v{i}" for i in n]), brackets, keys,
                        [f"__b{i}" for i in n])
    # Each value up to the upper end of its bracket; NULL stands for "below the bracket".
    found = ", ".join(f"""CASE WHEN __v{i} <= __b{i}.high THEN named_struct('measure', {i},
        'n', __b{i}.n, 'value', CASE WHEN __v{i} >= __b{i}.low THEN __v{i} END) END""" for i in n)
    counts = (placed.select(*keys, F.expr(f"explode(array({found}))").alias("f"))
              .filter("f IS NOT NULL")
              .groupBy(*keys, "f").agg(F.count(F.lit(1)).alias("__equal"))
              .select(*keys, "f.*", "__equal"))
    counts = _narrowed(written_once(counts), keys)
    so_far = (Window.partitionBy(*keys, "measure").orderBy(F.col("value").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = counts.withColumn("__upto", F.sum("__equal").over(so_far)).selectExpr(
        *[f"`{k}`" for k in keys], "measure", "value",
        "__upto >= floor((n + 1) / 2) AND __upto - __equal < floor((n + 1) / 2) AS __lower",
        "__upto > floor(n / 2) AND __upto - __equal <= floor(n / 2) AS __upper")
    ends = [F.expr(f"max(CASE WHEN measure = {i} AND {end} THEN value END)").alias(f"{end}{i}")
            for i in n for end in ("__lower", "__upper")]
    middles = ordered.groupBy(*keys).agg(*ends)
    together = (join_null_safe(brackets, middles, keys, "left") if keys
                else _per_group(brackets, middles, [], [c for i in n for c in (f"__lower{i}", f"__upper{i}")]))
    inside = " AND ".join(
        f"(__b{i}.n = 0 OR (__lower{i} IS NOT NULL AND __upper{i} IS NOT NULL))" for i in n)
    return together.selectExpr(
        *[f"`{k}`" for k in keys],
        *[f"(__lower{i} + __upper{i}) / 2 AS `{name}`" for i, name in enumerate(names)],
        f"{inside} AS __inside")


def _narrowed(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts around the middle ranks, at most DISTINCT values of each group and column.

    ``counts`` is a stored table of (keys, measure, n, value, __equal), a NULL value standing
    for all rows below.  A round cuts the values of large groups into CUTS ranges, adds up the
    ranges and turns those below the middle into the row for "below"; those above go.
    """
    group = [*keys, "measure"]
    while True:
        large = (counts.groupBy(*group).agg(F.count("value").alias("__d"))
                 .filter(F.col("__d") > DISTINCT).select(*group))
        if large.isEmpty():
            return counts
        cuts = join_null_safe(counts, large, group, "left_semi").groupBy(*group).agg(
            F.percentile_approx("value", [i / CUTS for i in range(1, CUTS)], 50 * CUTS)
            .alias("__cuts"))
        ranged = join_null_safe(counts, cuts, group, "left").withColumn(
            "__range", F.when(F.col("value").isNull(), -1).otherwise(
                F.size(F.filter("__cuts", lambda cut: cut < F.col("value")))))
        so_far = Window.partitionBy(*group).orderBy("__range")  # at most CUTS + 1 rows
        chosen = (ranged.filter("__cuts IS NOT NULL").groupBy(*group, "n", "__range")
                  .agg(F.sum("__equal").alias("__s"))
                  .withColumn("__upto", F.sum("__s").over(so_far)).filter("__range >= 0")
                  .groupBy(*group).agg(
                      F.expr("min(CASE WHEN __upto >= floor((n + 1) / 2) THEN __range END) AS __from"),
                      F.expr("min(CASE WHEN __upto > floor(n / 2) THEN __range END) AS __to")))
        counts = written_once(
            join_null_safe(ranged, chosen, group, "left")
            .filter("__cuts IS NULL OR __range <= __to")
            .withColumn("value", F.expr("CASE WHEN __cuts IS NULL OR __range >= __from THEN value END"))
            .groupBy(*group, "n", "value").agg(F.sum("__equal").alias("__equal"))
            .select(*keys, "measure", "n", "value", "__equal"))


def medians(df: DataFrame, columns: Mapping[str, Column | str],
            within: Sequence[str] = ()) -> DataFrame:
    """Exact medians of several columns per group."""
    return summarise(df, list(within), [], columns)


def median_of_column(df: DataFrame, column: str) -> Column:
    """The exact median of one whole column as a scalar subquery."""
    return scalar(medians(df, {"m": column}), F.max("m"))


def approximate_medians(df: DataFrame, columns: Mapping[str, Column | str],
                        within: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Sketched medians for callers who prefer one pass to exactness."""
    return df.groupBy(*within).agg(*[
        F.percentile_approx(as_column(c).cast("double"), 0.5, accuracy).alias(n)
        for n, c in columns.items()])
