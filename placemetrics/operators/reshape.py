"""Wide and long tables, multi-select answers, unions and column selection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import as_column
from placemetrics.operators.joins import scalar

__all__ = ["to_long", "to_wide", "select_between", "select_matching", "drop_matching",
           "rename_by", "pack_options", "pack_coded_options", "explode_members",
           "explode_packed", "stack_tables", "keep_first", "with_literal_order"]


def to_long(df: DataFrame, name: str, value: str, columns: Sequence[str] | None = None,
            ids: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column); cells that are NULL keep their row."""
    columns = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    return df.unpivot(list(ids), columns, name, value)


def to_wide(df: DataFrame, ids: Sequence[str], key: str, value: str,
            members: Mapping[object, str] | Sequence[object]) -> DataFrame:
    """One column per named member, NULL where a cell has no row (rule N20).

    The members are named by the caller, so no extra job looks for them, and the
    cells are one aggregation with map-side partials.
    """
    if not isinstance(members, Mapping):
        members = {m: str(m) for m in members}
    return df.groupBy(*ids).agg(*[
        F.max(F.when(F.col(key) == F.lit(m), F.col(value))).alias(name)
        for m, name in members.items()])


def select_between(df: DataFrame, first: str, last: str, *others: str,
                   ids: Sequence[str] = ()) -> DataFrame:
    """The columns from ``first`` to ``last`` in table order, plus named ones."""
    start, stop = df.columns.index(first), df.columns.index(last)
    return df.select(*ids, *df.columns[start:stop + 1], *others)


def select_matching(df: DataFrame, pattern: str, ids: Sequence[str] = ()) -> DataFrame:
    return df.select(*ids, *[c for c in df.columns if re.search(pattern, c) and c not in ids])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.select(*[c for c in df.columns if not re.search(pattern, c)])


def rename_by(df: DataFrame, rename) -> DataFrame:
    """Rename every column with ``rename(list of names) -> list of names``."""
    return df.toDF(*rename(df.columns))


def _packed(options: Sequence[Column]) -> Column:
    chosen = F.filter(F.array(*options), lambda o: o.isNotNull())
    return F.when(F.size(chosen) > 0, chosen)


def pack_options(options: Mapping[str, Column | str] | Sequence[Column]) -> Column:
    """Multi-select columns as one list, in column order; NULL if none is chosen.

    Given a mapping, each key is the label used where its condition holds.  The
    list is built inside the row: nothing is shuffled and nothing joined back.
    """
    if isinstance(options, Mapping):
        return _packed([F.when(as_column(chosen), F.lit(label))
                        for label, chosen in options.items()])
    return _packed(list(options))


def pack_coded_options(df: DataFrame, columns: Sequence[str], selected: Sequence[str],
                       layout: DataFrame, code: str, label: str, into: str) -> DataFrame:
    """``pack_options`` for coded columns whose labels are in a layout table.

    The layout has one row per survey column, so its code-to-label map is bounded
    by the width of the survey; it arrives as a scalar subquery.
    """
    labels = scalar(layout.filter(F.col(code).isin(list(columns))),
                    F.map_from_entries(F.collect_list(F.struct(code, label))))
    packed = _packed([F.when(F.col(c).isin(list(selected)), F.col("__labels")[c])
                      for c in columns])
    return df.withColumn("__labels", labels).withColumn(into, packed).drop("__labels")


def explode_members(df: DataFrame, column: str, into: str | None = None,
                    keep_missing: bool = False) -> DataFrame:
    """One row per member of a list; a missing list gives one NULL row if kept."""
    into = into or column
    rest = [c for c in df.columns if c not in (column, into)]
    explode = F.explode_outer if keep_missing else F.explode
    return df.select(*rest, explode(column).alias(into))


def explode_packed(df: DataFrame, column: str, into: str | None = None, separator: str = ";",
                   trim: bool = False) -> DataFrame:
    """One row per member of a packed text (rule N19).

    A missing text keeps one NULL row and a trailing separator gives an empty
    member; blanks are trimmed only on request.
    """
    parts = F.split(F.col(column), re.escape(separator), -1)
    if trim:
        parts = F.transform(parts, F.trim)
    return explode_members(df.withColumn(column, parts), column, into, keep_missing=True)


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order (rule N18).

    Taking the least struct has map-side partials, so a key with very many rows
    does not pull them into one task as a row-number window would.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    least = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return least.select(*[c if c in keys else F.col(f"__first.{c}").alias(c)
                          for c in df.columns])


def with_literal_order(column: Column | str, levels: Sequence[str]) -> Column:
    """1-based position of a value in a fixed order; NULL if it is not listed."""
    position = F.array_position(F.array(*[F.lit(level) for level in levels]), as_column(column))
    return F.when(position > 0, position.cast("int"))
