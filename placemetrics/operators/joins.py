"""Lookups, membership joins and one-row statistics.

No join here carries a broadcast hint.  Spark broadcasts a side when its size
statistics are under ``spark.sql.autoBroadcastJoinThreshold``, and adaptive
execution does so again from measured sizes, so a lookup table that has grown
falls back to a sort-merge join with skew splitting instead of failing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

__all__ = ["join_null_safe", "lookup", "LookupReport", "unique_keys", "recode_by_lookup", "keep_members",
           "drop_members", "scalar", "full_join"]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Mapping[str, str] | Sequence[str],
                   how: str = "left") -> DataFrame:
    """Equi-join in which a missing key meets a missing key (rule N5).

    ``keys`` maps left to right column names.  Only the left key columns stay.
    """
    if not isinstance(keys, Mapping):
        keys = {key: key for key in keys}
    renamed = right.withColumnsRenamed({r: f"__key_{r}" for r in keys.values()})
    condition = reduce(and_, (left[l].eqNullSafe(renamed[f"__key_{r}"]) for l, r in keys.items()))
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__key_{r}" for r in keys.values()])


def lookup(df: DataFrame, table: DataFrame, on: Mapping[str, str] | Sequence[str] | str,
           take: Mapping[str, str] | Sequence[str] | None = None) -> DataFrame:
    """Left join of a lookup table, taking the named columns (renamed if mapped)."""
    if isinstance(on, str):
        on = [on]
    if not isinstance(on, Mapping):
        on = {key: key for key in on}
    if take is None:
        take = [c for c in table.columns if c not in on.values()]
    if not isinstance(take, Mapping):
        take = {c: c for c in take}
    wanted = table.select(*[F.col(r).alias(r) for r in on.values()],
                          *[F.col(old).alias(new) for old, new in take.items()])
    return join_null_safe(df, wanted, on, "left")


class LookupReport:
    """Counts of lookups, taken in the same run that uses them.

    Each lookup of a chain counts its rows and those whose key found nothing; more rows after
    a lookup than before it mean repeated keys.  The counts are there once the table has been
    written or collected whole.  Tasks that run again count again, so only "some" and "none"
    are sure; no shuffle may lie between the lookups of one report.
    """

    def __init__(self) -> None:
        self._start = Observation()
        self._lookups: list[tuple[str, Observation]] = []

    def start(self, df: DataFrame) -> DataFrame:
        """Count the rows that enter the chain."""
        return df.observe(self._start, F.count(F.lit(1)).alias("rows"))

    def lookup(self, name: str, df: DataFrame, table: DataFrame, on: Mapping[str, str] | Sequence[str] | str,
               take: Mapping[str, str] | Sequence[str] | None = None) -> DataFrame:
        """``lookup`` with its rows and its unmatched rows counted under ``name``."""
        on = [on] if isinstance(on, str) else on
        on = on if isinstance(on, Mapping) else {key: key for key in on}
        take = [c for c in table.columns if c not in on.values()] if take is None else take
        take = take if isinstance(take, Mapping) else {c: c for c in take}
        found = lookup(df, table.withColumn("__hit", F.lit(True)), on, take | {"__hit": "__hit"})
        asked = reduce(and_, (F.col(c).isNotNull() for c in on))
        seen = Observation()
        self._lookups.append((name, seen))
        return found.observe(seen, F.count(F.lit(1)).alias("rows"),
                             F.count_if(asked & F.col("__hit").isNull()).alias("unmatched")).drop("__hit")

    def counts(self) -> dict[str, dict[str, int]]:
        """Per lookup the rows whose key was given but not found, and the rows it added."""
        before, out = self._start.get["rows"], {}
        for name, seen in self._lookups:
            after = seen.get
            out[name] = {"unmatched": after["unmatched"], "added": after["rows"] - before}
            before = after["rows"]
        return out

    def check(self, complete: Sequence[str] = ()) -> None:
        """Fail if a lookup had repeated keys, or left rows unmatched where it must be complete."""
        counts = self.counts()
        wrong = [f"{name}: repeated keys added {c['added']} rows" for name, c in counts.items() if c["added"]]
        wrong += [f"{name}: {counts[name]['unmatched']} rows without a match" for name in complete
                  if counts[name]["unmatched"]]
        if wrong:
            raise ValueError("; ".join(wrong))


def unique_keys(table: DataFrame, *keys: str) -> DataFrame:
    """The lookup table, or an error when it is used if a key has several rows (rule N25).

    One aggregate of the lookup table; ``lookup`` itself multiplies rows for repeated keys.
    """
    rest = [c for c in table.columns if c not in keys]
    grouped = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row"))
    message = F.concat(F.lit("several rows for key "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("__n") > 1, F.raise_error(message)).otherwise(F.col("__row"))
    return grouped.select(*keys, checked.alias("__row")).select(
        *keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*table.columns)


def recode_by_lookup(df: DataFrame, table: DataFrame, column: str, old: str, new: str,
                     into: str | None = None) -> DataFrame:
    """A value's correction where the table has one, else the value itself."""
    found = lookup(df, table, {column: old}, {new: "__found"})
    return (found.withColumn(into or column, F.coalesce("__found", column)).drop("__found"))


def keep_members(df: DataFrame, members: DataFrame,
                 keys: Mapping[str, str] | Sequence[str]) -> DataFrame:
    return join_null_safe(df, members, keys, "left_semi")


def drop_members(df: DataFrame, members: DataFrame,
                 keys: Mapping[str, str] | Sequence[str]) -> DataFrame:
    return join_null_safe(df, members, keys, "left_anti")


def full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on one key, which is kept from whichever side has it."""
    other = right.withColumnRenamed(key, "__other")
    joined = left.join(other, left[key].eqNullSafe(other["__other"]), "full")
    return joined.withColumn(key, F.coalesce(key, "__other")).drop("__other")


def scalar(df: DataFrame, expression: Column) -> Column:
    """A one-row aggregate of ``df`` usable in any expression.

    It is planned as a scalar subquery, so neither a join nor a single-task
    window is needed to bring a grand total to every row.
    """
    return df.agg(expression.alias("__value")).scalar()
