"""Exact distinct counts of entities for several groupings from one pass of the rows.

Ids that are whole numbers become bits: one bitmap per group of the finest grouping and
bucket of 32,768 ids.  Coarser groupings merge bitmaps with OR, so that they neither read the
rows again nor count an entity twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemetrics.functions.semantics import divide
from placemetrics.operators.joins import join_null_safe, scalar
from placemetrics.storage import written_once

__all__ = ["entity_bitmaps", "count_entities", "distinct_counts", "member_shares",
           "with_missing_dims"]


def entity_bitmaps(df: DataFrame, entity: str, dims: Sequence[str]) -> DataFrame:
    """The ids seen in each combination of ``dims``: columns ``dims``, ``__bucket``, ``__ids``.

    Bitmaps are built by the tasks that read the rows and merged once, into a stored table: up
    to 4 KB, mostly zeros that compress, for a combination and 32,768 consecutive ids.  That suits
    ids given out one after the other; ids spread over all 64 bits are better counted by
    ``count_distinct``.  Missing ids are nobody.
    """
    seen = df.filter(F.col(entity).isNotNull()).select(
        *dims, F.bitmap_bucket_number(F.col(entity)).alias("__bucket"),
        F.bitmap_bit_position(F.col(entity)).alias("__bit"))
    return written_once(seen.groupBy(*dims, "__bucket")
                        .agg(F.bitmap_construct_agg("__bit").alias("__ids")))


def count_entities(bitmaps: DataFrame, by: Sequence[str] = (), into: str = "entities") -> DataFrame:
    """Entities per group of ``by``, some of the dimensions of the bitmaps; none: in all."""
    merged = bitmaps.groupBy(*by, "__bucket").agg(F.bitmap_or_agg("__ids").alias("__ids"))
    number = F.coalesce(F.sum(F.bitmap_count("__ids")), F.lit(0))
    return merged.groupBy(*by).agg(number.alias(into))


def distinct_counts(df: DataFrame, entity: str, groupings: Sequence[Sequence[str]],
                    into: str = "entities") -> list[DataFrame]:
    """A9: ``count_distinct(entity)`` for each grouping; the rows are read once, when called."""
    dims = list(dict.fromkeys(c for by in groupings for c in by))
    bitmaps = entity_bitmaps(df, entity, dims)
    return [count_entities(bitmaps, by, into) for by in groupings]


def member_shares(df: DataFrame, entity: str, members: str, groupings: Sequence[Sequence[str]],
                  into: str | None = None, count: str = "respondents",
                  share: str = "respondents_share",
                  total: str = "total_respondents") -> list[DataFrame]:
    """M-3 for several groupings at once: entities that name each member, over those that answered.

    Entities may have several rows.  An entity has answered in a group if one of its lists there
    is not missing; what the denominator counts is the OR of its members' bitmaps and of the
    empty lists, so every count of all groupings comes from one pass of the rows.
    """
    into = into or members
    dims = list(dict.fromkeys(c for by in groupings for c in by))
    named = F.transform(members, lambda m: F.struct(m.alias("member"), F.lit(True).alias("named")))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("member"), F.lit(False).alias("named")))
    rows = (df.filter(F.col(members).isNotNull())
            .select(entity, *dims, F.explode(F.when(F.size(members) > 0, named).otherwise(empty)).alias("__i"))
            .select(entity, *dims, F.col("__i.member").alias(into), F.col("__i.named").alias("__named")))
    bitmaps = entity_bitmaps(rows, entity, [*dims, into, "__named"])

    def one(by: Sequence[str]) -> DataFrame:
        counts = count_entities(bitmaps.filter("__named"), [into, *by], count)
        totals = count_entities(bitmaps, by, total)
        joined = (join_null_safe(counts, totals, list(by), "inner") if by
                  else counts.withColumn(total, scalar(totals, F.max(total))))
        return joined.withColumn(share, divide(count, total))

    return [one(by) for by in groupings]


def with_missing_dims(tables: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Tables of several groupings below one another; a dimension a grouping lacks is NULL.

    ``level`` tells the groupings apart, so that a missing member is not taken for a total.
    """
    kinds = {c: t for table in tables for c, t in table.dtypes}
    levelled = [table.withColumns({c: F.lit(None).cast(kinds[c]) for c in dims if c not in table.columns}
                                  | {"level": F.lit(i)}) for i, table in enumerate(tables)]
    return reduce(DataFrame.unionByName, levelled)
