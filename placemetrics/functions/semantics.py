"""Column helpers for statistical-table semantics.

Survey scripts treat a missing value as "unknown" in conditions, as an ordinary
member in lookups and as "not in the set" in membership tests.  SQL differs on
each of these, so the rules live here, once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "as_column", "if_known", "is_in", "not_in", "matches", "divide", "growth",
    "to_number", "first_match", "strict_sum", "count_present", "ratio_of_counts",
    "share_of_rows", "money_sum", "money_mean", "recode", "recode_by_pattern",
    "half_even", "fill_missing",
]


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def if_known(condition: Column, when_true, when_false) -> Column:
    """Conditional that stays NULL where the condition is NULL (rule N1)."""
    return F.when(condition, when_true).when(~condition, when_false)


def is_in(column: Column | str, values: Iterable) -> Column:
    """Membership that is false, not NULL, for a missing value (rule N3)."""
    return F.coalesce(as_column(column).isin(list(values)), F.lit(False))


def not_in(column: Column | str, values: Iterable) -> Column:
    """Negated membership; keeps rows whose value is missing (rule N3)."""
    return ~is_in(column, values)


def matches(column: Column | str, pattern: str, ignore_case: bool = False) -> Column:
    """Regex search that is false for a missing value (rule N2)."""
    pattern = f"(?i){pattern}" if ignore_case else pattern
    return F.coalesce(as_column(column).rlike(pattern), F.lit(False))


def divide(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division; NULL where the denominator is zero (rule N9)."""
    return F.try_divide(as_column(numerator).cast("double"),
                        as_column(denominator).cast("double"))


def growth(later: Column | str, earlier: Column | str) -> Column:
    """Relative change from ``earlier`` to ``later``."""
    return divide(later, earlier) - F.lit(1.0)


def to_number(column: Column | str) -> Column:
    """Text to double, NULL where the text is no number (rule N10)."""
    return as_column(column).try_cast("double")


def first_match(column: Column | str, pattern: str) -> Column:
    """First substring matching ``pattern``, NULL where none does (rule N11)."""
    return F.regexp_substr(as_column(column), F.lit(pattern))


def strict_sum(column: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL (rule N7)."""
    column = as_column(column)
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def count_present(column: Column | str) -> Column:
    return F.count(as_column(column))


def ratio_of_counts(numerator: Column, denominator: Column) -> Column:
    """Rows meeting one predicate over rows meeting another, in one pass."""
    return divide(F.count_if(numerator), F.count_if(denominator))


def share_of_rows(condition: Column) -> Column:
    return divide(F.count_if(condition), F.count(F.lit(1)))


def money_sum(column: Column | str) -> Column:
    """Sum of an amount in exact cents.

    Adding doubles gives a result that depends on task order, so a retried stage
    could differ in the last digits; cents in a decimal do not.
    """
    return F.sum(as_column(column).cast("decimal(18,2)")).cast("double")


def money_mean(column: Column | str) -> Column:
    """Mean of an amount, NULLs left out; NULL for an empty group (rule N8).

    Converted amounts have fractions of a cent, so eight digits are kept: the result is
    the mean of the amounts themselves, and still does not depend on task order.
    """
    exact = F.sum(as_column(column).cast("decimal(28,8)")).cast("double")
    return divide(exact, count_present(column))


def recode(column: Column | str, mapping: Mapping[str, object], otherwise=None) -> Column:
    """Exact-value relabelling; values outside the mapping keep ``otherwise``."""
    column = as_column(column)
    result = F.lit(None)
    for index, (old, new) in enumerate(mapping.items()):
        result = (F.when(column == old, F.lit(new)) if index == 0
                  else result.when(column == old, F.lit(new)))
    return F.coalesce(result, column if otherwise is None else otherwise)


def recode_by_pattern(column: Column | str, rules: Sequence[tuple[str, str]],
                      otherwise: Column, ignore_case: bool = False) -> Column:
    """First matching pattern decides the label."""
    result = None
    for pattern, label in rules:
        test = matches(column, pattern, ignore_case)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    return otherwise if result is None else result.otherwise(otherwise)


def half_even(column: Column | str, digits: int = 0) -> Column:
    """Rounding to the even neighbour on a tie (rule N22)."""
    return F.bround(as_column(column), digits)


def fill_missing(column: Column | str, value) -> Column:
    return F.coalesce(as_column(column), F.lit(value))
