"""Half-open bins and round-numbered ("pretty") bin edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemetrics.functions.semantics import as_column

__all__ = ["half_open_bin", "bin_index", "pretty_step", "raw_cell",
           "pretty_bin"]


def _by_bin(column: Column, edges: Sequence[float], values: Sequence) -> Column:
    if len(values) != len(edges) - 1:
        raise ValueError("one value per bin is needed")
    result = None
    for low, high, value in zip(edges, edges[1:], values):
        inside = (column >= F.lit(low)) & (column < F.lit(high))
        result = (F.when(inside, F.lit(value)) if result is None
                  else result.when(inside, F.lit(value)))
    return result


def bin_index(column: Column | str, edges: Sequence[float]) -> Column:
    """1-based number of the bin ``[edge, next edge)``; NULL outside all of them."""
    return _by_bin(as_column(column), edges, list(range(1, len(edges))))


def half_open_bin(column: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin closed on the left and open on the right.

    The labels are branches, not elements picked by number: an element lookup under
    ANSI rules is declared non-null, which is wrong for a missing number.
    """
    return _by_bin(as_column(column), edges, labels)


def pretty_step(cell: Column | str) -> Column:
    """Round-numbered step near a raw cell width.

    The candidates are 1, 2, 5 and 10 times the power of ten below the cell; a larger
    one is taken when the cell lies nearer to it under the usual high-bias weights.
    """
    cell = as_column(cell)
    high_bias = 1.5
    five_bias = 0.5 + 1.5 * high_bias
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    return (F.when(10 * base - cell < high_bias * (cell - 5 * base), 10 * base)
            .when(5 * base - cell < five_bias * (cell - 2 * base), 5 * base)
            .when(2 * base - cell < high_bias * (cell - base), 2 * base)
            .otherwise(base))


def raw_cell(low: Column | str, high: Column | str, bins: int) -> Column:
    """Range over the number of bins; the value's own size when the range is a point."""
    low, high = as_column(low), as_column(high)
    size = F.when(high == 0, F.lit(1.0)).otherwise(F.abs(high))
    point = F.when(size > 10, 9 + size / 10).otherwise(size) * 0.75 / max(bins // 3, 1)
    return F.when(high > low, (high - low) / bins).otherwise(point)


def pretty_bin(value: Column | str, high: Column | str, step: Column | str) -> tuple[Column, Column]:
    """Lower and upper edge of the bin holding ``value``.

    Bins are closed on the left; the top edge belongs to the last bin.
    """
    value, high, step = as_column(value), as_column(high), as_column(step)
    slack = F.lit(1e-10)
    index = F.least(F.floor(value / step + slack), F.ceil(high / step - slack) - 1)
    return index * step, (index + 1) * step
