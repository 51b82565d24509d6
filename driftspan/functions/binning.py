"""Equal-width bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed_edges(low: float, high: float, n: int) -> list[float]:
    """Inner edges of n equal-width bins; a constant column is widened by a thousandth either way."""
    if low == high:
        low, high = low - (0.001 * abs(low) if low else 0.001), high + (0.001 * abs(high) if high else 0.001)
    return [low + i * ((high - low) / n) for i in range(1, n)]


def right_closed_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin number 0 to n - 1; a value on an edge falls into the bin below it."""
    number = F.lit(0)
    for edge in right_closed_edges(low, high, n):
        number = number + (x > F.lit(edge)).cast("int")
    return number


def left_closed_bin(x: Column, low: Column, high: Column, n: int) -> Column:
    """Bin number 0 to n - 1 of a value within [low, high], null outside; edges belong to the bin above, the last to the last.

    A constant range is widened by a half either way.
    """
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    number = F.lit(0)
    for i in range(1, n):
        number = number + (x >= lo + F.lit(float(i)) * ((hi - lo) / F.lit(float(n)))).cast("int")
    return F.when((x >= lo) & (x <= hi), number)
