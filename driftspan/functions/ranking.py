"""Exact ranks and running totals without a single-task window.

Rows are dealt into ranges of the ordering key. The ranges' sizes are a small table whose
running totals give each range's offset, and the window runs within a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of a draw that make a range: 4096 ranges.
DRAW_DIGITS = 3
#: Ranges of a numeric key.
RANGES = 256


def draw(seed: int, row_id: str, epoch: int | None = None) -> Column:
    """A row's reproducible random key: rows sorted by it and row_id are a permutation fixed by the seed."""
    label = f"{seed}:" if epoch is None else f"{seed}:{epoch}:"
    return F.md5(F.concat(F.lit(label), F.col(row_id).cast("string")))


def _offsets(sizes: DataFrame, by: list[str], of: str = "__size") -> DataFrame:
    """Running totals of a small table of ranges, the own range left out."""
    w = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum(of).over(w), F.lit(0)))


def rank_in_ranges(df: DataFrame, range_of: Column, order: list, by: list[str], out: str) -> DataFrame:
    """df with its 1-based rank (bigint) by order within by; range_of must ascend with order and have few values."""
    ranged = df.withColumn("__range", range_of)
    sizes = _offsets(ranged.groupBy(*by, "__range").agg(F.count("*").alias("__size")), by)
    sizes = sizes.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), F.col("__range").alias("__r"), "__before")
    same = F.col("__range").eqNullSafe(F.col("__r"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    w = Window.partitionBy(*by, "__range").orderBy(*order)
    ranked = ranged.withColumn("__in", F.row_number().over(w)).join(sizes, same)
    return ranked.withColumn(out, F.col("__in").cast("bigint") + F.col("__before")).select(*df.columns, out)


def rank_by_draw(df: DataFrame, row_id: str, seed: int, by: list[str] | None = None, out: str = "draw_rank", epoch: int | None = None) -> DataFrame:
    """df with each row's 1-based place in the seed's permutation of its group."""
    key = draw(seed, row_id, epoch)
    return rank_in_ranges(df, F.substring(key, 1, DRAW_DIGITS), [key, F.col(row_id)], by or [], out)


def range_bounds(df: DataFrame, column: str, ranges: int = RANGES) -> list:
    """Ascending bounds that cut a numeric column into about equal ranges."""
    found = df.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted(set(found or []))


def range_number(column: str, bounds: list, kind: str) -> Column:
    """How many bounds lie below the value; exact whatever the bounds are."""
    if not bounds:
        return F.lit(0)
    below = F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b < F.col(column))
    return F.size(below)


def rank_by_value(df: DataFrame, column: str, by: list[str] | None = None, out: str = "value_rank") -> DataFrame:
    """df with each row's 1-based rank by a unique numeric column within by."""
    kind = df.schema[column].dataType.simpleString()
    return rank_in_ranges(df, range_number(column, range_bounds(df, column), kind), [F.col(column)], by or [], out)
