"""Sequential operators as window queries: islands, fills, as-of, gaps, groups and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(part: list[str], order: list):
    return Window.partitionBy(*part).orderBy(*order)


def islands(df: DataFrame, part: list[str], order: list, starts: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows from 1; `starts` is true for a row that begins a new run (it may look back with lag)."""
    return df.withColumn("_new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(out, F.sum("_new").over(_w(part, order).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def previous(c: str | Column, part: list[str], order: list) -> Column:
    return F.lag(c).over(_w(part, order))


def fill_forward(df: DataFrame, part: list[str], order: list, value: Column, out: str) -> DataFrame:
    """The last value that is not null so far."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(_w(part, order).rowsBetween(Window.unboundedPreceding, 0)))


def as_of(df: DataFrame, part: list[str], order: list, marker: Column, key: Column, out: str) -> DataFrame:
    """Assigns each row to the last marker at or before it, else to the first marker of its partition."""
    mark = F.when(marker, key)
    everything = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.coalesce(F.last(mark, ignorenulls=True).over(_w(part, order).rowsBetween(Window.unboundedPreceding, 0)), F.first(mark, ignorenulls=True).over(everything)))


def interval_gaps(df: DataFrame, part: list[str], low: str, high: str, least: Column) -> DataFrame:
    """Rows (part, gap_start, gap_end) for the stretches longer than `least` that no interval covers."""
    seen = F.max(high).over(_w(part, [low, high]).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("gap_start", seen).where(F.col(low) - F.col("gap_start") > least).select(*part, "gap_start", F.col(low).alias("gap_end"))


def fixed_groups(df: DataFrame, part: list[str], order: list, size: int, out: str = "group_no") -> DataFrame:
    """Numbers rows in groups of `size`, from 0."""
    return df.withColumn(out, F.floor((F.row_number().over(_w(part, order)) - 1) / size))


def char_budget(df: DataFrame, part: list[str], order: list, length: Column, budget: int) -> DataFrame:
    """The longest prefix of each partition whose lengths fit the budget; the first row always stays.

    Lengths are at least 0, so running sums never fall and a prefix is all rows whose sum fits.
    """
    w = _w(part, order)
    used = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).withColumn("_n", F.row_number().over(w)).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")
