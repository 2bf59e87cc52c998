"""Exact positions in time order, and row windows, without putting a whole series in one task.

A series is cut into time slices. Work inside a slice is a window over (keys, slice); what has to
cross slices travels through a summary with one row per slice, or through a few copied edge rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.calendar import DAY, epoch_seconds

SLICE_DAYS = 32


def time_slice(ts: Column, days: int = SLICE_DAYS) -> Column:
    """Number of the fixed-length time slice a timestamp falls in."""
    return F.floor(epoch_seconds(ts) / (days * DAY))


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    position: str = "position",
    ties: Sequence[str] = (),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by ``ts`` then ``ties``."""
    sliced = df.withColumn("_slice", time_slice(F.col(ts), slice_days))
    within = Window.partitionBy(*keys, "_slice").orderBy(ts, *ties)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    numbered = sliced.withColumn("_local", F.row_number().over(within) - 1)
    return (
        numbered.join(offsets, [*keys, "_slice"], "left")
        .withColumn(position, F.col("_local") + F.col("_before"))
        .drop("_slice", "_local", "_before")
    )


def with_edge_rows(
    df: DataFrame, block: Column, from_previous: Column | None = None, from_next: Column | None = None
) -> DataFrame:
    """Copy edge rows into neighbouring blocks.

    ``from_previous`` marks rows the next block has to see, ``from_next`` rows the previous block has
    to see. Result columns: ``_block`` to partition by, and ``_home``, true for the original row only.
    """
    shifts = [F.lit(0)]
    if from_previous is not None:
        shifts.append(F.when(from_previous, F.lit(1)))
    if from_next is not None:
        shifts.append(F.when(from_next, F.lit(-1)))
    return (
        df.withColumn("_own_block", block)
        .withColumn("_shift", F.explode(F.array_compact(F.array(*shifts))))
        .withColumn("_block", F.col("_own_block") + F.col("_shift"))
        .withColumn("_home", F.col("_shift") == 0)
        .drop("_own_block", "_shift")
    )


def with_row_halo(df: DataFrame, position: str, before: int, after: int, block_rows: int = 4096) -> DataFrame:
    """Cut a positioned series into blocks of rows that also hold the rows just before and after them."""
    rows = max(block_rows, before, after)
    offset = F.col(position) % rows
    return with_edge_rows(
        df,
        F.floor(F.col(position) / rows),
        from_previous=(offset >= rows - before) if before else None,
        from_next=(offset < after) if after else None,
    )


def home_rows(df: DataFrame) -> DataFrame:
    """Drop the copied edge rows and the block columns."""
    return df.filter("_home").drop("_block", "_home")
