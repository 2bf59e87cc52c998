"""Sequence windows, lag features, rolling statistics and seasonal decomposition."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelworks.functions.calendar import DAY, HOUR, epoch_seconds
from panelworks.operators.continuity import contiguous_runs, is_window_target
from panelworks.operators.ordering import SLICE_DAYS, home_rows, row_positions, time_slice, with_edge_rows, with_row_halo
from panelworks.scale import attach


def _lookback(df, keys, ts, window, stride, step_seconds, slice_days):
    """Rows with their ``window`` predecessors in the same block, and the flag ``_target``.

    A block is a time slice plus the last ``window`` steps of the slice before it, so one shuffle
    gives every row its whole look-back.
    """
    days = max(slice_days, math.ceil(window * step_seconds / DAY))
    rows = df if stride == 1 else contiguous_runs(df, keys, ts, step_seconds, days)
    rows = rows.withColumn("_sec", epoch_seconds(F.col(ts)))
    blocks = with_edge_rows(
        rows,
        time_slice(F.col(ts), days),
        from_previous=F.pmod(F.col("_sec"), F.lit(days * DAY)) >= days * DAY - window * step_seconds,
    )
    order = Window.partitionBy(*keys, "_block").orderBy("_sec")
    if stride != 1:
        return blocks.withColumn("_target", is_window_target(window, stride)), order
    adjacent = F.coalesce(F.col("_sec") - F.lag("_sec").over(order) == step_seconds, F.lit(False))
    linked = blocks.withColumn("_linked", adjacent.cast("int"))
    run = F.sum("_linked").over(order.rowsBetween(-(window - 1), 0))
    return linked.withColumn("_target", run == window), order


def sequence_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    target: str,
    window: int,
    stride: int = 1,
    step_seconds: int = HOUR,
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """One row per full window: the ``window`` rows before it as an array, and its own target."""
    blocks, order = _lookback(df, keys, ts, window, stride, step_seconds, slice_days)
    history = F.collect_list(F.struct(*columns)).over(order.rowsBetween(-window, -1))
    return (
        blocks.withColumn("sequence", history)
        .filter("_target AND _home")
        .select(*keys, ts, "sequence", F.col(target).alias("next_target"))
    )


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target: str,
    window: int,
    stride: int = 1,
    step_seconds: int = HOUR,
    slice_days: int = SLICE_DAYS,
    name: str = "lag_{}",
) -> DataFrame:
    """Flat form of the sequence window: columns ``lag_1`` to ``lag_<window>`` on every target row."""
    blocks, order = _lookback(df, keys, ts, window, stride, step_seconds, slice_days)
    lags = {name.format(k): F.lag(target, k).over(order) for k in range(1, window + 1)}
    return blocks.withColumns(lags).filter("_target AND _home").select(*df.columns, *lags)


def rolling_statistics(
    series: DataFrame, ts: str, value: str, window: int = 12, keys: Sequence[str] = (), slice_days: int = SLICE_DAYS
) -> DataFrame:
    """Mean and sample standard deviation of the last ``window`` rows; null until the window is full."""
    placed = row_positions(series, keys, ts, "_place", slice_days=slice_days)
    blocks = with_row_halo(placed, "_place", before=window - 1, after=0)
    frame = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-(window - 1), 0)
    full = F.count(value).over(frame) == window
    return home_rows(
        blocks.withColumn("rolling_mean", F.when(full, F.avg(value).over(frame))).withColumn(
            "rolling_std", F.when(full, F.stddev_samp(value).over(frame))
        )
    ).drop("_place")


def seasonal_decomposition(
    series: DataFrame,
    ts: str,
    value: str,
    period: int = 12,
    model: str = "additive",
    keys: Sequence[str] = (),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Classical decomposition into trend, seasonal and residual parts.

    The trend is the centred moving average over one period (half weights on the two ends when the
    period is even) and is null on the first and last half period. The seasonal part is the mean
    detrended value per phase, centred to 0 (additive) or 1 (multiplicative).
    """
    half = period // 2
    placed = row_positions(series, keys, ts, "_place", slice_days=slice_days)
    blocks = with_row_halo(placed, "_place", before=half, after=half)
    order = Window.partitionBy(*keys, "_block").orderBy("_place")
    around = order.rowsBetween(-half, half)
    total = F.sum(value).over(around)
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(order) + F.lead(value, half).over(order)) / 2
    trend = F.when(F.count(value).over(around) == 2 * half + 1, total / period)
    additive = model == "additive"
    trended = home_rows(blocks.withColumn("trend", trend)).withColumn("_phase", F.col("_place") % period)
    detrended = F.col(value) - F.col("trend") if additive else F.try_divide(value, "trend")
    phases = trended.groupBy(*keys, "_phase").agg(F.avg(detrended).alias("_mean"))
    level = F.avg("_mean").over(Window.partitionBy(*keys))
    seasonal = phases.select(
        *keys, "_phase", (F.col("_mean") - level if additive else F.try_divide(F.col("_mean"), level)).alias("seasonal")
    )
    residual = (
        F.col(value) - F.col("trend") - F.col("seasonal")
        if additive
        else F.try_divide(F.col(value), F.col("trend") * F.col("seasonal"))
    )
    return (
        attach(trended, seasonal, [*keys, "_phase"])
        .withColumn("residual", residual)
        .drop("_place", "_phase")
    )
