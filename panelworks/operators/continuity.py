"""Gaps, contiguous runs, window targets, evaluable rows, forward fill and zero runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.calendar import HOUR, epoch_seconds
from panelworks.operators.ordering import SLICE_DAYS, row_positions, time_slice
from panelworks.scale import cut_lineage

# Numbered timestamps of one stretch of a series.
FILL_POSITIONS = 4096


def contiguous_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    step_seconds: int = HOUR,
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Mark the contiguous runs of each series.

    Two neighbouring rows belong to one run when they are exactly one step apart. Adds
    ``previous_ts``; ``is_gap`` (a previous row exists but is not one step away); ``segment``, the
    0-based run number; ``run_start``; and ``run_position``, the 0-based place in the run.

    Expects one row per series and timestamp. A series is cut into time slices, and only one summary
    row per slice is ordered across the series, so a long or hot series stays spread over tasks.
    """
    keys = list(keys)
    sec = F.col("_sec")
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_sec")
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, 0)
    placed = df.withColumns({"_sec": epoch_seconds(F.col(ts)), "_slice": time_slice(F.col(ts), slice_days)}).withColumns(
        {
            "_prev": F.lag(ts).over(in_slice),
            "_row": F.row_number().over(in_slice),
            "_cut": F.coalesce(sec - F.lag("_sec").over(in_slice) != step_seconds, F.lit(False)),
        }
    )
    # row number and timestamp grow along the series: their maximum so far is the latest run start
    local = placed.withColumns(
        {
            "_cuts": F.count_if("_cut").over(so_far),
            "_head_row": F.max(F.when(F.col("_cut"), F.col("_row"))).over(so_far),
            "_head_ts": F.max(F.when(F.col("_cut"), F.col(ts))).over(so_far),
        }
    )
    summary = local.groupBy(*keys, "_slice").agg(
        F.min("_sec").alias("_first"),
        F.max("_sec").alias("_last"),
        F.min(ts).alias("_first_ts"),
        F.max(ts).alias("_last_ts"),
        F.count("*").alias("_n"),
        F.max("_cuts").alias("_n_cuts"),
        F.max("_head_row").alias("_tail_row"),
        F.max("_head_ts").alias("_tail_ts"),
    )
    by_series = Window.partitionBy(*keys).orderBy("_slice")
    series_so_far = by_series.rowsBetween(Window.unboundedPreceding, 0)
    series_before = by_series.rowsBetween(Window.unboundedPreceding, -1)
    in_chain = Window.partitionBy(*keys, "_chain").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    joined = F.coalesce(F.col("_first") - F.lag("_last").over(by_series) == step_seconds, F.lit(False))
    linked = summary.withColumns({"_joined": joined, "_prev_last_ts": F.lag("_last_ts").over(by_series)})
    boundary_cut = F.col("_prev_last_ts").isNotNull() & ~F.col("_joined")
    # a slice opens a new chain when the run at its end starts inside it
    chained = linked.withColumn("_chain", F.count_if((F.col("_n_cuts") > 0) | ~F.col("_joined")).over(series_so_far))
    tails = chained.withColumns(
        {
            "_tail_rows": F.sum(F.col("_n") - F.coalesce(F.col("_tail_row") - 1, F.lit(0))).over(in_chain),
            "_tail_start": F.first(F.coalesce("_tail_ts", "_first_ts")).over(in_chain),
        }
    )
    cuts_before = F.coalesce(F.sum(F.col("_n_cuts") + boundary_cut.cast("long")).over(series_before), F.lit(0))
    slices = tails.select(
        *keys, "_slice", "_first_ts", "_prev_last_ts",
        boundary_cut.alias("_boundary_cut"),
        F.when(F.col("_joined"), F.lag("_tail_rows").over(by_series)).otherwise(0).alias("_carry_rows"),
        F.when(F.col("_joined"), F.lag("_tail_start").over(by_series)).alias("_carry_start"),
        (cuts_before + boundary_cut.cast("long")).alias("_segments_before"),
    )
    first_in_slice = F.col("_row") == 1
    in_first_run = F.col("_cuts") == 0
    return local.join(slices, [*keys, "_slice"], "left").select(
        *[F.col(c) for c in df.columns],
        F.when(first_in_slice, F.col("_prev_last_ts")).otherwise(F.col("_prev")).alias("previous_ts"),
        F.when(first_in_slice, F.col("_boundary_cut")).otherwise(F.col("_cut")).alias("is_gap"),
        (F.col("_segments_before") + F.col("_cuts")).alias("segment"),
        F.when(in_first_run, F.coalesce("_carry_start", "_first_ts")).otherwise(F.col("_head_ts")).alias("run_start"),
        F.when(in_first_run, F.col("_row") - 1 + F.col("_carry_rows"))
        .otherwise(F.col("_row") - F.col("_head_row"))
        .alias("run_position"),
    )


def segments(df: DataFrame, keys: Sequence[str], ts: str, **options) -> DataFrame:
    """One row per contiguous run: number, first and last timestamp, length."""
    runs = contiguous_runs(df.select(*keys, ts), keys, ts, **options)
    return runs.groupBy(*keys, "segment").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("row_count")
    )


def is_window_target(window: int, stride: int = 1) -> Column:
    """True on the row predicted from the ``window`` rows before it, for starts 0, stride, 2 stride."""
    place = F.col("run_position")
    return (place >= window) & ((place - window) % stride == 0)


def window_targets(
    df: DataFrame, keys: Sequence[str], ts: str, window: int, stride: int = 1, **options
) -> DataFrame:
    """Rows that are the target of a full sequence window."""
    return contiguous_runs(df, keys, ts, **options).filter(is_window_target(window, stride))


def panel_window_targets(
    panel: DataFrame, ts: str, observed: str, window: int, keys: Sequence[str] = (), stride: int = 1, **options
) -> DataFrame:
    """Target hours of panel windows: a full window of panel hours before it and an observed node in it."""
    hours = panel.groupBy(*keys, ts).agg(F.max(F.col(observed).cast("int")).alias("any_observed"))
    return window_targets(hours, keys, ts, window, stride, **options).filter("any_observed = 1")


def evaluable_rows(
    df: DataFrame, keys: Sequence[str], ts: str, window: int, **options
) -> DataFrame:
    """Flag rows whose run, counted through earlier splits, has ``window`` rows before them."""
    return contiguous_runs(df, keys, ts, **options).withColumn("evaluable", F.col("run_position") >= window)


def evaluation_counts(evaluable: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Evaluated and skipped rows per group."""
    return evaluable.groupBy(*groups).agg(
        F.count_if("evaluable").alias("evaluated_row_count"),
        F.count_if(~F.col("evaluable")).alias("skipped_row_count"),
    )


def forward_fill(
    panel: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    observed: str,
    initial: object = 0.0,
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Carry the last observed row of each series forward, all columns together.

    Before the first observation the columns take ``initial``. A null inside an observed row is
    carried as it is. Put the split among ``keys`` so that no state crosses splits.
    """
    keys = list(keys)
    row = F.when(F.col(observed), F.struct(*columns))
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    sliced = panel.withColumn("_slice", time_slice(F.col(ts), slice_days))
    last_of_slice = sliced.groupBy(*keys, "_slice").agg(F.max_by(row, F.when(F.col(observed), F.col(ts))).alias("_row"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_of_slice.select(*keys, "_slice", F.last("_row", ignorenulls=True).over(earlier).alias("_carried"))
    filled = (
        sliced.withColumn("_local", F.last(row, ignorenulls=True).over(in_slice))
        .join(carried, [*keys, "_slice"], "left")
        .withColumn("_filled", F.coalesce("_local", "_carried"))
    )
    values = {
        name: F.when(F.col("_filled").isNull(), F.lit(initial)).otherwise(F.col(f"_filled.{name}")) for name in columns
    }
    return filled.withColumns(values).select(*panel.columns)


def filled_panel(
    readings: DataFrame,
    nodes: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    entity: str = "building_id",
    ts: str = "timestamp",
    initial: object = 0.0,
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Every node at every timestamp of its keys, with the last observed columns carried forward and ``observed``.

    The same as ``complete_panel`` and ``forward_fill`` in one, but only observed rows are ordered: timestamps are numbered,
    each observed row is repeated for the numbers up to the node's next one, and a row at -1 stands for ``initial``. Rows of
    a node are cut into stretches of FILL_POSITIONS numbers; only the first number of each is ordered over the whole series.
    """
    keys = list(keys)
    times = row_positions(readings.select(*keys, ts).distinct(), keys, ts, "_position", slice_days=slice_days)
    times = cut_lineage(times, "panel-times")
    totals = times.groupBy(*keys).agg(F.count("*").alias("_total"))
    observed = readings.join(nodes, [*keys, entity], "left_semi").join(times, [*keys, ts]).select(*keys, entity, *columns, "_position")
    kinds = dict(observed.dtypes)
    before = nodes.select(*keys, entity, *[F.lit(initial).cast(kinds[c]).alias(c) for c in columns], F.lit(-1).cast(kinds["_position"]).alias("_position"))
    rows = observed.unionByName(before.distinct()).withColumn("_part", F.floor((F.col("_position") + 1) / FILL_POSITIONS))
    inside = Window.partitionBy(*keys, entity, "_part").orderBy("_position")
    parts = Window.partitionBy(*keys, entity).orderBy("_part")
    later = rows.groupBy(*keys, entity, "_part").agg(F.min("_position").alias("_first")).select(*keys, entity, "_part", F.lead("_first").over(parts).alias("_later"))
    ended = rows.withColumn("_next", F.lead("_position").over(inside)).join(later, [*keys, entity, "_part"])
    ended = ended.join(totals, keys) if keys else ended.withColumn("_total", totals.scalar())
    last = F.coalesce("_next", "_later", "_total") - 1
    first = F.greatest("_position", F.lit(0))
    cells = ended.filter(first <= last).select(*keys, entity, *columns, F.col("_position").alias("_of"), F.explode(F.sequence(first, last)).alias("_position"))
    return cells.join(times, [*keys, "_position"]).select(*keys, entity, ts, *columns, (F.col("_of") == F.col("_position")).alias("observed"))


def zero_runs(
    df: DataFrame, keys: Sequence[str], ts: str, target: str, step_seconds: int = HOUR, **options
) -> DataFrame:
    """One row per run of consecutive zero readings."""
    zeros = df.filter(F.col(target) == 0).select(*keys, ts)
    return segments(zeros, keys, ts, step_seconds=step_seconds, **options)


def longest_zero_run(df: DataFrame, keys: Sequence[str], ts: str, target: str, **options) -> DataFrame:
    """Number of zero runs and the length of the longest, per series."""
    return (
        zero_runs(df, keys, ts, target, **options)
        .groupBy(*keys)
        .agg(F.count("*").alias("run_count"), F.max("row_count").alias("longest_run"))
    )


def history_before_splits(
    df: DataFrame, keys: Sequence[str], ts: str, window: int, first_split: str = "train", **options
) -> DataFrame:
    """Contiguous rows, at most ``window``, that lie directly before each later split of a series.

    The rows may come from several earlier splits; the run through all of them is what counts.
    """
    keys = list(keys)
    runs = contiguous_runs(df.select(*keys, ts, "split"), keys, ts, **options)
    first = runs.filter(F.col("split") != first_split).groupBy(*keys, "split").agg(
        F.min_by(F.struct(ts, "run_position", "previous_ts"), ts).alias("_first")
    )
    place = F.col("_first.run_position")
    return first.select(
        *keys, "split", F.col(f"_first.{ts}").alias("first_ts"),
        F.least(place, F.lit(window)).alias("history_rows"),
        F.when(place > 0, F.col("_first.previous_ts")).alias("history_end"),
    )
