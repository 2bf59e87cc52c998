"""Queries over time splits, gaps, windows, forward fill, rolling statistics and zero runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded, tidy
from panelworks.catalogue.sql import (
    METER_HOURS, READINGS, SUPPLIER_DAYS, ZERO_INFLATED, runs_of, split_of, with_,
)
from panelworks.functions.calendar import DAY
from panelworks.operators import continuity, enrich, splits, windows
from panelworks.scale import scratch_path
from panelworks.sources import stand_ins, tables

YEAR_SLICE = 384


@query("time_split", with_(READINGS, split_of("readings", ["meter"]), """
SELECT building_id, meter, timestamp, split FROM prepared"""))
def time_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.readings(spark, folder).select("building_id", "meter", "timestamp")
    return splits.time_split(rows, "timestamp", ["meter"])


@query("time_split_daily", with_(SUPPLIER_DAYS, split_of("supplier_days", []), """
SELECT split, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS row_count FROM prepared GROUP BY 1"""))
def time_split_daily(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.supplier_days(spark, folder), "timestamp", slice_days=YEAR_SLICE)
    return splits.split_summary(split, "timestamp")


BLOCKS = " + ".join(f"CASE WHEN place >= round_even(n * {b} / 10.0, 0) THEN 1 ELSE 0 END" for b in range(1, 10))


@query("time_blocks", with_(METER_HOURS, split_of("meter_hours", ["meter"]), f"""
blocked AS (SELECT meter, timestamp, {BLOCKS} AS block FROM prepared_placed)""", """
SELECT meter, block, CASE WHEN block < 8 THEN 'train' WHEN block < 9 THEN 'valid' ELSE 'test' END AS split,
  min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS times FROM blocked GROUP BY 1, 2, 3"""))
def time_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = splits.time_blocks(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"])
    return blocks.groupBy("meter", "block", splits.block_split(F.col("block")).alias("split")).agg(
        F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("times")
    )


@query("gap_detection", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), """
SELECT meter, timestamp, previous_ts FROM runs WHERE is_gap"""))
def gap_detection(spark: SparkSession, folder: str) -> DataFrame:
    runs = continuity.contiguous_runs(stand_ins.meter_hours(spark, folder), ["meter"], "timestamp")
    return runs.filter("is_gap").select("meter", "timestamp", "previous_ts")


@query("contiguous_segments", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), """
SELECT meter, segment, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS row_count FROM runs GROUP BY 1, 2"""))
def contiguous_segments(spark: SparkSession, folder: str) -> DataFrame:
    return continuity.segments(stand_ins.meter_hours(spark, folder), ["meter"], "timestamp", slice_days=8)


@query("contiguous_days", with_(SUPPLIER_DAYS, runs_of("supplier_days", ["building_id"], "1 day"), """
SELECT building_id, timestamp, is_gap, segment, run_start, run_position FROM runs"""))
def contiguous_days(spark: SparkSession, folder: str) -> DataFrame:
    runs = continuity.contiguous_runs(
        stand_ins.supplier_days(spark, folder), ["building_id"], "timestamp", step_seconds=DAY, slice_days=YEAR_SLICE
    )
    return runs.select("building_id", "timestamp", "is_gap", "segment", "run_start", "run_position")


@query("window_targets", with_(METER_HOURS, split_of("meter_hours", ["meter"]), runs_of("prepared", ["meter", "split"]), """
SELECT meter, split, timestamp, run_start FROM runs WHERE run_position >= 6"""))
def window_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"])
    return continuity.window_targets(rows, ["meter", "split"], "timestamp", 6).select("meter", "split", "timestamp", "run_start")


@query("window_targets_stride_4", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), """
SELECT meter, timestamp, run_position FROM runs WHERE run_position >= 6 AND (run_position - 6) % 4 = 0"""))
def window_targets_stride_4(spark: SparkSession, folder: str) -> DataFrame:
    found = continuity.window_targets(stand_ins.meter_hours(spark, folder), ["meter"], "timestamp", 6, 4)
    return found.select("meter", "timestamp", "run_position")


@query("panel_window_targets", with_(READINGS, split_of("readings", ["meter"]), """
nodes AS (SELECT DISTINCT meter, building_id FROM prepared WHERE split = 'train')""", """
hours AS (SELECT meter, timestamp, max(CAST(n.building_id IS NOT NULL AS INTEGER)) AS any_observed
  FROM prepared LEFT JOIN nodes n USING (meter, building_id) GROUP BY 1, 2)""", runs_of("hours", ["meter"]), """
SELECT meter, timestamp, run_position FROM runs WHERE run_position >= 6 AND any_observed = 1"""))
def panel_window_targets(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    nodes = rows.filter("split = 'train'").select("meter", "building_id").distinct()
    panel = enrich.complete_panel(rows, nodes, keys=["meter"])
    return continuity.panel_window_targets(panel, "timestamp", "observed", 6, ["meter"]).select(
        "meter", "timestamp", "run_position"
    )


EVALUABLE = with_(METER_HOURS, split_of("meter_hours", ["meter"]), runs_of("prepared", ["meter"]), """
SELECT meter, split, count(*) FILTER (WHERE run_position >= 24) AS evaluated_row_count,
  count(*) FILTER (WHERE run_position < 24) AS skipped_row_count FROM runs GROUP BY 1, 2""")


@query("evaluable_rows", EVALUABLE)
def evaluable_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"])
    flagged = continuity.evaluable_rows(rows, ["meter"], "timestamp", 24)
    return continuity.evaluation_counts(flagged, ["meter", "split"])


@query("panel_forward_fill", with_(SUPPLIER_DAYS, split_of("supplier_days", []), """
panel AS (SELECT n.building_id, t.split, t.timestamp, p.meter_reading FROM (SELECT DISTINCT split, timestamp FROM prepared) t
  CROSS JOIN (SELECT DISTINCT building_id FROM prepared) n
  LEFT JOIN prepared p ON p.building_id = n.building_id AND p.timestamp = t.timestamp)""", """
filled AS (SELECT building_id, split, timestamp, meter_reading IS NOT NULL AS observed,
  coalesce(last_value(meter_reading IGNORE NULLS) OVER w, 0) AS filled,
  coalesce(last_value(CASE WHEN meter_reading IS NOT NULL THEN day(timestamp) END IGNORE NULLS) OVER w, 0) AS filled_day
  FROM panel WINDOW w AS (PARTITION BY building_id, split ORDER BY timestamp))""", """
SELECT building_id, split, month(timestamp) AS month, count(*) AS cells, count(*) FILTER (WHERE observed) AS observed,
  CAST(sum(filled) AS DOUBLE) AS filled, CAST(sum(filled_day) AS BIGINT) AS filled_day FROM filled GROUP BY 1, 2, 3"""))
def panel_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.supplier_days(spark, folder), "timestamp", slice_days=YEAR_SLICE)
    rows = rows.withColumn("filled_day", F.dayofmonth("timestamp")).withColumnRenamed("meter_reading", "filled")
    nodes = rows.select("building_id").distinct()
    spread = nodes.withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits.SPLITS])))
    filled = continuity.filled_panel(rows, spread, ["filled", "filled_day"], ["split"], initial=0, slice_days=YEAR_SLICE)
    return filled.groupBy("building_id", "split", F.month("timestamp").cast("bigint").alias("month")).agg(
        F.count("*").alias("cells"), F.count_if("observed").alias("observed"), F.sum("filled").alias("filled"),
        F.sum("filled_day").alias("filled_day"),
    )


@query("sequence_windows", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), """
targets AS (SELECT meter, timestamp, round(meter_reading, 6) AS next_target FROM runs WHERE run_position >= 6)""", """
SELECT t.meter, t.timestamp, CAST(6 - date_diff('hour', h.timestamp, t.timestamp) AS INTEGER) AS place,
  round(h.meter_reading, 6) AS history, next_target
FROM targets t JOIN meter_hours h ON h.meter = t.meter AND h.timestamp < t.timestamp AND h.timestamp >= t.timestamp - INTERVAL '6 hours'"""))
def sequence_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.meter_hours(spark, folder)
    found = windows.sequence_windows(rows, ["meter"], "timestamp", ["timestamp", "meter_reading"], "meter_reading", 6)
    each = found.select("meter", "timestamp", "next_target", F.posexplode("sequence").alias("place", "row"))
    return rounded(each.select("meter", "timestamp", "place", F.col("row.meter_reading").alias("history"), "next_target"))


@query("sequence_windows_stride_4", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), """
listed AS (SELECT meter, timestamp, run_position,
  first_value(timestamp) OVER w AS first_ts, sum(meter_reading) OVER w AS total, count(*) OVER w AS steps FROM runs
  WINDOW w AS (PARTITION BY meter ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""", """
SELECT meter, timestamp, first_ts, round(total, 6) AS total, CAST(steps AS INTEGER) AS steps FROM listed
WHERE run_position >= 24 AND (run_position - 24) % 4 = 0"""))
def sequence_windows_stride_4(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.meter_hours(spark, folder)
    found = windows.sequence_windows(rows, ["meter"], "timestamp", ["timestamp", "meter_reading"], "meter_reading", 24, 4)
    total = F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + s["meter_reading"])
    return found.select(
        "meter", "timestamp", F.col("sequence")[0]["timestamp"].alias("first_ts"), tidy(total).alias("total"),
        F.size("sequence").alias("steps"),
    )


LAGS = ", ".join(f"round(lag(meter_reading, {k}) OVER w, 6) AS lag_{k}" for k in (1, 2, 3, 4, 5, 6))


@query("lag_features", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), f"""
lagged AS (SELECT meter, timestamp, run_position, round(meter_reading, 6) AS meter_reading, {LAGS} FROM runs
  WINDOW w AS (PARTITION BY meter ORDER BY timestamp))""", """
SELECT * EXCLUDE (run_position) FROM lagged WHERE run_position >= 6"""))
def lag_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.meter_hours(spark, folder)
    return rounded(windows.lag_features(rows, ["meter"], "timestamp", "meter_reading", 6, slice_days=8))


@query("rolling_statistics", with_(SUPPLIER_DAYS, """
totals AS (SELECT timestamp, sum(meter_reading) AS total FROM supplier_days GROUP BY 1)""", """
SELECT timestamp, total, CASE WHEN count(*) OVER w = 12 THEN round(avg(total) OVER w, 6) END AS rolling_mean,
  CASE WHEN count(*) OVER w = 12 THEN round(stddev_samp(total) OVER w, 6) END AS rolling_std
FROM totals WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def rolling_statistics(spark: SparkSession, folder: str) -> DataFrame:
    totals = stand_ins.supplier_days(spark, folder).groupBy("timestamp").agg(F.sum("meter_reading").alias("total"))
    return rounded(windows.rolling_statistics(totals, "timestamp", "total", 12, slice_days=YEAR_SLICE))


@query("rolling_std_10", with_(READINGS, """
means AS (SELECT timestamp, avg(meter_reading) AS mean FROM readings GROUP BY 1)""", """
SELECT timestamp, CASE WHEN count(*) OVER w = 10 THEN round(stddev_samp(mean) OVER w, 6) END AS rolling_std
FROM means WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def rolling_std_10(spark: SparkSession, folder: str) -> DataFrame:
    means = stand_ins.readings(spark, folder).groupBy("timestamp").agg(F.avg("meter_reading").alias("mean"))
    return rounded(windows.rolling_statistics(means, "timestamp", "mean", 10).select("timestamp", "rolling_std"))


def _seasonal_sql(combine: str, centre: str) -> str:
    detrended = f"total {combine} trend"
    residual = "total - trend - seasonal" if combine == "-" else "total / (trend * seasonal)"
    return with_(SUPPLIER_DAYS, """
totals AS (SELECT timestamp, CAST(sum(meter_reading) AS DOUBLE) AS total, row_number() OVER (ORDER BY timestamp) - 1 AS place
  FROM supplier_days GROUP BY 1)""", """
trended AS (SELECT *, CASE WHEN count(*) OVER w = 13 THEN (sum(total) OVER w - (lag(total, 6) OVER o + lead(total, 6) OVER o) / 2) / 12 END AS trend
  FROM totals WINDOW w AS (ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), o AS (ORDER BY timestamp))""", f"""
means AS (SELECT place % 12 AS phase, avg({detrended}) AS mean FROM trended GROUP BY 1)""", f"""
seasons AS (SELECT phase, mean {centre} (SELECT avg(mean) FROM means) AS seasonal FROM means)""", f"""
SELECT timestamp, total, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round({residual}, 6) AS residual
FROM trended JOIN seasons ON phase = place % 12""")


def _daily_total(spark: SparkSession, folder: str) -> DataFrame:
    return stand_ins.supplier_days(spark, folder).groupBy("timestamp").agg(F.sum("meter_reading").alias("total"))


@query("seasonal_additive", _seasonal_sql("-", "-"))
def seasonal_additive(spark: SparkSession, folder: str) -> DataFrame:
    parts = windows.seasonal_decomposition(_daily_total(spark, folder), "timestamp", "total", 12, slice_days=YEAR_SLICE)
    return rounded(parts)


@query("seasonal_multiplicative", _seasonal_sql("/", "/"))
def seasonal_multiplicative(spark: SparkSession, folder: str) -> DataFrame:
    parts = windows.seasonal_decomposition(
        _daily_total(spark, folder), "timestamp", "total", 12, "multiplicative", slice_days=YEAR_SLICE
    )
    return rounded(parts)


WEEK = 168
DAILY_TOTAL = """
daily_total AS (SELECT 'all' AS meter, timestamp, sum(meter_reading) AS total FROM supplier_days GROUP BY 2)"""


@query("window_targets_168", with_(SUPPLIER_DAYS, DAILY_TOTAL, runs_of("daily_total", ["meter"], "1 day"), f"""
SELECT timestamp, run_position FROM runs WHERE run_position >= {WEEK}"""))
def window_targets_168(spark: SparkSession, folder: str) -> DataFrame:
    rows = _daily_total(spark, folder)
    found = continuity.window_targets(rows, [], "timestamp", WEEK, step_seconds=DAY, slice_days=YEAR_SLICE)
    return found.select("timestamp", "run_position")


@query("sequence_windows_168", with_(SUPPLIER_DAYS, DAILY_TOTAL, runs_of("daily_total", ["meter"], "1 day"), f"""
listed AS (SELECT timestamp, run_position, total AS next_target,
  first_value(timestamp) OVER w AS first_ts, sum(total) OVER w AS history, count(*) OVER w AS steps FROM runs
  WINDOW w AS (PARTITION BY meter ORDER BY timestamp ROWS BETWEEN {WEEK} PRECEDING AND 1 PRECEDING))""", f"""
SELECT timestamp, first_ts, round(history, 4) AS history, CAST(steps AS INTEGER) AS steps, round(next_target, 4) AS next_target
FROM listed WHERE run_position >= {WEEK}"""))
def sequence_windows_168(spark: SparkSession, folder: str) -> DataFrame:
    rows = _daily_total(spark, folder)
    found = windows.sequence_windows(rows, [], "timestamp", ["timestamp", "total"], "total", WEEK, step_seconds=DAY, slice_days=YEAR_SLICE)
    history = F.aggregate("sequence", F.lit(0.0), lambda acc, s: acc + s["total"])
    return found.select(
        "timestamp", F.col("sequence")[0]["timestamp"].alias("first_ts"), tidy(history, 4).alias("history"),
        F.size("sequence").alias("steps"), tidy(F.col("next_target"), 4).alias("next_target"),
    )


WEEK_LAGS = ", ".join(f"round(lag(total, {k}) OVER w, 4) AS lag_{k}" for k in range(1, WEEK + 1))


@query("lag_features_168", with_(SUPPLIER_DAYS, DAILY_TOTAL, runs_of("daily_total", ["meter"], "1 day"), f"""
lagged AS (SELECT timestamp, run_position, round(total, 4) AS total, {WEEK_LAGS} FROM runs WINDOW w AS (PARTITION BY meter ORDER BY timestamp))""", f"""
SELECT * EXCLUDE (run_position) FROM lagged WHERE run_position >= {WEEK}"""))
def lag_features_168(spark: SparkSession, folder: str) -> DataFrame:
    found = windows.lag_features(_daily_total(spark, folder), [], "timestamp", "total", WEEK, step_seconds=DAY, slice_days=YEAR_SLICE)
    return rounded(found, 4)


@query("split_contract", with_(METER_HOURS, split_of("meter_hours", ["meter"]), """
SELECT split, CAST(ascii(meter) AS DOUBLE) AS meter, count(*) AS row_count, round(sum(meter_reading), 4) AS reading_sum,
  min(timestamp) AS first_timestamp FROM prepared GROUP BY 1, 2"""))
def split_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Three split tables written as CSV, read back as one after the check of their columns; features are numbers."""
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"]).withColumn("meter", F.ascii("meter"))
    base = scratch_path(spark, "splits")
    for name in splits.SPLITS:
        rows.filter(F.col("split") == name).drop("split").write.option("header", True).csv(f"{base}/{name}")
    read = tables.read_splits(spark, *[f"{base}/{name}" for name in splits.SPLITS])
    facts = F.count("*").alias("row_count"), F.sum("meter_reading").alias("reading_sum"), F.min("timestamp").alias("first_timestamp")
    return rounded(read.groupBy("split", "meter").agg(*facts), 4)


@query("zero_runs", with_(ZERO_INFLATED, """
days AS (SELECT building_id, timestamp, min(actual) AS meter_reading FROM zero_inflated GROUP BY 1, 2)""", """
zeros AS (SELECT building_id, timestamp FROM days WHERE meter_reading = 0)""", runs_of("zeros", ["building_id"], "1 day"), """
SELECT building_id, count(*) AS run_count, max(row_count) AS longest_run FROM (
  SELECT building_id, segment, count(*) AS row_count FROM runs GROUP BY 1, 2) GROUP BY 1"""))
def zero_runs(spark: SparkSession, folder: str) -> DataFrame:
    days = (
        stand_ins.zero_inflated(spark, folder).groupBy("building_id", "timestamp").agg(F.min("actual").alias("meter_reading"))
    )
    return continuity.longest_zero_run(
        days, ["building_id"], "timestamp", "meter_reading", step_seconds=DAY, slice_days=YEAR_SLICE
    )
