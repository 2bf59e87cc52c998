"""Queries that run as Structured Streaming jobs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded
from panelworks.catalogue.sql import METER_HOURS, runs_of, with_
from panelworks.scale import scratch_path
from panelworks.sources import stand_ins
from panelworks.streaming.continuity_state import continuity_stream, placed
from panelworks.streaming.daily_profile import daily_profile, read_file_stream, run_to_table, write_in_order

# Time slices, and so batches, of a stream: files arrive slice by slice, and the stream goes on where it stopped.
SLICES = 4


@query("streaming_daily_profile", """
SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS row_count, min(value) AS reading_min, max(value) AS reading_max,
  round(sum(value), 4) AS reading_sum FROM events GROUP BY 1, 2""")
def streaming_daily_profile(spark: SparkSession, folder: str) -> DataFrame:
    events = stand_ins.table(spark, folder, "events")
    folder = scratch_path(spark, "daily-profile")
    for path in write_in_order(events, "ts", SLICES, "events"):
        profile = daily_profile(read_file_stream(spark, path, "*.parquet", events.schema), "ts", "value", ["event_type"])
        current = run_to_table(profile, "daily-profile", "update", folder, ["date", "event_type"])
    return rounded(current, 4)


@query("streaming_continuity", with_(METER_HOURS, runs_of("meter_hours", ["meter"]), """
SELECT meter, timestamp, run_position, run_position >= 24 AS evaluable FROM runs"""))
def streaming_continuity(spark: SparkSession, folder: str) -> DataFrame:
    hours = stand_ins.meter_hours(spark, folder)
    folder = scratch_path(spark, "continuity")
    for path in write_in_order(hours, "timestamp", SLICES, "meter-hours"):
        stream = read_file_stream(spark, path, "*.parquet", hours.schema)
        rows = run_to_table(continuity_stream(stream, ["meter"], "timestamp", 24), "continuity", "append", folder)
    return placed(rows)
