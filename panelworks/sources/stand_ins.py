"""Views over the test tables that play the parts of readings, buildings and weather."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.functions.calendar import floor_hour


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly readings: user as building, event type as meter, summed value as reading."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("building_id"), F.col("event_type").alias("meter"),
                 floor_hour(F.col("ts")).alias("timestamp"))
        .agg(F.sum("value").alias("meter_reading"))
    )


def buildings(spark: SparkSession, folder: str) -> DataFrame:
    """Building attributes: nation as site, segment as use, balance as size."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("building_id"),
        F.col("c_nationkey").alias("site_id"),
        F.col("c_mktsegment").alias("primary_use"),
        F.expr("nullif(greatest(c_acctbal, 0D), 0D)").alias("square_feet"),
        F.when(F.col("c_acctbal") >= 0, 1900 + F.col("c_custkey") % 100).alias("year_built"),
        (1 + F.col("c_custkey") % 12).alias("floor_count"),
    )


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly weather per site from the ``view`` events of its buildings."""
    views = table(spark, folder, "events").filter("event_type = 'view'")
    sites = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("site_id"))
    return (
        views.select("user_id", floor_hour(F.col("ts")).alias("timestamp"), "value",
                     F.get_json_object("props", "$.k").cast("int").alias("k"))
        .join(sites, "user_id")
        .groupBy("site_id", "timestamp")
        .agg((F.avg("k") * 3.6).alias("wind_direction"), (F.avg("value") / 5).alias("wind_speed"))
    )


def meter_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Dense hourly series, one per event type."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("meter"), floor_hour(F.col("ts")).alias("timestamp"))
        .agg(F.sum("value").alias("meter_reading"))
    )


def supplier_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Long daily history: supplier as building, return flag as meter, quantity as reading."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("building_id"), F.col("l_returnflag").alias("meter"),
        F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("meter_reading"),
    )


def supplier_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and day, with the summed quantity."""
    return (
        supplier_readings(spark, folder)
        .groupBy("building_id", "timestamp")
        .agg(F.sum("meter_reading").alias("meter_reading"))
    )


def zero_inflated(spark: SparkSession, folder: str) -> DataFrame:
    """A target with many zeros (the tax rate) and a made-up forecast with its zero logit."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("building_id"), F.col("l_returnflag").alias("meter"),
        F.col("l_linestatus").alias("part"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_tax").alias("actual"), F.col("l_discount").alias("predicted"),
        (1 - F.col("l_quantity") / 50).alias("zero_probability"),
        ((25 - F.col("l_quantity")) / 10).alias("zero_logit"),
        (F.col("l_linenumber") <= 5).alias("observed"),
    )
