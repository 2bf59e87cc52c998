"""Queries over dimension joins, node lookups, panel completion and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded
from panelworks.catalogue.sql import (
    BUILDINGS, METER_HOURS, READINGS, SUPPLIER_DAYS, WEATHER, runs_of, split_of, with_,
)
from panelworks.operators import continuity, enrich, splits
from panelworks.plans.preparation import build_features
from panelworks.scale import cut_lineage
from panelworks.sources import stand_ins


@query("building_join", with_(READINGS, BUILDINGS, """
SELECT building_id, meter, timestamp, round(meter_reading, 6) AS meter_reading, site_id, primary_use,
  round(square_feet, 6) AS square_feet, year_built, floor_count FROM readings LEFT JOIN buildings USING (building_id)"""))
def building_join(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(enrich.join_buildings(stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder)))


@query("weather_join", with_(READINGS, BUILDINGS, WEATHER, """
SELECT r.building_id, r.meter, r.timestamp, site_id, round(wind_direction, 6) AS wind_direction, round(wind_speed, 6) AS wind_speed
FROM readings r LEFT JOIN buildings b USING (building_id) LEFT JOIN weather w USING (site_id, timestamp)"""))
def weather_join(spark: SparkSession, folder: str) -> DataFrame:
    located = enrich.join_buildings(stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder))
    wide = enrich.join_weather(located, stand_ins.weather(spark, folder))
    return rounded(wide.select("building_id", "meter", "timestamp", "site_id", "wind_direction", "wind_speed"))


@query("feature_table", with_(READINGS, BUILDINGS, WEATHER, """
coded AS (SELECT b.*, code FROM buildings b LEFT JOIN (SELECT primary_use, row_number() OVER (ORDER BY primary_use) - 1 AS code
  FROM (SELECT DISTINCT primary_use FROM buildings)) USING (primary_use))""", """
SELECT building_id, meter, timestamp, round(meter_reading, 6) AS meter_reading, site_id, code AS primary_use,
  2016 - year_built AS age, CAST(trunc(wind_direction / 22.5) AS INTEGER) % 16 AS wind_direction,
  CAST(hour(timestamp) AS INTEGER) AS hour_datetime, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_week,
  CAST(square_feet IS NULL AS INTEGER) AS square_feet_missing, CAST(year_built IS NULL AS INTEGER) AS age_missing,
  CAST(wind_speed IS NULL AS INTEGER) AS beaufort_scale_missing
FROM readings LEFT JOIN coded USING (building_id) LEFT JOIN weather USING (site_id, timestamp)"""))
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    wide = build_features(
        stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder), stand_ins.weather(spark, folder),
        flagged=["square_feet", "age", "beaufort_scale"],
    )
    return rounded(
        wide.select(
            "building_id", "meter", "timestamp", "meter_reading", "site_id", F.col("primary_use").cast("bigint").alias("primary_use"),
            "age", "wind_direction", "hour_datetime", "day_week", "square_feet_missing", "age_missing", "beaufort_scale_missing",
        )
    )


@query("dictionary_join", """
WITH codes AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, code FROM orders LEFT JOIN codes USING (o_orderpriority)""")
def dictionary_join(spark: SparkSession, folder: str) -> DataFrame:
    orders = stand_ins.table(spark, folder, "orders")
    codes = enrich.value_codes(orders, "o_orderpriority")
    return orders.join(codes, "o_orderpriority", "left").select("o_orderkey", F.col("code").cast("bigint").alias("code"))


@query("node_reindex", with_(BUILDINGS, """
nodes AS (SELECT DISTINCT o_custkey AS building_id FROM orders UNION SELECT l_partkey FROM lineitem)""", """
SELECT building_id, site_id, primary_use, floor_count FROM nodes LEFT JOIN buildings USING (building_id)"""))
def node_reindex(spark: SparkSession, folder: str) -> DataFrame:
    buyers = stand_ins.table(spark, folder, "orders").select(F.col("o_custkey").alias("building_id"))
    parts = stand_ins.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("building_id"))
    nodes = buyers.union(parts).distinct()
    found = enrich.reindex(nodes, stand_ins.buildings(spark, folder))
    return found.select("building_id", "site_id", "primary_use", "floor_count")


# Order lines by shipping day: an order is known if one of its lines lies in the training split.
SHIPMENTS = """shipments AS (SELECT l_orderkey AS building_id, l_linenumber AS line, l_shipdate AS timestamp FROM lineitem)"""


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("building_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("timestamp")
    )
    return splits.time_split(rows, "timestamp", slice_days=384)


@query("node_lookup", with_(SHIPMENTS, split_of("shipments", []), """
nodes AS (SELECT building_id, row_number() OVER (ORDER BY building_id) - 1 AS node FROM (SELECT DISTINCT building_id FROM prepared WHERE split = 'train'))""", """
SELECT building_id, line, timestamp, coalesce(node, -1) AS node FROM prepared LEFT JOIN nodes USING (building_id)"""))
def node_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = shipments(spark, folder)
    located = enrich.locate_nodes(rows, rows.filter("split = 'train'"))
    return located.select("building_id", "line", "timestamp", F.col("node").cast("bigint").alias("node"))


@query("unknown_node_counts", with_(SHIPMENTS, split_of("shipments", []), """
nodes AS (SELECT DISTINCT building_id FROM prepared WHERE split = 'train')""", """
SELECT split, count(*) AS raw_row_count, count(n.building_id) AS included_row_count,
  count(*) - count(n.building_id) AS unknown_node_row_count
FROM prepared p LEFT JOIN nodes n USING (building_id) GROUP BY 1"""))
def unknown_node_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = shipments(spark, folder)
    return enrich.unknown_node_counts(enrich.locate_nodes(rows, rows.filter("split = 'train'")), ["split"])


@query("unseen_entities", with_(SHIPMENTS, split_of("shipments", []), """
SELECT DISTINCT building_id FROM prepared WHERE split = 'test' AND building_id NOT IN (SELECT building_id FROM prepared WHERE split <> 'test')"""))
def unseen_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = shipments(spark, folder)
    return enrich.unseen_entities(rows.filter("split = 'test'"), rows.filter("split <> 'test'"))


@query("panel_grid", with_(SUPPLIER_DAYS, """
nodes AS (SELECT DISTINCT building_id FROM supplier_days)""", """
SELECT month(timestamp) + year(timestamp) * 100 AS month, count(*) AS cells, count(meter_reading) AS observed,
  CAST(sum(meter_reading) AS DOUBLE) AS total
FROM (SELECT DISTINCT timestamp FROM supplier_days) CROSS JOIN nodes LEFT JOIN supplier_days USING (timestamp, building_id) GROUP BY 1"""))
def panel_grid(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.supplier_days(spark, folder)
    nodes = rows.select("building_id").distinct()
    panel = enrich.complete_panel(rows, nodes, slice_days=384)
    month = (F.month("timestamp") + F.year("timestamp") * 100).cast("bigint")
    return panel.groupBy(month.alias("month")).agg(
        F.count("*").alias("cells"), F.count_if("observed").alias("observed"), F.sum("meter_reading").alias("total")
    )


@query("panel_gaps", with_(SUPPLIER_DAYS, """
times AS (SELECT timestamp, row_number() OVER (ORDER BY timestamp) AS place FROM (SELECT DISTINCT timestamp FROM supplier_days))""", """
missing AS (SELECT building_id, timestamp, place, place - row_number() OVER (PARTITION BY building_id ORDER BY place) AS island
  FROM times CROSS JOIN (SELECT DISTINCT building_id FROM supplier_days) ANTI JOIN supplier_days USING (building_id, timestamp))""", """
SELECT building_id, min(timestamp) AS first_missing, max(timestamp) AS last_missing, count(*) AS cells FROM missing GROUP BY building_id, island"""))
def panel_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut_lineage(stand_ins.supplier_days(spark, folder), "days")
    gaps = enrich.gap_intervals(rows, rows.select("building_id"), slice_days=384)
    return gaps.withColumn("cells", F.col("cells").cast("bigint"))


@query("history_stitch", with_(METER_HOURS, split_of("meter_hours", ["meter"]), runs_of("prepared", ["meter"]), """
first AS (SELECT meter, split, min(timestamp) AS first_ts FROM runs WHERE split <> 'train' GROUP BY 1, 2)""", """
SELECT meter, f.split, first_ts, least(run_position, 24) AS history_rows,
  CASE WHEN run_position > 0 THEN previous_ts END AS history_end
FROM first f JOIN runs r USING (meter) WHERE r.timestamp = f.first_ts"""))
def history_stitch(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"])
    return continuity.history_before_splits(rows, ["meter"], "timestamp", window=24)
