"""Queries over sources, screening, casts and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded, tidy
from panelworks.catalogue.sql import (
    BUILDINGS, METER_HOURS, READINGS, SUPPLIER_READINGS, WEATHER, ZERO_INFLATED, ranges_of, split_of, with_,
)
from panelworks.functions import scaling
from panelworks.functions.bins import METER_LABELS, beaufort_number, compass_sector, relabel
from panelworks.functions.calendar import calendar_columns, floor_day, hours_between
from panelworks.operators import enrich, screening, splits, summaries
from panelworks.scale import scratch_path
from panelworks.sources import stand_ins, tables

# Users of the test tables that play the screened-out buildings.
EXCLUDED = (3, 8, 11, 14, 46, 89)
EXCLUDED_SQL = ", ".join(str(i) for i in EXCLUDED)


@query("sample_rows", with_(READINGS, """
SELECT building_id, meter, timestamp, round(meter_reading, 6) AS meter_reading FROM readings
ORDER BY timestamp, building_id, meter LIMIT 20"""))
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.sample_rows(stand_ins.readings(spark, folder), ["timestamp", "building_id", "meter"], 20)
    return rounded(rows)


@query("snapshot_reload", with_(READINGS, split_of("readings", ["meter"]), """
SELECT split, meter, count(*) AS row_count, round(sum(meter_reading), 4) AS total FROM prepared GROUP BY 1, 2"""))
def snapshot_reload(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    path = scratch_path(spark, "snapshot")
    again = tables.reload_table(split, path, ["split"])
    return rounded(
        again.groupBy("split", "meter").agg(F.count("*").alias("row_count"), F.sum("meter_reading").alias("total")), 4
    )


@query("json_summary_reload", with_(READINGS, split_of("readings", ["meter"]), """
SELECT meter, split, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS row_count
FROM prepared GROUP BY 1, 2"""))
def json_summary_reload(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    summary = splits.split_summary(split, "timestamp", ["meter"])
    path = scratch_path(spark, "summary")
    tables.write_json(summary, path)
    return tables.read_json_summary(spark, path, summary.schema)


@query("csv_reload", with_(BUILDINGS, """
SELECT site_id, count(*) AS building_count, round(sum(square_feet), 4) AS square_feet, count(year_built) AS dated
FROM buildings GROUP BY 1"""))
def csv_reload(spark: SparkSession, folder: str) -> DataFrame:
    source = stand_ins.buildings(spark, folder)
    path = scratch_path(spark, "buildings-csv")
    tables.write_table(source, path, (), "csv")
    schema = "building_id bigint, site_id int, primary_use string, square_feet double, year_built bigint, floor_count bigint"
    again = tables.read_csv_table(spark, path, schema, ["site_id", "square_feet", "year_built"])
    return rounded(
        again.groupBy("site_id").agg(
            F.count("*").alias("building_count"), F.sum("square_feet").alias("square_feet"),
            F.count("year_built").alias("dated"),
        ), 4,
    )


@query("entity_screening", with_(READINGS, f"""
SELECT building_id, meter, timestamp, round(meter_reading, 6) AS meter_reading FROM readings
WHERE meter = 'click' AND coalesce(building_id NOT IN ({EXCLUDED_SQL}), true)"""))
def entity_screening(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(screening.keep_entities(stand_ins.readings(spark, folder), "click", EXCLUDED))


@query("excluded_high_readings", with_(READINGS, f"""
SELECT building_id, timestamp, round(meter_reading, 6) AS meter_reading FROM readings
WHERE meter = 'click' AND building_id IN ({EXCLUDED_SQL})
ORDER BY meter_reading DESC, building_id, timestamp LIMIT 10"""))
def excluded_high_readings(spark: SparkSession, folder: str) -> DataFrame:
    gone = screening.excluded_rows(stand_ins.readings(spark, folder), "click", EXCLUDED)
    top = summaries.top_rows(gone, [F.desc("meter_reading"), "building_id", "timestamp"], 10)
    return rounded(top.select("building_id", "timestamp", "meter_reading"))


@query("screening_report", with_(READINGS, f"""
SELECT total_rows, kept_rows, total_rows - kept_rows AS removed_rows, round(kept_rows * 100.0 / total_rows, 2) AS kept_percent
FROM (SELECT count(*) AS total_rows,
  count(*) FILTER (WHERE meter = 'click' AND building_id NOT IN ({EXCLUDED_SQL})) AS kept_rows FROM readings)"""))
def screening_report(spark: SparkSession, folder: str) -> DataFrame:
    return screening.screening_report(stand_ins.readings(spark, folder), "click", EXCLUDED)


@query("tolerant_cast", """
SELECT event_type, count(*) AS row_count, count(n) AS number_count, round(sum(n), 4) AS total FROM (
  SELECT event_type, TRY_CAST(CASE WHEN user_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS n
  FROM events) GROUP BY 1""")
def tolerant_cast(spark: SparkSession, folder: str) -> DataFrame:
    mixed = stand_ins.table(spark, folder, "events").select(
        "event_type",
        F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("n"),
    )
    numbers = screening.tolerant_numbers(mixed, ["n"])
    return rounded(
        numbers.groupBy("event_type").agg(
            F.count("*").alias("row_count"), F.count("n").alias("number_count"), F.sum("n").alias("total")
        ), 4,
    )


@query("target_validation", """
SELECT event_type AS meter, count(*) FILTER (WHERE value IS NULL) AS missing_count,
  count(*) FILTER (WHERE value < 0) AS negative_count FROM events GROUP BY 1""")
def target_validation(spark: SparkSession, folder: str) -> DataFrame:
    events = stand_ins.table(spark, folder, "events")
    splits.check_target(events, "value")
    value = scaling.to_number(F.col("value"))
    return events.groupBy(F.col("event_type").alias("meter")).agg(
        F.count_if(value.isNull()).alias("missing_count"), F.count_if(value < 0).alias("negative_count")
    )


@query("year_filter", with_(SUPPLIER_READINGS, """
SELECT building_id, timestamp, meter_reading FROM supplier_readings WHERE meter = 'A' AND year(timestamp) = 1998"""))
def year_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = screening.year_rows(stand_ins.supplier_readings(spark, folder), "A", 1998)
    return rows.select("building_id", "timestamp", "meter_reading")


@query("type_narrowing")
def type_narrowing(spark: SparkSession, folder: str) -> DataFrame:
    return screening.narrow_types(stand_ins.table(spark, folder, "lineitem"))


@query("feature_columns", """
SELECT building_id, site_id, primary_use, round(square_feet, 6) AS square_feet
FROM (SELECT c_custkey AS building_id, c_nationkey AS site_id, c_mktsegment AS primary_use,
  CASE WHEN c_acctbal > 0 THEN c_acctbal END AS square_feet FROM customer)""")
def feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    wide = stand_ins.buildings(spark, folder).drop("floor_count")
    kept = screening.feature_columns(wide, ts="year_built", target="floor_count")
    return rounded(wide.select(*kept))


@query("calendar_features", with_(METER_HOURS, """
SELECT meter, timestamp, CAST(month(timestamp) AS INTEGER) AS month_datetime, CAST(weekofyear(timestamp) AS INTEGER) AS weekofyear_datetime,
  CAST(dayofyear(timestamp) AS INTEGER) AS dayofyear_datetime, CAST(hour(timestamp) AS INTEGER) AS hour_datetime,
  CAST(isodow(timestamp) - 1 AS INTEGER) AS day_week, CAST(day(timestamp) AS INTEGER) AS day_month_datetime,
  CAST(ceil(day(timestamp) / 7.0) AS INTEGER) AS week_month_datetime FROM meter_hours"""))
def calendar_features(spark: SparkSession, folder: str) -> DataFrame:
    hours = stand_ins.meter_hours(spark, folder).drop("meter_reading")
    return hours.withColumns(calendar_columns(F.col("timestamp")))


@query("wind_bins", with_(WEATHER, """
SELECT site_id, timestamp, CAST(trunc(wind_direction / 22.5) AS INTEGER) % 16 AS wind_sector,
  CASE WHEN wind_speed < 0.3 THEN 0 WHEN wind_speed < 1.6 THEN 1 WHEN wind_speed < 3.4 THEN 2 WHEN wind_speed < 5.5 THEN 3
    WHEN wind_speed < 8.0 THEN 4 WHEN wind_speed < 10.8 THEN 5 WHEN wind_speed < 13.9 THEN 6 WHEN wind_speed < 17.2 THEN 7
    WHEN wind_speed < 20.8 THEN 8 WHEN wind_speed < 24.5 THEN 9 WHEN wind_speed < 28.5 THEN 10 WHEN wind_speed < 33.0 THEN 11
    ELSE 12 END AS beaufort_scale FROM weather"""))
def wind_bins(spark: SparkSession, folder: str) -> DataFrame:
    return stand_ins.weather(spark, folder).select(
        "site_id", "timestamp", compass_sector(F.col("wind_direction")).alias("wind_sector"),
        beaufort_number(F.col("wind_speed")).alias("beaufort_scale"),
    )


@query("building_age", with_(BUILDINGS, """
SELECT building_id, 2016 - year_built AS age, max(year_built) OVER () - year_built + 1 AS age_from_newest FROM buildings"""))
def building_age(spark: SparkSession, folder: str) -> DataFrame:
    aged = enrich.engineered_features(
        stand_ins.buildings(spark, folder).withColumn("timestamp", F.lit("2016-01-01").cast("timestamp_ntz"))
    )
    return enrich.age_from_newest(aged, output="age_from_newest").select("building_id", "age", "age_from_newest")


@query("label_encoding", with_(BUILDINGS, """
SELECT building_id, CASE WHEN primary_use IS NOT NULL THEN dense_rank() OVER (ORDER BY primary_use) - 1 END AS primary_use
FROM buildings"""))
def label_encoding(spark: SparkSession, folder: str) -> DataFrame:
    coded = enrich.encode_labels(stand_ins.buildings(spark, folder), "primary_use")
    return coded.select("building_id", F.col("primary_use").cast("bigint").alias("primary_use"))


@query("missing_indicators", with_(READINGS, BUILDINGS, """
SELECT building_id, timestamp, meter, CAST(square_feet IS NULL AS INTEGER) AS square_feet_missing,
  CAST(year_built IS NULL AS INTEGER) AS year_built_missing FROM readings LEFT JOIN buildings USING (building_id)"""))
def missing_indicators(spark: SparkSession, folder: str) -> DataFrame:
    wide = enrich.join_buildings(stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder))
    flagged = enrich.missing_flags(wide, always=["square_feet", "year_built"])
    return flagged.select("building_id", "timestamp", "meter", *[c for c in flagged.columns if c.endswith("_missing")])


@query("sentinel_fill", with_(BUILDINGS, """
SELECT building_id, coalesce(square_feet, -999) AS square_feet, coalesce(year_built, -999) AS year_built, floor_count FROM buildings"""))
def sentinel_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = stand_ins.buildings(spark, folder).fillna({"square_feet": -999.0, "year_built": -999, "floor_count": -999})
    return filled.select("building_id", "square_feet", "year_built", "floor_count")


@query("log_size_and_year_shift", with_(BUILDINGS, """
SELECT building_id, round(ln(square_feet), 6) AS square_feet, year_built - 1900 AS year_built FROM buildings"""))
def log_size_and_year_shift(spark: SparkSession, folder: str) -> DataFrame:
    return stand_ins.buildings(spark, folder).select(
        "building_id", tidy(F.ln("square_feet")).alias("square_feet"), (F.col("year_built") - 1900).alias("year_built")
    )


@query("scaled_target", with_(READINGS, split_of("readings", ["meter"]), ranges_of("prepared", ["meter"]), """
SELECT building_id, meter, timestamp, split, round(ln(1 + meter_reading), 6) AS logged,
  round(CASE WHEN target_max - target_min <= 0 THEN 0 ELSE (ln(1 + meter_reading) - target_min) / (target_max - target_min) END, 6) AS scaled
FROM prepared JOIN ranges USING (meter)"""))
def scaled_target(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    scaled = splits.scale_target(split, "meter_reading", ["meter"])
    return rounded(
        scaled.select("building_id", "meter", "timestamp", "split", F.log1p("meter_reading").alias("logged"), "scaled")
    )


@query("inverse_target", with_(READINGS, """
SELECT building_id, meter, timestamp, round(meter_reading, 4) AS restored FROM readings"""))
def inverse_target(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    scaled = splits.scale_target(split, "meter_reading", ["meter"])
    restored = scaling.inverse_log_minmax(F.col("scaled"), F.col("target_min"), F.col("target_max"))
    return scaled.select("building_id", "meter", "timestamp", tidy(restored, 4).alias("restored"))


WIDE = with_(READINGS, split_of("readings", ["meter"]), BUILDINGS, """SELECT p.building_id, p.meter, p.timestamp, p.split,
  p.meter_reading, b.square_feet, b.year_built, b.floor_count FROM prepared p LEFT JOIN buildings b USING (building_id)""")
SCALED_COLUMNS = ["meter_reading", "square_feet", "year_built"]


def wide_rows(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    wide = enrich.join_buildings(split, stand_ins.buildings(spark, folder))
    return wide.select("building_id", "meter", "timestamp", "split", "meter_reading", "square_feet", "year_built", "floor_count")


@query("feature_scaler", f"""
WITH wide AS ({WIDE}), train AS (SELECT * FROM wide WHERE split = 'train')
SELECT 'meter_reading' AS "column", round(avg(meter_reading), 6) AS mean, round(stddev_pop(meter_reading), 6) AS std FROM train
UNION ALL SELECT 'square_feet', round(avg(square_feet), 6), round(stddev_pop(square_feet), 6) FROM train
UNION ALL SELECT 'year_built', round(avg(year_built), 6), round(stddev_pop(year_built), 6) FROM train""")
def feature_scaler(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(splits.fit_scaler(wide_rows(spark, folder), SCALED_COLUMNS))


@query("standardised_features", f"""
WITH wide AS ({WIDE}), s AS (SELECT avg(meter_reading) AS m1, stddev_pop(meter_reading) AS s1, avg(square_feet) AS m2,
  stddev_pop(square_feet) AS s2, avg(year_built) AS m3, stddev_pop(year_built) AS s3 FROM wide WHERE split = 'train')
SELECT building_id, meter, timestamp, split, round(coalesce((meter_reading - m1) / s1, 0), 6) AS meter_reading,
  round(coalesce((square_feet - m2) / s2, 0), 6) AS square_feet, round(coalesce((year_built - m3) / s3, 0), 6) AS year_built
FROM wide CROSS JOIN s""")
def standardised_features(spark: SparkSession, folder: str) -> DataFrame:
    wide = wide_rows(spark, folder).drop("floor_count")
    values = splits.scaler_values(splits.fit_scaler(wide, SCALED_COLUMNS))
    return rounded(splits.standardise(wide, values))


@query("imputed_features", f"""
WITH wide AS ({WIDE}), m AS (SELECT avg(square_feet) AS m2, avg(year_built) AS m3 FROM wide WHERE split = 'train'),
filled AS (SELECT building_id, meter, timestamp, split, coalesce(square_feet, m2) AS square_feet, coalesce(year_built, m3) AS year_built
  FROM wide CROSS JOIN m),
s AS (SELECT avg(square_feet) AS a2, stddev_pop(square_feet) AS s2, avg(year_built) AS a3, stddev_pop(year_built) AS s3
  FROM filled WHERE split = 'train')
SELECT building_id, meter, timestamp, split, round((square_feet - a2) / s2, 6) + 0 AS square_feet, round((year_built - a3) / s3, 6) + 0 AS year_built
FROM filled CROSS JOIN s""")
def imputed_features(spark: SparkSession, folder: str) -> DataFrame:
    wide = wide_rows(spark, folder).drop("floor_count", "meter_reading")
    values = splits.scaler_values(splits.fit_imputed_scaler(wide, ["square_feet", "year_built"]))
    return rounded(splits.standardise(wide, values, impute_first=True))


@query("clipped_predictions", with_(ZERO_INFLATED, """
SELECT meter, part, round(sum(greatest(least(predicted * 12 - 0.1, 1), 0)), 4) AS clipped_sum,
  round(sum(greatest(predicted - 0.05, 0)), 4) AS floored_sum FROM zero_inflated GROUP BY 1, 2"""))
def clipped_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder)
    return rounded(
        rows.groupBy("meter", "part").agg(
            F.sum(scaling.clip(F.col("predicted") * 12 - 0.1, 0.0, 1.0)).alias("clipped_sum"),
            F.sum(scaling.clip(F.col("predicted") - 0.05, low=0.0)).alias("floored_sum"),
        ), 4,
    )


@query("gated_predictions", """
SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_quantity / 50 >= 0.5 THEN 0 ELSE l_discount END AS hard,
  round((1 - 1 / (1 + exp(-((25 - l_quantity) / 10)))) * ln(1 + exp(l_discount)), 6) AS soft FROM lineitem""")
def gated_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return stand_ins.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        scaling.hard_threshold(F.col("l_discount"), 1 - F.col("l_quantity") / 50).alias("hard"),
        tidy(scaling.soft_gate((25 - F.col("l_quantity")) / 10, F.col("l_discount"))).alias("soft"),
    )


@query("day_floor_and_hours", with_(READINGS, """
SELECT building_id, meter, timestamp, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS day_start, CAST(timestamp AS DATE) AS date,
  date_diff('hour', (SELECT min(timestamp) FROM readings), timestamp) AS hours_since_first FROM readings"""))
def day_floor_and_hours(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.readings(spark, folder)
    first = rows.agg(F.min("timestamp")).scalar()
    return rows.select(
        "building_id", "meter", "timestamp", floor_day(F.col("timestamp")).alias("day_start"),
        F.to_date("timestamp").alias("date"), hours_between(F.col("timestamp"), first).alias("hours_since_first"),
    )


@query("meter_labels", """
SELECT CASE l_linenumber % 5 WHEN 0 THEN 'electricity' WHEN 1 THEN 'chilled_water' WHEN 2 THEN 'steam' WHEN 3 THEN 'hot_water'
  ELSE '4' END AS label, count(*) AS row_count, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS percent
FROM lineitem GROUP BY 1""")
def meter_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.table(spark, folder, "lineitem").select(relabel(F.col("l_linenumber") % 5, METER_LABELS).alias("label"))
    return summaries.value_distribution(rows, "label", top=None)


NARROWED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("narrowed_types", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
  WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int'
  ELSE 'bigint' END AS type FROM lineitem""" for c in NARROWED) + """
UNION ALL SELECT 'l_quantity', 'float'""")
def narrowed_types(spark: SparkSession, folder: str) -> DataFrame:
    narrow = screening.narrow_types(stand_ins.table(spark, folder, "lineitem").select(*NARROWED, "l_quantity"))
    return tables.column_list(narrow).select("column", "type")
