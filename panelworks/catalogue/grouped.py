"""Queries over profiles, daily peaks, distributions, set operations and the removal search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded
from panelworks.catalogue.sql import (
    BUILDINGS, READINGS, SUPPLIER_READINGS, WEATHER, ZERO_INFLATED, ranges_of, split_of, with_,
)
from panelworks.operators import enrich, metrics, removal, screening, splits, summaries
from panelworks.scale import cut_lineage
from panelworks.sources import stand_ins

DAILY = """daily AS (
  SELECT CAST(timestamp AS DATE) AS date, building_id, meter, sum(meter_reading) AS meter_reading
  FROM supplier_readings GROUP BY 1, 2, 3)"""
DAILY_MAX = """daily_max AS (
  SELECT date_trunc('day', timestamp) AS date, building_id, meter, max(meter_reading) AS meter_reading
  FROM supplier_readings GROUP BY 1, 2, 3)"""
OVERVIEW = """overview AS (
  SELECT date, meter, sum(meter_reading) AS total, avg(meter_reading) AS mean, max(meter_reading) AS peak,
    min(building_id) FILTER (WHERE place = 1) AS peak_holder
  FROM (SELECT *, rank() OVER (PARTITION BY date, meter ORDER BY meter_reading DESC) AS place FROM daily) GROUP BY 1, 2)"""


def daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.daily_totals(stand_ins.supplier_readings(spark, folder), ["building_id", "meter"])


def daily_maxima(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.daily_maxima(stand_ins.supplier_readings(spark, folder), ["building_id", "meter"])


@query("daily_entity_max", with_(SUPPLIER_READINGS, DAILY_MAX, "SELECT CAST(date AS TIMESTAMP) AS date, building_id, meter, meter_reading FROM daily_max"))
def daily_entity_max(spark: SparkSession, folder: str) -> DataFrame:
    return daily_maxima(spark, folder)


@query("daily_entity_sum", with_(SUPPLIER_READINGS, DAILY, "SELECT date, building_id, meter, meter_reading FROM daily"))
def daily_entity_sum(spark: SparkSession, folder: str) -> DataFrame:
    return daily_totals(spark, folder)


@query("daily_meter_overview", with_(SUPPLIER_READINGS, DAILY, OVERVIEW, """
SELECT date, meter, total, round(mean, 6) AS mean, peak_holder, peak FROM overview"""))
def daily_meter_overview(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.daily_overview(daily_totals(spark, folder)))


@query("daily_peak_holder", with_(SUPPLIER_READINGS, DAILY_MAX, """
SELECT CAST(date AS TIMESTAMP) AS date, meter, building_id, meter_reading
FROM (SELECT *, row_number() OVER (PARTITION BY date, meter ORDER BY meter_reading DESC, building_id) AS place FROM daily_max) WHERE place = 1"""))
def daily_peak_holder(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.peak_holders(daily_maxima(spark, folder), ["date", "meter"])


@query("peak_holder_days", with_(SUPPLIER_READINGS, DAILY, OVERVIEW, """
SELECT meter, peak_holder, count(*) AS days FROM overview GROUP BY 1, 2"""))
def peak_holder_days(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.peak_holder_days(summaries.daily_overview(daily_totals(spark, folder)))


@query("peak_series_summary", with_(SUPPLIER_READINGS, DAILY, OVERVIEW, """
SELECT meter, max(peak) AS max, round(avg(peak), 6) AS mean, median(peak) AS median, round(max(peak) / median(peak), 6) AS ratio
FROM overview GROUP BY 1"""))
def peak_series_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.series_summary(summaries.daily_overview(daily_totals(spark, folder)), "peak", ["meter"]))


@query("distinct_counts", with_(READINGS, BUILDINGS, """
SELECT count(DISTINCT building_id) AS building_id, count(DISTINCT site_id) AS site_id, count(DISTINCT primary_use) AS primary_use,
  count(DISTINCT CAST(timestamp AS DATE)) AS date FROM readings LEFT JOIN buildings USING (building_id)"""))
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    wide = enrich.join_buildings(stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder))
    dated = wide.withColumn("date", F.to_date("timestamp"))
    return summaries.distinct_counts(dated, ["building_id", "site_id", "primary_use", "date"])


MISSING_COLUMNS = ("building_id", "site_id", "primary_use", "square_feet", "year_built", "floor_count", "wind_direction", "wind_speed")
MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_percent FROM wide"
    for c in MISSING_COLUMNS
)


@query("missing_summary", with_(READINGS, BUILDINGS, WEATHER, """
wide AS (SELECT * FROM readings LEFT JOIN buildings USING (building_id) LEFT JOIN weather USING (site_id, timestamp))""",
f"SELECT * FROM ({MISSING_SQL}) ORDER BY missing_count DESC, \"column\" LIMIT 5"))
def missing_summary(spark: SparkSession, folder: str) -> DataFrame:
    located = enrich.join_buildings(stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder))
    wide = enrich.join_weather(located, stand_ins.weather(spark, folder))
    return summaries.missing_summary(wide.select(*MISSING_COLUMNS), top=5)


@query("table_profile", with_(READINGS, """
SELECT meter, count(*) AS row_count, count(DISTINCT building_id) AS building_count, min(timestamp) AS start_timestamp,
  max(timestamp) AS end_timestamp, round(min(meter_reading), 6) AS reading_min, round(max(meter_reading), 6) AS reading_max,
  round(avg(meter_reading), 6) AS reading_mean FROM readings GROUP BY 1"""))
def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.table_profile(stand_ins.readings(spark, folder), ["meter"]))


@query("meter_distribution", with_(READINGS, """
SELECT meter, count(*) AS row_count, round(count(*) * 100.0 / (SELECT count(*) FROM readings), 2) AS percent FROM readings GROUP BY 1"""))
def meter_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.value_distribution(stand_ins.readings(spark, folder), "meter", top=None)


@query("value_distribution", """
SELECT c_mktsegment, count(*) AS row_count, round(count(*) * 100.0 / (SELECT count(*) FROM customer), 2) AS percent
FROM customer GROUP BY 1 ORDER BY row_count DESC, c_mktsegment LIMIT 3""")
def value_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.value_distribution(stand_ins.table(spark, folder, "customer"), "c_mktsegment", top=3)


@query("target_range", with_(READINGS, split_of("readings", ["meter"]), ranges_of("prepared", ["meter"]), """
SELECT meter, round(target_min, 6) AS target_min, round(target_max, 6) AS target_max FROM ranges"""))
def target_range(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    return rounded(splits.fit_target_range(split, "meter_reading", ["meter"]))


@query("split_summary", with_(READINGS, split_of("readings", ["meter"]), """
SELECT meter, split, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp, count(*) AS row_count FROM prepared GROUP BY 1, 2"""))
def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.readings(spark, folder), "timestamp", ["meter"])
    return splits.split_summary(split, "timestamp", ["meter"])


@query("row_flow", with_(READINGS, BUILDINGS, split_of("readings", ["meter"]), """
SELECT CAST(0 AS INTEGER) AS step, 'raw events' AS stage, count(*) AS row_count FROM events
UNION ALL SELECT 1, 'hourly readings', count(*) FROM readings
UNION ALL SELECT 2, 'screened', count(*) FROM readings WHERE building_id NOT IN (3, 8, 11)
UNION ALL SELECT 3, 'split', count(*) FROM prepared WHERE building_id NOT IN (3, 8, 11) AND split IS NOT NULL"""))
def row_flow(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.readings(spark, folder)
    kept = rows.filter(~screening.is_listed(F.col("building_id"), (3, 8, 11)))
    split = splits.time_split(rows, "timestamp", ["meter"])
    return summaries.row_flow(
        {
            "raw events": stand_ins.table(spark, folder, "events"),
            "hourly readings": rows,
            "screened": kept,
            "split": split.filter(~screening.is_listed(F.col("building_id"), (3, 8, 11)) & F.col("split").isNotNull()),
        }
    )


@query("zero_rate_by_split", with_(
    ZERO_INFLATED, split_of("zero_inflated", ["meter"]), """
SELECT meter, split, count(*) AS row_count, round(avg(CASE WHEN actual <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate FROM prepared GROUP BY 1, 2"""))
def zero_rate_by_split(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.time_split(stand_ins.zero_inflated(spark, folder), "timestamp", ["meter"])
    return rounded(summaries.zero_rates(split, ["meter", "split"], "actual"))


@query("zero_rate_by_month", with_(ZERO_INFLATED, """
SELECT meter, CAST(month(timestamp) AS INTEGER) AS month, count(*) AS row_count,
  round(avg(CASE WHEN actual <= 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate FROM zero_inflated GROUP BY 1, 2"""))
def zero_rate_by_month(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder).withColumn("month", F.month("timestamp"))
    return rounded(summaries.zero_rates(rows, ["meter", "month"], "actual"))


@query("zero_positive_weight", with_(ZERO_INFLATED, """
SELECT meter, count(*) FILTER (WHERE actual <= 0) AS zero_count, count(*) FILTER (WHERE actual > 0) AS positive_count,
  round(count(*) FILTER (WHERE actual > 0) / count(*) FILTER (WHERE actual <= 0), 6) AS zero_positive_weight
FROM zero_inflated WHERE observed GROUP BY 1"""))
def zero_positive_weight(spark: SparkSession, folder: str) -> DataFrame:
    seen = stand_ins.zero_inflated(spark, folder).filter("observed")
    return rounded(metrics.zero_positive_weight(seen, "actual", ["meter"]))


CORRELATED = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("correlation_with_target", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 6) AS correlation FROM lineitem" for c in CORRELATED))
def correlation_with_target(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.correlations_with(stand_ins.table(spark, folder, "lineitem"), "l_extendedprice", CORRELATED))


@query("correlation_matrix", with_(READINGS, BUILDINGS, "wide AS (SELECT * FROM readings LEFT JOIN buildings USING (building_id))",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) + 0 AS correlation FROM wide"
        for a in ("meter_reading", "square_feet", "year_built") for b in ("meter_reading", "square_feet", "year_built"))))
def correlation_matrix(spark: SparkSession, folder: str) -> DataFrame:
    wide = enrich.join_buildings(stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder))
    return rounded(summaries.correlation_matrix(wide, ["meter_reading", "square_feet", "year_built"]))


@query("reading_histogram", with_(READINGS, split_of("readings", []), """
bounds AS (SELECT min(meter_reading) AS low, max(meter_reading) AS high FROM prepared)""", """
SELECT split, CAST(least(floor((meter_reading - low) / (high - low) * 25) + 1, 25) AS BIGINT) AS bin, count(*) AS row_count
FROM prepared CROSS JOIN bounds GROUP BY 1, 2"""))
def reading_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.readings(spark, folder), "timestamp")
    return summaries.histogram(rows, "meter_reading", 25, ["split"])


@query("totals_by_timestamp", with_(READINGS, """
SELECT timestamp, round(sum(meter_reading), 6) AS total, round(avg(meter_reading), 6) AS mean FROM readings GROUP BY 1"""))
def totals_by_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.totals_by_timestamp(stand_ins.readings(spark, folder)))


@query("presence_map", with_(ZERO_INFLATED, """
cells AS (SELECT meter, building_id, timestamp, sum(actual) AS value FROM zero_inflated GROUP BY 1, 2, 3)""", """
nodes AS (SELECT DISTINCT meter, building_id FROM cells)""", """
times AS (SELECT DISTINCT meter, timestamp FROM cells)""", """
SELECT meter, CASE WHEN value IS NULL THEN 'absent' WHEN value = 0 THEN 'zero' ELSE 'reading' END AS state, count(*) AS cells
FROM nodes JOIN times USING (meter) LEFT JOIN cells USING (meter, building_id, timestamp) GROUP BY 1, 2"""))
def presence_map(spark: SparkSession, folder: str) -> DataFrame:
    cells = (
        stand_ins.zero_inflated(spark, folder).groupBy("meter", "building_id", "timestamp").agg(F.sum("actual").alias("value"))
    )
    return enrich.presence_counts(cells, "value", ["meter"])


@query("string_cardinality", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM orders" for c in ("o_orderstatus", "o_orderpriority")))
def string_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.string_cardinality(stand_ins.table(spark, folder, "orders"))


@query("median_fill", with_(BUILDINGS, """
SELECT building_id, round(coalesce(square_feet, (SELECT median(square_feet) FROM buildings)), 6) AS square_feet FROM buildings"""))
def median_fill(spark: SparkSession, folder: str) -> DataFrame:
    filled = summaries.fill_with_median(stand_ins.buildings(spark, folder), ["square_feet"], 0.0)
    return rounded(filled.select("building_id", "square_feet"))


@query("exact_median_price", """
SELECT l_returnflag, round(median(l_extendedprice), 4) AS median FROM lineitem GROUP BY 1""")
def exact_median_price(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(summaries.exact_median(stand_ins.table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4)


@query("first_row_per_entity", with_(SUPPLIER_READINGS, """
SELECT building_id, CAST(first_at AS TIMESTAMP) AS timestamp, min(meter) AS meter
FROM (SELECT *, min(timestamp) OVER (PARTITION BY building_id) AS first_at FROM supplier_readings) WHERE timestamp = first_at GROUP BY 1, 2"""))
def first_row_per_entity(spark: SparkSession, folder: str) -> DataFrame:
    return enrich.first_row_per_entity(stand_ins.supplier_readings(spark, folder), ["timestamp", "meter"])


@query("top_readings", with_(SUPPLIER_READINGS, """
SELECT * FROM supplier_readings ORDER BY meter_reading DESC, timestamp, building_id, meter LIMIT 25"""))
def top_readings(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.desc("meter_reading"), "timestamp", "building_id", "meter"]
    return summaries.top_rows(stand_ins.supplier_readings(spark, folder), order, 25)


@query("top_entities_by_count", """
SELECT l_suppkey, count(*) AS row_count, round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS percent
FROM lineitem GROUP BY 1 ORDER BY row_count DESC, l_suppkey LIMIT 12""")
def top_entities_by_count(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.value_distribution(stand_ins.table(spark, folder, "lineitem"), "l_suppkey", top=12)


@query("labelled_union", with_(SUPPLIER_READINGS, DAILY_MAX, """
SELECT 'all' AS scenario, CAST(date AS TIMESTAMP) AS date, meter, max(meter_reading) AS peak FROM daily_max GROUP BY 2, 3
UNION ALL SELECT 'screened', CAST(date AS TIMESTAMP), meter, max(meter_reading) FROM daily_max WHERE building_id NOT IN (3, 8, 11) GROUP BY 2, 3"""))
def labelled_union(spark: SparkSession, folder: str) -> DataFrame:
    daily = daily_maxima(spark, folder)
    return summaries.labelled_union(
        {
            "all": daily.groupBy("date", "meter").agg(F.max("meter_reading").alias("peak")),
            "screened": daily.filter(~screening.is_listed(F.col("building_id"), (3, 8, 11)))
            .groupBy("date", "meter").agg(F.max("meter_reading").alias("peak")),
        },
        "scenario",
    )


@query("set_difference", with_("""
sales AS (SELECT l_partkey AS building_id, l_shipdate AS timestamp FROM lineitem)""", split_of("sales", []), """
SELECT DISTINCT building_id FROM prepared WHERE split = 'test' EXCEPT SELECT building_id FROM prepared WHERE split = 'valid'"""))
def set_difference(spark: SparkSession, folder: str) -> DataFrame:
    sales = stand_ins.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("building_id"), F.col("l_shipdate").alias("timestamp"))
    rows = splits.time_split(sales, "timestamp", slice_days=384)
    of = lambda name: rows.filter(F.col("split") == name).select("building_id")
    return of("test").subtract(of("valid"))


RATIO_LIMIT = 1.34
PEAK_SHARE = 1.2
# Every meter is searched for itself: sizes upwards, each set as bits, until one solves it. Sets grow only while the best value
# that always stays could still be within the limit of the median.
REMOVAL_CANDIDATES = [READINGS, """
daily AS (SELECT meter, CAST(timestamp AS DATE) AS date, building_id, sum(meter_reading) AS v FROM readings GROUP BY 1, 2, 3)""", """
tops AS (SELECT meter, date, building_id, v FROM daily QUALIFY row_number() OVER (PARTITION BY meter, date ORDER BY v DESC, building_id) = 1)""", f"""
candidates AS (SELECT meter, building_id, row_number() OVER (PARTITION BY meter ORDER BY building_id) - 1 AS i FROM (
  SELECT meter, building_id FROM daily JOIN (SELECT meter, {PEAK_SHARE} * median(v) AS most FROM tops GROUP BY 1) USING (meter) WHERE v > most
  UNION SELECT meter, building_id FROM (SELECT meter, building_id, count(*) AS days FROM tops GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY meter ORDER BY days DESC, building_id) <= 12))"""]
_MIDDLE = "list_aggregate(peaks, 'median')"
_PEAKS = "list_filter(list_transform(days, lambda d: list_max(list_transform(list_filter(d, lambda e: e.i IS NULL OR (({s} >> e.i) & 1) = 0), lambda e: e.v))), lambda p: p IS NOT NULL)"
REMOVAL = [*REMOVAL_CANDIDATES, """
per_day AS (SELECT meter, date, list({'i': i, 'v': v}) AS entries, max(v) FILTER (WHERE i IS NULL) AS rest FROM daily LEFT JOIN candidates USING (meter, building_id) GROUP BY 1, 2)""", """
per_meter AS (SELECT meter, list(list_filter(entries, lambda e: rest IS NULL OR e.i IS NULL OR e.v > rest)) AS days, CASE WHEN count(rest) = count(*) THEN max(rest) END AS stays,
  (SELECT count(*) FROM candidates c WHERE c.meter = per_day.meter) AS n FROM per_day GROUP BY 1)""", f"""
search AS (
  SELECT meter, 0 AS size, -1::BIGINT AS last, 0::BIGINT AS s, {_PEAKS.format(s="0::BIGINT")} AS peaks FROM per_meter
  UNION ALL
  SELECT meter, size + 1, i, s | (1::BIGINT << i), {_PEAKS.format(s="(s | (1::BIGINT << i))")}
  FROM (SELECT *, bool_or(list_max(peaks) / {_MIDDLE} <= {RATIO_LIMIT}) OVER (PARTITION BY meter) AS done FROM search) JOIN per_meter USING (meter) JOIN candidates USING (meter)
  WHERE NOT coalesce(done, false) AND i > last AND (stays IS NULL OR coalesce(stays / {_MIDDLE} <= {RATIO_LIMIT}, true)))""", f"""
tried AS (SELECT meter, size, s, list_max(peaks) AS max, list_avg(peaks) AS mean, {_MIDDLE} AS median, list_max(peaks) / {_MIDDLE} AS ratio FROM search)""", f"""
solved AS (SELECT * FROM tried WHERE ratio <= {RATIO_LIMIT})"""]


def removal_search(spark: SparkSession, folder: str):
    """Readings, their daily totals per meter, the solutions and the search log."""
    rows = stand_ins.readings(spark, folder)
    daily = cut_lineage(summaries.daily_totals(rows, ["meter", "building_id"]), "daily")
    candidates = removal.candidate_set(daily, keys=["meter"], peak_share=PEAK_SHARE)
    solutions, log = removal.minimal_removal(daily, candidates, RATIO_LIMIT, ["meter"])
    return rows, daily, solutions, log


@query("minimal_removal", "WITH RECURSIVE " + with_(*REMOVAL, """
SELECT meter, CAST(size AS INTEGER) AS removed_count,
  coalesce((SELECT string_agg(building_id, ',' ORDER BY building_id) FROM candidates c WHERE c.meter = solved.meter AND (s >> i) & 1 = 1), '') AS removed,
  round(max, 6) AS max, round(mean, 6) AS mean, round(median, 6) AS median, round(ratio, 6) AS ratio FROM solved""").removeprefix("WITH "))
def minimal_removal(spark: SparkSession, folder: str) -> DataFrame:
    _, _, solutions, _ = removal_search(spark, folder)
    listed = F.array_join(F.col("removed").cast("array<string>"), ",")
    return rounded(solutions.select("meter", F.size("removed").alias("removed_count"), listed.alias("removed"), "max", "mean", "median", "ratio"))


@query("removal_search_log", "WITH RECURSIVE " + with_(*REMOVAL, f"""
SELECT meter, CAST(size AS BIGINT) AS remove_count, CAST(factorial(any_value(n)::INTEGER) // (factorial(size) * factorial(any_value(n)::INTEGER - size)) AS BIGINT) AS combinations,
  count(*) AS scored, count(*) FILTER (WHERE ratio <= {RATIO_LIMIT}) AS solutions FROM tried JOIN per_meter USING (meter) GROUP BY 1, size""").removeprefix("WITH "))
def removal_search_log(spark: SparkSession, folder: str) -> DataFrame:
    _, _, _, log = removal_search(spark, folder)
    return log


@query("removal_impact", "WITH RECURSIVE " + with_(*REMOVAL, """
best AS (SELECT meter, s FROM solved QUALIFY row_number() OVER (PARTITION BY meter ORDER BY round(ratio, 9), round(max, 9), round(mean, 9)) = 1)""", """
SELECT meter, building_id, count(*) AS rows_to_delete FROM readings JOIN candidates USING (meter, building_id) JOIN best USING (meter)
WHERE (s >> i) & 1 = 1 GROUP BY 1, 2""").removeprefix("WITH "))
def removal_impact(spark: SparkSession, folder: str) -> DataFrame:
    rows, _, solutions, _ = removal_search(spark, folder)
    return removal.removal_impact(rows, removal.best_removal(solutions, ["meter"]), ["meter"])


@query("removal_comparison", with_(READINGS, """
cells AS (SELECT meter, CAST(timestamp AS DATE) AS date, building_id, meter_reading AS v FROM readings)""", """
schemes AS (SELECT 'none' AS scheme, CAST([] AS BIGINT[]) AS ids UNION ALL SELECT 'three', [2, 42, 121] UNION ALL SELECT 'six', [2, 42, 121, 3, 8, 11])""", """
peaks AS (SELECT meter, scheme, date, max(v) FILTER (WHERE NOT list_contains(ids, building_id)) AS peak,
  count(*) FILTER (WHERE list_contains(ids, building_id)) AS removed FROM schemes CROSS JOIN cells GROUP BY 1, 2, 3)""", """
SELECT meter, scheme, CAST(sum(removed) AS BIGINT) AS removed_rows, round(max(peak), 6) AS max, round(avg(peak), 6) AS mean, round(median(peak), 6) AS median,
  round(max(peak) / median(peak), 6) AS ratio FROM peaks GROUP BY 1, 2"""))
def removal_comparison(spark: SparkSession, folder: str) -> DataFrame:
    schemes = {"none": [], "three": [2, 42, 121], "six": [2, 42, 121, 3, 8, 11]}
    return rounded(removal.compare_removals(stand_ins.readings(spark, folder), schemes, keys=["meter"]))


@query("candidate_union", with_(*REMOVAL_CANDIDATES, "SELECT meter, building_id FROM candidates"))
def candidate_union(spark: SparkSession, folder: str) -> DataFrame:
    daily = cut_lineage(summaries.daily_totals(stand_ins.readings(spark, folder), ["meter", "building_id"]), "daily")
    return removal.candidate_set(daily, keys=["meter"], peak_share=PEAK_SHARE)


@query("importance_from_correlation", """
WITH strengths AS (SELECT l_returnflag, abs(corr(l_quantity, l_extendedprice)) AS l_quantity, abs(corr(l_discount, l_extendedprice)) AS l_discount,
  abs(corr(l_tax, l_extendedprice)) AS l_tax, abs(corr(l_linenumber, l_extendedprice)) AS l_linenumber FROM lineitem GROUP BY 1),
mean AS (SELECT feature, avg(strength) AS importance FROM (UNPIVOT strengths ON l_quantity, l_discount, l_tax, l_linenumber INTO NAME feature VALUE strength) GROUP BY 1)
SELECT feature, round(importance, 6) AS importance, round(importance / (SELECT max(importance) FROM mean) * 100, 2) AS width_percent FROM mean""")
def importance_from_correlation(spark: SparkSession, folder: str) -> DataFrame:
    strengths = (
        stand_ins.table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(*[F.abs(F.corr(c, "l_extendedprice")).alias(c) for c in CORRELATED])
        .unpivot(["l_returnflag"], list(CORRELATED), "feature", "importance")
    )
    return rounded(summaries.rank_importance(strengths))
