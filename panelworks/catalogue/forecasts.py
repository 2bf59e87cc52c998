"""Queries over the historical profile, fitted models, roll-outs and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded
from panelworks.catalogue.sql import (
    BUILDINGS, METER_HOURS, METRIC_COLUMNS, READINGS, SUPPLIER_DAYS, WEATHER, metrics_of, ranges_of, runs_of, split_of, sums_of, with_,
)
from panelworks.functions.bins import BEAUFORT_EDGES
from panelworks.functions.calendar import DAY, calendar_columns
from panelworks.operators import metrics, models, ridge, rollout, splits, summaries
from panelworks.operators.ordering import row_positions
from panelworks.plans import forecasting
from panelworks.plans.preparation import build_features, prepare_splits
from panelworks.scale import cut_lineage
from panelworks.sources import stand_ins

SCALED = """scaled AS (SELECT building_id, meter, timestamp, split, target_min, target_max,
  CAST(isodow(timestamp) - 1 AS INTEGER) AS day_week, CAST(hour(timestamp) AS INTEGER) AS hour_datetime,
  CASE WHEN target_max - target_min <= 0 THEN 0 ELSE (ln(1 + meter_reading) - target_min) / (target_max - target_min) END AS meter_reading
  FROM prepared JOIN ranges USING (meter))"""
PROFILE = """train AS (SELECT * FROM scaled WHERE split = 'train'),
one AS (SELECT building_id, meter, day_week, hour_datetime, avg(meter_reading) AS p1 FROM train GROUP BY 1, 2, 3, 4),
two AS (SELECT building_id, meter, hour_datetime, avg(meter_reading) AS p2 FROM train GROUP BY 1, 2, 3),
three AS (SELECT meter, day_week, hour_datetime, avg(meter_reading) AS p3 FROM train GROUP BY 1, 2, 3),
predicted AS (SELECT s.*, coalesce(p1, p2, p3, (SELECT avg(meter_reading) FROM train)) AS prediction,
  CASE WHEN p1 IS NOT NULL THEN 'building_meter_weekday_hour' WHEN p2 IS NOT NULL THEN 'building_meter_hour'
    WHEN p3 IS NOT NULL THEN 'meter_weekday_hour' ELSE 'global_mean' END AS level
  FROM scaled s LEFT JOIN one USING (building_id, meter, day_week, hour_datetime) LEFT JOIN two USING (building_id, meter, hour_datetime)
    LEFT JOIN three USING (meter, day_week, hour_datetime))"""
STEPS = [READINGS, split_of("readings", ["meter"]), ranges_of("prepared", ["meter"]), SCALED, PROFILE]


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled readings with split, calendar columns and building attributes."""
    wide = build_features(
        stand_ins.readings(spark, folder), stand_ins.buildings(spark, folder), stand_ins.weather(spark, folder),
        flagged=[f.removesuffix("_missing") for f in FEATURES if f.endswith("_missing")],
    )
    return cut_lineage(prepare_splits(wide), "prepared")


def prepared_slim(spark: SparkSession, folder: str) -> DataFrame:
    """Scaled readings with split and calendar columns only."""
    rows = stand_ins.readings(spark, folder).withColumns(calendar_columns(F.col("timestamp")))
    return prepare_splits(cut_lineage(rows, "readings"))


@query("profile_forecast_scores", with_(*STEPS, metrics_of("predicted", "meter_reading", "prediction", ["meter", "split"])))
def profile_forecast_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecasting.profile_scores(prepared_slim(spark, folder)))


@query("profile_forecast_scores_raw", with_(*STEPS, """
raw AS (SELECT meter, split, exp(meter_reading * (target_max - target_min) + target_min) - 1 AS y,
  exp(prediction * (target_max - target_min) + target_min) - 1 AS p FROM predicted)""", metrics_of("raw", "y", "p", ["meter", "split"])
  .replace(", 6)", ", 4)")))
def profile_forecast_scores_raw(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecasting.profile_scores(prepared_slim(spark, folder), raw=True), 4)


@query("profile_predictions", with_(*STEPS, """
SELECT building_id, meter, timestamp, split, round(prediction, 6) AS prediction, level FROM predicted"""))
def profile_predictions(spark: SparkSession, folder: str) -> DataFrame:
    scored = forecasting.profile_forecast(prepared_slim(spark, folder))
    return rounded(scored.select("building_id", "meter", "timestamp", "split", "prediction", "level"))


FEATURES = ["site_id", "primary_use", "square_feet", "age", "floor_count", "wind_direction", "wind_speed", "beaufort_scale",
            "hour_datetime", "day_week", "day_month_datetime", "square_feet_missing", "wind_speed_missing"]


# The scaled feature table in SQL, and ridge models solved by elimination: the sums of products of the standardised columns
# of a group are a matrix with the right side as last column; step k clears column k of all other rows. Leaving a feature out
# means to clear its row and column first, which makes its weight zero.
WIDE = [READINGS, BUILDINGS, WEATHER, """
coded AS (SELECT b.*, code FROM buildings b LEFT JOIN (SELECT primary_use, row_number() OVER (ORDER BY primary_use) - 1 AS code
  FROM (SELECT DISTINCT primary_use FROM buildings)) USING (primary_use))""", f"""
wide AS (SELECT building_id, meter, timestamp, meter_reading, site_id, code AS primary_use, square_feet, 2016 - year_built AS age, floor_count,
  CAST(trunc(wind_direction / 22.5) AS INTEGER) % 16 AS wind_direction, wind_speed,
  CASE WHEN wind_speed IS NOT NULL THEN {" + ".join(f"(wind_speed >= {e})::INTEGER" for e in BEAUFORT_EDGES)} END AS beaufort_scale,
  hour(timestamp) AS hour_datetime, isodow(timestamp) - 1 AS day_week, day(timestamp) AS day_month_datetime,
  (square_feet IS NULL)::INTEGER AS square_feet_missing, (wind_speed IS NULL)::INTEGER AS wind_speed_missing
  FROM readings LEFT JOIN coded USING (building_id) LEFT JOIN weather USING (site_id, timestamp))""", split_of("wide", ["meter"]), ranges_of("prepared", ["meter"]), f"""
rows AS (SELECT meter, split, row_number() OVER () AS id, CASE WHEN target_max - target_min <= 0 THEN 0 ELSE (ln(1 + meter_reading) - target_min) / (target_max - target_min) END AS y,
  [{", ".join(f"{c}::DOUBLE" for c in FEATURES)}] AS x FROM prepared JOIN ranges USING (meter))"""]


def _ridge_sql(groups: list[str], alphas: list[float] = [1.0], variants: dict[str, list[str]] | None = None, features: list[str] = FEATURES, scored: str = "true") -> list[str]:  # noqa: B006
    """CTEs from ``rows`` (id, groups, split, y, x) to ``scored`` (groups, split, variant, alpha, y, p)."""
    variants = {"all": features} if variants is None else variants
    n = len(features)
    gs = "".join(f"{g}, " for g in groups)
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    of = lambda t: f"USING ({', '.join(groups)})" if groups else "ON true"
    left_out = " UNION ALL ".join(f"SELECT '{name}' AS variant, CAST({[k + 1 for k, f in enumerate(features) if f not in chosen]} AS INTEGER[]) AS gone" for name, chosen in variants.items())
    return [f"""
cells AS (SELECT {gs}id, split, y, unnest(x) AS v, unnest(range(1, {n + 1})) AS j FROM rows)""", f"""
facts AS (SELECT {gs}j, coalesce(avg(v), 0) AS mean, coalesce(sqrt(var_pop(v) * count(v) / count(*)), 0) AS std FROM cells WHERE split = 'train' GROUP BY {gs}j)""", f"""
means AS (SELECT {gs}avg(y) AS my FROM rows WHERE split = 'train' {by})""", f"""
standard AS (SELECT {gs}id, split, y, list(CASE WHEN std > 0 THEN (coalesce(v, mean) - mean) / std ELSE 0 END ORDER BY j) AS z FROM cells JOIN facts USING ({gs}j) GROUP BY {gs}id, split, y)""", f"""
sides AS (SELECT {gs}id, list_append(z, y - my) AS z FROM standard JOIN means {of("means")} WHERE split = 'train')""", f"""
products AS (SELECT {gs}i, j, sum(z[i] * z[j]) AS v FROM sides, range(1, {n + 1}) a(i), range(1, {n + 2}) b(j) GROUP BY {gs}i, j)""", f"""
squares AS (SELECT {gs}list(line ORDER BY i) AS m FROM (SELECT {gs}i, list(v ORDER BY j) AS line FROM products GROUP BY {gs}i) {by})""", f"""
starts AS (SELECT {gs}variant, alpha, list_transform(m, lambda line, i: list_transform(line, lambda v, j:
    CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN 0 ELSE v END + CASE WHEN i = j THEN alpha ELSE 0 END)) AS m
  FROM squares CROSS JOIN ({left_out}) CROSS JOIN (SELECT unnest({alphas}::DOUBLE[]) AS alpha))""", f"""
solving AS (SELECT {gs}variant, alpha, 1 AS k, m FROM starts UNION ALL
  SELECT {gs}variant, alpha, k + 1, list_transform(m, lambda line, i:
    CASE WHEN i = k THEN list_transform(line, lambda v: v / m[k][k]) ELSE list_transform(line, lambda v, j: v - line[k] / m[k][k] * m[k][j]) END) FROM solving WHERE k <= {n})""", f"""
weights AS (SELECT {gs}variant, alpha, list_transform(m, lambda line: line[{n + 1}]) AS w FROM solving WHERE k = {n + 1})""", f"""
scored AS (SELECT {gs}{"" if "split" in groups else "split, "}variant, alpha, y, least(greatest(my + list_inner_product(w, z), 0), 1) AS p
  FROM standard JOIN means {of("means")} JOIN weights {of("weights")} WHERE {scored})"""]


def _with_ridge(*parts: str) -> str:
    return "WITH RECURSIVE " + with_(*parts).removeprefix("WITH ")


# One model of all meters, scored per meter.
@query("ridge_forecast", _with_ridge(*WIDE, *_ridge_sql([]), """
of_meter AS (SELECT r.meter, s.split, s.y, least(greatest(my + list_inner_product(w, z), 0), 1) AS p
  FROM standard s JOIN rows r USING (id) CROSS JOIN means CROSS JOIN weights)""", metrics_of("of_meter", "y", "p", ["meter", "split"])))
def ridge_forecast(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    model = ridge.fit_ridge(rows, FEATURES, "meter_reading")
    return rounded(models.score_and_measure(model, rows, "meter_reading", ["meter", "split"]))


# One standardised feature has a closed form: the ridge weight is Sxy / (Sxx + alpha), and Sxx is the row count.
@query("ridge_single_feature", with_(METER_HOURS, split_of("meter_hours", ["meter"]), """
rows AS (SELECT meter, split, timestamp, meter_reading AS y, CAST(hour(timestamp) AS DOUBLE) AS x FROM prepared)""", """
facts AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM rows WHERE split = 'train')""", """
weights AS (SELECT sum((x - mx) / sx * (y - my)) / (max(n) + 1.0) AS w FROM rows CROSS JOIN facts WHERE split = 'train')""", """
SELECT meter, split, timestamp, round(my + w * (x - mx) / sx, 6) AS prediction FROM rows CROSS JOIN facts CROSS JOIN weights"""))
def ridge_single_feature(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"])
    rows = rows.withColumn("hour", F.hour("timestamp").cast("double"))
    model = ridge.fit_ridge(rows, ["hour"], "meter_reading", alpha=1.0)
    return rounded(model.score(rows, None, None).select("meter", "split", "timestamp", "prediction"))


# Depth, step, bins and shares of rows and features are the operator's; the search is given up after ten rounds without gain.
PATIENCE = 10


@query("boosted_trees_forecast")
def boosted_trees_forecast(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    model = models.fit_boosted_trees(rows, FEATURES, "meter_reading", patience=PATIENCE)
    return models.score_and_measure(model, rows, "meter_reading", ["meter", "split"])


@query("importance_ranking")
def importance_ranking(spark: SparkSession, folder: str) -> DataFrame:
    model = models.fit_boosted_trees(prepared(spark, folder), FEATURES, "meter_reading", patience=PATIENCE)
    return summaries.rank_importance(model.importances(spark), top=12)


# The staged errors of a made-up history: the error of every day's total against the mean of all days, in the order of days.
@query("best_round", with_(SUPPLIER_DAYS, """
days AS (SELECT timestamp, sum(meter_reading) AS v FROM supplier_days GROUP BY 1)""", """
history AS (SELECT CAST(row_number() OVER (ORDER BY timestamp) AS INTEGER) AS round, abs(v - (SELECT avg(v) FROM days)) AS error FROM days)""", """
running AS (SELECT *, min(error) OVER (ORDER BY round) AS best FROM history)""", """
placed AS (SELECT *, (SELECT min(h.round) FROM history h WHERE h.error = r.best AND h.round <= r.round) AS best_round FROM running r)""", """
ended AS (SELECT min(round) AS last FROM placed WHERE round - best_round >= 100)""", """
SELECT best_round, round(best, 6) AS best_error, round - best_round >= 100 AS stopped FROM placed
WHERE round = coalesce((SELECT last FROM ended), (SELECT max(round) FROM placed))"""))
def best_round(spark: SparkSession, folder: str) -> DataFrame:
    days = cut_lineage(stand_ins.supplier_days(spark, folder).groupBy("timestamp").agg(F.sum("meter_reading").alias("v")), "days")
    ordered = row_positions(days, [], "timestamp", "_place", slice_days=384)
    history = ordered.select((F.col("_place") + 1).cast("int").alias("round"), F.abs(F.col("v") - days.agg(F.avg("v")).scalar()).alias("error"))
    return rounded(models.staged_choice(history, 100))


@query("per_meter_training", _with_ridge(*WIDE, *_ridge_sql(["meter"]), metrics_of("scored", "y", "p", ["meter", "split", "variant", "alpha"])))
def per_meter_training(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    family = ridge.fit_ridge_family(rows, FEATURES, "meter_reading", keys=["meter"])
    scored = ridge.score_ridge_family(rows, family, FEATURES, ["meter"])
    return rounded(models.measure_family(scored, "meter_reading", ["meter", "split"]))


PENALTIES = [0.1, 10.0, 1000.0]


@query("best_penalty", _with_ridge(*WIDE, *_ridge_sql([], PENALTIES, scored="split = 'valid'"), """
SELECT alpha, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM scored GROUP BY alpha ORDER BY sqrt(avg((p - y) * (p - y))), alpha LIMIT 1"""))
def best_penalty(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    family = ridge.fit_ridge_family(rows, FEATURES, "meter_reading", PENALTIES)
    scored = ridge.score_ridge_family(rows.filter("split = 'valid'"), family, FEATURES)
    return rounded(models.select_best(models.measure_family(scored, "meter_reading", []), "alpha"))


_WEATHER = {"wind_direction", "wind_speed", "beaufort_scale"}
_CALENDAR = {"hour_datetime", "day_week", "day_month_datetime"}
VARIANTS = {
    "baseline": FEATURES,
    "no_weather": [f for f in FEATURES if f not in _WEATHER],
    "no_calendar": [f for f in FEATURES if f not in _CALENDAR],
    "no_missing_flags": [f for f in FEATURES if not f.endswith("_missing")],
}


@query("feature_ablation", _with_ridge(*WIDE, *_ridge_sql(["meter"], variants=VARIANTS, scored="split = 'test'"), f"""
sums AS (SELECT meter, variant, {sums_of("y", "p")} FROM scored GROUP BY 1, 2)""", """
finished AS (SELECT variant, n, sse / n AS mse, sae / n AS mae, sle / n AS sle, CASE WHEN yy - y * y / n <= 0 THEN 0 ELSE 1 - sse / (yy - y * y / n) END AS r2 FROM sums)""", """
pooled AS (SELECT variant, sum(mse * n) / sum(n) AS mse, sum(mae * n) / sum(n) AS mae, sqrt(sum(mse * n) / sum(n)) AS rmse, sqrt(sum(sle * n) / sum(n)) AS rmsle,
  CASE WHEN sum(CASE WHEN r2 < 1 THEN mse * n / (1 - r2) ELSE 0 END) <> 0 THEN 1 - sum(mse * n) / sum(CASE WHEN r2 < 1 THEN mse * n / (1 - r2) ELSE 0 END) ELSE 1 END AS r2,
  CAST(sum(n) AS BIGINT) AS evaluated_row_count FROM finished GROUP BY 1)""", """
SELECT variant, round(mse, 6) AS mse, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(rmsle, 6) AS rmsle, round(r2, 6) AS r2, evaluated_row_count,
  round(rmsle - (SELECT rmsle FROM pooled WHERE variant = 'baseline'), 6) AS delta_rmsle FROM pooled"""))
def feature_ablation(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    family = ridge.fit_ridge_family(rows, FEATURES, "meter_reading", keys=["meter"], variants=VARIANTS)
    scored = ridge.score_ridge_family(rows.filter("split = 'test'"), family, FEATURES, ["meter"])
    per_meter = models.measure_family(scored, "meter_reading", ["meter"])
    return rounded(metrics.delta_from_baseline(metrics.pool_metrics(per_meter, ["variant"]), "rmsle"))


# With one standardised feature per meter the family has the same closed form.
@query("ridge_family_single_feature", with_(METER_HOURS, split_of("meter_hours", ["meter"]), """
rows AS (SELECT meter, split, timestamp, meter_reading AS y, CAST(hour(timestamp) AS DOUBLE) AS x FROM prepared)""", """
facts AS (SELECT meter, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM rows WHERE split = 'train' GROUP BY 1)""", """
alphas AS (SELECT unnest([1.0, 50.0]) AS alpha)""", """
weights AS (SELECT meter, alpha, sum((x - mx) / sx * (y - my)) / (max(n) + max(alpha)) AS w
  FROM rows JOIN facts USING (meter) CROSS JOIN alphas WHERE split = 'train' GROUP BY 1, 2)""", """
scored AS (SELECT meter, split, alpha, y, my + w * (x - mx) / sx AS p FROM rows JOIN facts USING (meter) JOIN weights USING (meter))""",
    f"""measured AS ({metrics_of("scored", "y", "p", ["meter", "split", "alpha"])})""", """
SELECT * REPLACE (CAST(alpha AS DOUBLE) AS alpha) FROM measured"""))
def ridge_family_single_feature(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp", ["meter"])
    rows = rows.withColumn("hour", F.hour("timestamp").cast("double"))
    family = ridge.fit_ridge_family(rows, ["hour"], "meter_reading", [1.0, 50.0], ["meter"])
    scored = ridge.score_ridge_family(rows, family, ["hour"], ["meter"], None, None)
    scores = models.measure_family(scored, "meter_reading", ["meter", "split"]).drop("variant")
    return rounded(scores)


LAGS = 24
_KEPT_GUESS = "least(greatest(s.guess, 0), 1)"


@query("autoregressive_forecast", _with_ridge(METER_HOURS, split_of("meter_hours", ["meter"]), ranges_of("prepared", ["meter"]), """
scaled AS (SELECT meter, timestamp, split, CASE WHEN target_max - target_min <= 0 THEN 0 ELSE (ln(1 + meter_reading) - target_min) / (target_max - target_min) END AS y
  FROM prepared JOIN ranges USING (meter))""", """
training AS (SELECT * FROM scaled WHERE split = 'train')""", runs_of("training", ["meter"], name="train_runs"), f"""
rows AS (SELECT row_number() OVER () AS id, 'train' AS split, y, list_reverse(h) AS x FROM (
  SELECT y, run_position, list(y) OVER (PARTITION BY meter, segment ORDER BY timestamp ROWS BETWEEN {LAGS} PRECEDING AND 1 PRECEDING) AS h FROM train_runs) WHERE run_position >= {LAGS})""",
    *_ridge_sql([], features=[f"lag_{k}" for k in range(1, LAGS + 1)]), """
params AS (SELECT list_transform(w, lambda v, j: v / std[j]) AS raw, my - list_inner_product(list_transform(w, lambda v, j: v / std[j]), mean) AS base
  FROM weights CROSS JOIN means CROSS JOIN (SELECT list(mean ORDER BY j) AS mean, list(std ORDER BY j) AS std FROM facts))""", runs_of("scaled", ["meter"]), f"""
todo AS (SELECT meter, timestamp, y, run_position, before, list_reverse(h) AS h FROM (
  SELECT *, lag(split) OVER (PARTITION BY meter ORDER BY timestamp) AS before,
    list(y) OVER (PARTITION BY meter, segment ORDER BY timestamp ROWS BETWEEN {LAGS} PRECEDING AND 1 PRECEDING) AS h FROM runs) WHERE split = 'test' AND run_position >= {LAGS})""", f"""
rolled AS (
  SELECT meter, timestamp, y, base + list_inner_product(raw, h) AS guess, h FROM todo CROSS JOIN params WHERE before <> 'test' OR run_position = {LAGS}
  UNION ALL
  SELECT t.meter, t.timestamp, t.y, base + list_inner_product(raw, list_prepend({_KEPT_GUESS}, s.h[1:{LAGS - 1}])), list_prepend({_KEPT_GUESS}, s.h[1:{LAGS - 1}])
  FROM rolled s JOIN todo t ON t.meter = s.meter AND t.timestamp = s.timestamp + INTERVAL '1 hour' CROSS JOIN params)""",
    metrics_of("rolled", "y", "guess", ["meter"])))
def autoregressive_forecast(spark: SparkSession, folder: str) -> DataFrame:
    hours = cut_lineage(stand_ins.meter_hours(spark, folder).withColumn("building_id", F.lit(0)), "hours")
    rows = cut_lineage(prepare_splits(hours), "prepared")
    scored = forecasting.autoregressive_forecast(rows, ["meter"], window=LAGS)
    return rounded(metrics.regression_metrics(scored, "meter_reading", "prediction", ["meter"]))


def _rollout_sql(source: str, keys: list[str], step: str, weights: tuple[float, ...]) -> str:
    """Recursive roll-out with fixed weights: the state is the last values, newest first."""
    ks = ", ".join(keys)
    size = len(weights)
    on = " AND ".join(f"r.{k} = s.{k}" for k in keys)
    first = " + ".join(f"{w}::DOUBLE * h{i}" for i, w in enumerate(weights))
    state = ["s.guess", *[f"s.h{i}" for i in range(size - 1)]]
    following = " + ".join(f"{w}::DOUBLE * {h}" for w, h in zip(weights, state))
    starts = ", ".join(f"lag(meter_reading, {i + 1}) OVER w AS h{i}" for i in range(size))
    return f"""WITH RECURSIVE {source}, {split_of(source.split(' AS')[0], [])}, {runs_of('prepared', keys, step)},
lagged AS (SELECT {ks}, timestamp, split, run_position, run_start, meter_reading, {starts},
    lag(split) OVER w AS before, lag(run_position) OVER w AS before_place FROM runs WINDOW w AS (PARTITION BY {ks} ORDER BY timestamp)),
todo AS (SELECT * FROM lagged WHERE split = 'test' AND run_position >= {size}),
firsts AS (SELECT * FROM todo WHERE before <> 'test' OR before_place < {size}),
rolled AS (
  SELECT {ks}, timestamp, meter_reading, {first} AS guess, {', '.join(f'h{i}' for i in range(size))} FROM firsts
  UNION ALL
  SELECT {', '.join('s.' + k for k in keys)}, r.timestamp, r.meter_reading, {following} AS guess, {', '.join(state)}
  FROM rolled s JOIN todo r ON {on} AND r.timestamp = s.timestamp + INTERVAL '{step}')
SELECT {ks}, timestamp, round(meter_reading, 6) AS meter_reading, round(guess, 6) AS prediction FROM rolled"""


@query("rollout_fixed_weights", _rollout_sql(METER_HOURS, ["meter"], "1 hour", (0.4700000013, 0.3100000007, 0.1900000003)))
def rollout_fixed_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.meter_hours(spark, folder), "timestamp")
    rolled = models.roll_out_forecast(rows, ["meter"], "timestamp", "meter_reading", [0.4700000013, 0.3100000007, 0.1900000003])
    return rounded(rolled.select("meter", "timestamp", "meter_reading", "prediction"))


@query("rollout_daily_series", _rollout_sql(SUPPLIER_DAYS, ["building_id"], "1 day", (0.6, 0.4)))
def rollout_daily_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.supplier_days(spark, folder), "timestamp", slice_days=384)
    rolled = models.roll_out_forecast(
        rows, ["building_id"], "timestamp", "meter_reading", [0.6, 0.4], step_seconds=DAY
    )
    return rounded(rolled.select("building_id", "timestamp", "meter_reading", "prediction"))


@query("panel_rollout", "WITH RECURSIVE " + with_(SUPPLIER_DAYS, split_of("supplier_days", []), """
nodes AS (SELECT DISTINCT building_id FROM prepared WHERE split = 'train')""", """
panel AS (SELECT n.building_id, t.split, t.timestamp, p.meter_reading FROM (SELECT DISTINCT split, timestamp FROM prepared) t CROSS JOIN nodes n
  LEFT JOIN prepared p ON p.building_id = n.building_id AND p.timestamp = t.timestamp)""", """
filled AS (SELECT *, coalesce(last_value(meter_reading IGNORE NULLS) OVER (PARTITION BY building_id, split ORDER BY timestamp), 0) AS value FROM panel)""", """
lagged AS (SELECT *, lag(value, 1) OVER w AS h0, lag(value, 2) OVER w AS h1, lag(split) OVER w AS before,
  lag(timestamp, 2) OVER w = timestamp - INTERVAL '2 days' AS full_window FROM filled WINDOW w AS (PARTITION BY building_id ORDER BY timestamp))""", """
rolled AS (
  SELECT building_id, timestamp, meter_reading, 0.57::DOUBLE * h0 + 0.41::DOUBLE * h1 AS guess, h0 FROM lagged
  WHERE split = 'test' AND full_window AND before <> 'test'
  UNION ALL
  SELECT s.building_id, r.timestamp, r.meter_reading, 0.57::DOUBLE * s.guess + 0.41::DOUBLE * s.h0, s.guess
  FROM rolled s JOIN lagged r ON r.building_id = s.building_id AND r.timestamp = s.timestamp + INTERVAL '1 day')""", """
SELECT building_id, timestamp, meter_reading, round(guess, 5) AS prediction FROM rolled WHERE meter_reading IS NOT NULL""")
  .removeprefix("WITH "))
def panel_rollout(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.supplier_days(spark, folder), "timestamp", slice_days=384)
    nodes = rows.filter("split = 'train'").select("building_id").distinct()
    scored = forecasting.panel_forecast(
        rows, nodes, [0.57, 0.41], step_seconds=DAY, clip_to=None, slice_days=384
    )
    return rounded(scored.select("building_id", "timestamp", "meter_reading", "prediction"), 5)


WEEK = 168
WEEK_LIMITS = (0.0, 60.0)
# Days of suppliers that ship, with two further features; missing days carry the last shipped one, within each split.
WEEK_STEPS = ["""
shipped AS (SELECT l_suppkey AS building_id, l_shipdate AS timestamp, sum(l_quantity) AS meter_reading, sum(l_discount) AS discount,
  CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY 1, 2)""", split_of("shipped", []), """
nodes AS (SELECT DISTINCT building_id FROM prepared WHERE split = 'train')""", """
panel AS (SELECT n.building_id, t.split, t.timestamp, p.meter_reading, p.discount, p.lines
  FROM (SELECT DISTINCT split, timestamp FROM prepared) t CROSS JOIN nodes n
  LEFT JOIN prepared p ON p.building_id = n.building_id AND p.timestamp = t.timestamp)""", """
filled AS (SELECT building_id, split, timestamp, meter_reading AS actual,
  coalesce(last_value(meter_reading IGNORE NULLS) OVER w, 0) AS value, coalesce(last_value(discount IGNORE NULLS) OVER w, 0) AS discount,
  coalesce(last_value(lines IGNORE NULLS) OVER w, 0) AS lines FROM panel WINDOW w AS (PARTITION BY building_id, split ORDER BY timestamp))""", f"""
stretched AS (SELECT *, row_number() OVER (PARTITION BY building_id, gap ORDER BY timestamp) - 1 AS place FROM (
  SELECT *, timestamp - row_number() OVER (PARTITION BY building_id ORDER BY timestamp) * INTERVAL '1 day' AS gap FROM filled))""", f"""
past AS (SELECT *, list(value) OVER w AS h, list(discount) OVER w AS d, list(lines) OVER w AS l, lag(split) OVER (PARTITION BY building_id, gap ORDER BY timestamp) AS before,
  FROM stretched WINDOW w AS (PARTITION BY building_id, gap ORDER BY timestamp ROWS BETWEEN {WEEK} PRECEDING AND 1 PRECEDING))""", f"""
todo AS (SELECT building_id, timestamp, actual, place, before, h, 0.25
    + list_inner_product(d, list_transform(range({WEEK}), lambda k: 3.0 / ({WEEK} - k))) - list_inner_product(l, list_transform(range({WEEK}), lambda k: 0.5 / ({WEEK} - k))) AS known_part
  FROM past WHERE split = 'test' AND place >= {WEEK})""", f"""
rolled AS (
  SELECT building_id, timestamp, actual, known_part + list_inner_product(h, list_transform(range({WEEK}), lambda k: 0.9 / (({WEEK} - k) * ({WEEK} - k + 1)))) AS guess, h
  FROM todo WHERE before <> 'test' OR place = {WEEK}
  UNION ALL
  SELECT t.building_id, t.timestamp, t.actual,
    t.known_part + list_inner_product(list_append(s.h[2:], least(greatest(s.guess, {WEEK_LIMITS[0]}), {WEEK_LIMITS[1]})),
      list_transform(range({WEEK}), lambda k: 0.9 / (({WEEK} - k) * ({WEEK} - k + 1)))),
    list_append(s.h[2:], least(greatest(s.guess, {WEEK_LIMITS[0]}), {WEEK_LIMITS[1]}))
  FROM rolled s JOIN todo t ON t.building_id = s.building_id AND t.timestamp = s.timestamp + INTERVAL '1 day')"""]


def _week_forecast(spark: SparkSession, folder: str) -> DataFrame:
    shipped = stand_ins.table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("building_id"), F.col("l_shipdate").alias("timestamp")).agg(
        F.sum("l_quantity").alias("meter_reading"), F.sum("l_discount").alias("discount"), F.count("*").cast("double").alias("lines")
    )
    rows = splits.time_split(cut_lineage(shipped, "shipped"), "timestamp", slice_days=384)
    nodes = rows.filter("split = 'train'").select("building_id")
    weights = [[0.9 / (k * (k + 1)), 3.0 / k, -0.5 / k] for k in range(WEEK, 0, -1)]
    return forecasting.panel_window_forecast(
        rows, nodes, ["discount", "lines"], rollout.LinearWindow(weights, 0.25), WEEK, step_seconds=DAY, clip_to=WEEK_LIMITS, slice_days=384
    )


@query("panel_window_rollout", "WITH RECURSIVE " + with_(*WEEK_STEPS, """
SELECT building_id, timestamp, round(actual, 6) AS meter_reading, round(guess, 5) AS prediction FROM rolled WHERE actual IS NOT NULL""").removeprefix("WITH "))
def panel_window_rollout(spark: SparkSession, folder: str) -> DataFrame:
    scored = _week_forecast(spark, folder).filter(F.col("prediction").isNotNull())
    return rounded(scored.select("building_id", "timestamp", "meter_reading", "prediction"), 5)


@query("panel_window_rollout_scores", "WITH RECURSIVE " + with_(*WEEK_STEPS, f"""
scored AS (SELECT timestamp, actual AS y, least(greatest(guess, {WEEK_LIMITS[0]}), {WEEK_LIMITS[1]}) AS p FROM rolled WHERE actual IS NOT NULL)""", f"""
measured AS ({metrics_of("scored", "y", "p", [])})""", """
SELECT *, (SELECT count(*) FROM prepared WHERE split = 'test') - (SELECT count(*) FROM scored) AS skipped_row_count,
  (SELECT count(*) FROM prepared WHERE split = 'test' AND building_id NOT IN (SELECT building_id FROM nodes)) AS unknown_row_count,
  (SELECT count(DISTINCT timestamp) FROM scored) AS evaluated_timestamp_count FROM measured""").removeprefix("WITH "))
def panel_window_rollout_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rollout.roll_out_scores(_week_forecast(spark, folder), "meter_reading", "timestamp", limits=WEEK_LIMITS, known=F.col("known")))
