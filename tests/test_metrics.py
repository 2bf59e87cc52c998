"""Metrics, zero state and the historical profile against fixed cases."""

import math

import pytest
from pyspark.sql import functions as F

from panelworks.operators import metrics
from panelworks.operators.profile import fit_profile, predict_profile


def pairs(spark, rows):
    return spark.createDataFrame(rows, "y double, p double")


def test_regression_metrics(spark):
    row = metrics.regression_metrics(pairs(spark, [(1.0, 1.0), (2.0, 2.5), (3.0, 2.0)]), "y", "p").first()
    assert row["mse"] == pytest.approx(0.4166667, abs=1e-6) and row["mae"] == pytest.approx(0.5)
    assert row["rmse"] == pytest.approx(0.6454972, abs=1e-6) and row["r2"] == pytest.approx(0.375)
    assert row["smape"] == pytest.approx(20.740740, abs=1e-5) and row["evaluated_row_count"] == 3


def test_flat_target_has_r2_zero_and_zero_pairs_add_no_smape(spark):
    row = metrics.regression_metrics(pairs(spark, [(0.0, 0.0), (0.0, 1.0)]), "y", "p").first()
    assert row["r2"] == 0.0 and row["smape"] == pytest.approx(100.0)


def test_raw_values_clip_only_inside_rmsle(spark):
    row = metrics.regression_metrics(pairs(spark, [(0.0, -5.0), (3.0, 1.0)]), "y", "p").first()
    assert row["mse"] == pytest.approx(14.5) and row["mae"] == pytest.approx(3.5)
    assert row["rmsle"] == pytest.approx(math.sqrt(math.log(2) ** 2 / 2))


def test_raw_scale(spark):
    df = pairs(spark, [(1.0, 0.0)]).withColumns({"target_min": F.lit(0.0), "target_max": F.lit(math.log(10))})
    row = metrics.raw_scale_metrics(df, "y", "p").first()
    assert row["mse"] == pytest.approx(81.0) and row["mae"] == pytest.approx(9.0)
    assert row["smape"] == pytest.approx(200.0) and row["rmsle"] == pytest.approx(math.log(10))


def test_zero_state(spark):
    rows = [(0.0, 0.1, 0.8), (0.0, 0.0, 0.4), (1.0, 0.0, 0.7), (2.0, 2.0, 0.2)]
    df = spark.createDataFrame(rows, "y double, p double, z double")
    row = metrics.zero_state_metrics(df, "y", "p", "z").first().asDict()
    assert [row[f"zero_{n}_count"] for n in ("true_positive", "false_positive", "false_negative", "true_negative")] == [1] * 4
    for rate in ("accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate"):
        assert row[f"zero_{rate}"] == 0.5
    assert row["mean_prediction_on_zero"] == pytest.approx(0.05)


def test_zero_inflated_loss(spark):
    rows = [(0.0, 2.0, True), (1.0, 3.0, True), (0.0, 999.0, False), (1.0, 999.0, False), (0.0, 4.0, True), (2.0, 5.0, True)]
    df = spark.createDataFrame(rows, "y double, p double, seen boolean").withColumn("logit", F.lit(0.0))
    row = metrics.zero_inflated_loss(df, "y", "p", "logit", "seen").first()
    assert (row["observed_count"], row["zero_count"], row["positive_count"]) == (4, 2, 2)
    assert row["zero_classification_loss"] == pytest.approx(math.log(2))
    assert row["positive_regression_loss"] == pytest.approx(2.25)
    assert row["zero_suppression_loss"] == pytest.approx(2.95)
    assert row["loss"] == pytest.approx(5.893147, abs=1e-6)
    empty = metrics.zero_inflated_loss(df.withColumn("seen", F.lit(False)), "y", "p", "logit", "seen").first()
    assert empty["loss"] == 0.0 and metrics.masked_mse(df.withColumn("seen", F.lit(False)), "y", "p", "seen").first()[0] == 0.0


def test_pooling_and_merging_equal_scoring_together(spark):
    df = spark.range(200).select(
        (F.col("id") % 3).alias("meter"), (F.col("id") % 7).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("p")
    )
    whole = metrics.regression_metrics(df, "y", "p").first().asDict()
    parts = metrics.error_sums(df, "y", "p", ["meter"])
    merged = metrics.finish_metrics(metrics.merge_sums(parts)).first().asDict()
    pooled = metrics.pool_metrics(metrics.finish_metrics(parts), []).first().asDict()
    for name in metrics.METRICS:
        assert merged[name] == pytest.approx(whole[name])
    for name in ("mse", "mae", "rmse", "rmsle"):
        assert pooled[name] == pytest.approx(whole[name])


def test_delta_and_best(spark):
    df = spark.createDataFrame([("baseline", 0.5, 0.9), ("x", 0.4, 0.9), ("y", 0.4, 0.1)], "variant string, rmsle double, r2 double")
    delta = {r["variant"]: r["delta_rmsle"] for r in metrics.delta_from_baseline(df, "rmsle").collect()}
    assert delta == pytest.approx({"baseline": 0.0, "x": -0.1, "y": -0.1})
    best = metrics.best_per_metric(metrics.long_metrics(df, ["variant"], ["rmsle", "r2"]))
    marked = {(r["metric"], r["variant"]) for r in best.collect() if r["is_best"]}
    assert marked == {("rmsle", "x"), ("rmsle", "y"), ("r2", "baseline"), ("r2", "x")}


def test_profile_fallbacks(spark):
    schema = "building_id int, meter int, day_week int, hour_datetime int, meter_reading double"
    train = spark.createDataFrame([(1, 0, 1, 8, 0.2), (1, 0, 1, 8, 0.4), (1, 0, 2, 9, 0.6), (2, 0, 1, 8, 0.8)], schema)
    ask = spark.createDataFrame([(1, 0, 1, 8, 0.0), (1, 0, 5, 8, 0.0), (3, 0, 1, 8, 0.0), (9, 7, 0, 0, 0.0)], schema)
    got = {r["building_id"] * 10 + r["day_week"]: (r["prediction"], r["level"]) for r in predict_profile(fit_profile(train), ask).collect()}
    assert got[11] == (pytest.approx(0.3), "building_meter_weekday_hour")
    assert got[15] == (pytest.approx(0.3), "building_meter_hour")
    assert got[31] == (pytest.approx(0.46666667), "meter_weekday_hour")
    assert got[90] == (pytest.approx(0.5), "global_mean")
