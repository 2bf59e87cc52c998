"""Queries over forecast-error and zero-state metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded
from panelworks.catalogue.sql import ZERO_INFLATED, metrics_of, split_of, sums_of, with_
from panelworks.operators import metrics, splits
from panelworks.sources import stand_ins

MODELS = {"discount": "predicted", "shifted": "predicted + 0.01", "half": "predicted / 2"}
LONG_SQL = "long AS (SELECT * FROM scored UNPIVOT (value FOR metric IN (mse, mae, rmse, r2, smape, rmsle)))"
SCORED = "scored AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS model, * FROM ({metrics_of('zero_inflated', 'actual', f'({p})', ['meter'])})" for name, p in MODELS.items()
) + ")"


def scored_models(spark: SparkSession, folder: str, groups=("meter",)) -> DataFrame:
    """Metrics of three made-up forecasts of the tax rate, from one scan."""
    rows = stand_ins.zero_inflated(spark, folder)
    variants = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(p).alias("forecast")) for n, p in MODELS.items()])
    each = rows.select("actual", *[g for g in groups], F.inline(variants))
    return rounded(metrics.regression_metrics(each, "actual", "forecast", ["model", *groups]))


@query("regression_metrics", with_(ZERO_INFLATED, metrics_of("zero_inflated", "actual", "predicted", ["meter", "part"])))
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.regression_metrics(stand_ins.zero_inflated(spark, folder), "actual", "predicted", ["meter", "part"]))


@query("mergeable_metrics", with_(ZERO_INFLATED, metrics_of("zero_inflated", "actual", "predicted", ["meter"])))
def mergeable_metrics(spark: SparkSession, folder: str) -> DataFrame:
    daily = metrics.error_sums(stand_ins.zero_inflated(spark, folder), "actual", "predicted", ["meter", "timestamp"])
    return rounded(metrics.finish_metrics(metrics.merge_sums(daily, ["meter"])))


@query("raw_scale_metrics", with_(ZERO_INFLATED, """
raw AS (SELECT meter, exp(actual * 6 + 1) - 1 AS actual, exp(predicted * 6 + 1) - 1 AS predicted FROM zero_inflated)""",
metrics_of("raw", "actual", "predicted", ["meter"])))
def raw_scale_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder).withColumns({"target_min": F.lit(1.0), "target_max": F.lit(7.0)})
    return rounded(metrics.raw_scale_metrics(rows, "actual", "predicted", ["meter"]))


@query("zero_state_metrics", with_(ZERO_INFLATED, """
counts AS (SELECT meter, count(*) FILTER (WHERE actual <= 0 AND zero_probability >= 0.5) AS tp,
  count(*) FILTER (WHERE actual > 0 AND zero_probability >= 0.5) AS fp, count(*) FILTER (WHERE actual <= 0 AND zero_probability < 0.5) AS fn,
  count(*) FILTER (WHERE actual > 0 AND zero_probability < 0.5) AS tn, sum(predicted) FILTER (WHERE actual <= 0) AS on_zero
  FROM zero_inflated GROUP BY 1)""", """
rates AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM counts)""", """
SELECT meter, tp AS zero_true_positive_count, fp AS zero_false_positive_count, fn AS zero_false_negative_count, tn AS zero_true_negative_count,
  round((tp + tn) / (tp + fp + fn + tn), 6) AS zero_accuracy, round(p, 6) AS zero_precision, round(r, 6) AS zero_recall,
  round(2 * p * r / (p + r), 6) AS zero_f1, round(fp / (fp + tn), 6) AS zero_false_positive_rate,
  round(fn / (fn + tp), 6) AS zero_false_negative_rate, round(on_zero / (tp + fn), 6) AS mean_prediction_on_zero FROM rates"""))
def zero_state_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder)
    return rounded(metrics.zero_state_metrics(rows, "actual", "predicted", "zero_probability", ["meter"]))


@query("thresholded_metrics", with_(ZERO_INFLATED, """
hard AS (SELECT part, actual, CASE WHEN zero_probability >= 0.5 THEN 0 ELSE predicted END AS predicted FROM zero_inflated)""",
f"""scored AS ({metrics_of("hard", "actual", "predicted", ["part"])})""", """
SELECT part, mse AS thresholded_mse, mae AS thresholded_mae, rmse AS thresholded_rmse, r2 AS thresholded_r2, smape AS thresholded_smape,
  rmsle AS thresholded_rmsle, evaluated_row_count FROM scored"""))
def thresholded_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder)
    return rounded(metrics.thresholded_metrics(rows, "actual", "predicted", "zero_probability", ["part"]))


@query("zero_inflated_loss", with_(ZERO_INFLATED, """
parts AS (SELECT meter,
  avg(CASE WHEN actual <= 0 THEN 3 * ln(1 + exp(-zero_logit)) ELSE ln(1 + exp(zero_logit)) END) FILTER (WHERE observed) AS c,
  avg(CASE WHEN abs(predicted - actual) < 0.5 THEN (predicted - actual) * (predicted - actual) ELSE abs(predicted - actual) - 0.25 END)
    FILTER (WHERE observed AND actual > 0) AS p,
  avg(CASE WHEN predicted < 0.1 THEN predicted * predicted / 0.2 ELSE predicted - 0.05 END) FILTER (WHERE observed AND actual <= 0) AS z,
  count(*) FILTER (WHERE observed) AS observed_count, count(*) FILTER (WHERE observed AND actual <= 0) AS zero_count,
  count(*) FILTER (WHERE observed AND actual > 0) AS positive_count FROM zero_inflated GROUP BY 1)""", """
SELECT meter, round(c, 6) AS zero_classification_loss, round(p, 6) AS positive_regression_loss, round(z, 6) AS zero_suppression_loss,
  observed_count, zero_count, positive_count, round(c + p + z, 6) AS loss FROM parts"""))
def zero_inflated_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder)
    return rounded(
        metrics.zero_inflated_loss(rows, "actual", "predicted", "zero_logit", "observed", ["meter"], positive_weight=3.0)
    )


@query("masked_mse", with_(ZERO_INFLATED, """
SELECT meter, part, round(sum((predicted - actual) * (predicted - actual)) FILTER (WHERE observed) / greatest(count(*) FILTER (WHERE observed), 1), 6) AS masked_mse,
  count(*) FILTER (WHERE observed) AS masked_count FROM zero_inflated GROUP BY 1, 2"""))
def masked_mse(spark: SparkSession, folder: str) -> DataFrame:
    rows = stand_ins.zero_inflated(spark, folder)
    return rounded(metrics.masked_mse(rows, "actual", "predicted", "observed", ["meter", "part"]))


EXACT_SCORED = f"""scored AS (SELECT meter, part, sse / n AS mse, sae / n AS mae, sqrt(sse / n) AS rmse, 1 - sse / (yy - y * y / n) AS r2,
  sqrt(sle / n) AS rmsle, n FROM (SELECT meter, part, {sums_of("actual", "predicted")} FROM zero_inflated GROUP BY 1, 2))"""


@query("pooled_metrics", with_(ZERO_INFLATED, EXACT_SCORED, """
SELECT part, round(sum(mse * n) / sum(n), 6) AS mse, round(sum(mae * n) / sum(n), 6) AS mae, round(sqrt(sum(rmse * rmse * n) / sum(n)), 6) AS rmse,
  round(sqrt(sum(rmsle * rmsle * n) / sum(n)), 6) AS rmsle, round(1 - sum(mse * n) / sum(mse * n / (1 - r2)), 6) AS r2,
  CAST(sum(n) AS BIGINT) AS evaluated_row_count FROM scored GROUP BY 1"""))
def pooled_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scores = metrics.regression_metrics(stand_ins.zero_inflated(spark, folder), "actual", "predicted", ["meter", "part"])
    return rounded(metrics.pool_metrics(scores, ["part"]))


@query("delta_from_baseline", with_(ZERO_INFLATED, SCORED, """
SELECT model AS variant, meter, rmsle, round(rmsle - max(CASE WHEN model = 'discount' THEN rmsle END) OVER (PARTITION BY meter), 6) AS delta_rmsle FROM scored"""))
def delta_from_baseline(spark: SparkSession, folder: str) -> DataFrame:
    scores = scored_models(spark, folder).select(F.col("model").alias("variant"), "meter", "rmsle")
    return rounded(metrics.delta_from_baseline(scores, "rmsle", baseline="discount", groups=["meter"]))


@query("best_model_per_metric", with_(ZERO_INFLATED, SCORED, LONG_SQL, """
costs AS (SELECT *, CASE WHEN metric = 'r2' THEN -value ELSE value END AS cost FROM long)""", """
SELECT model, meter, metric, value, cost = min(cost) OVER (PARTITION BY meter, metric) AS is_best FROM costs"""))
def best_model_per_metric(spark: SparkSession, folder: str) -> DataFrame:
    long = metrics.long_metrics(scored_models(spark, folder), ["model", "meter"])
    return metrics.best_per_metric(long, ["meter"])


@query("model_alignment", with_(ZERO_INFLATED, SCORED, LONG_SQL, """
SELECT meter, metric, max(value) FILTER (WHERE model = 'discount') AS discount, max(value) FILTER (WHERE model = 'shifted') AS shifted,
  max(value) FILTER (WHERE model = 'half') AS half FROM long GROUP BY 1, 2"""))
def model_alignment(spark: SparkSession, folder: str) -> DataFrame:
    long = metrics.long_metrics(scored_models(spark, folder), ["model", "meter"])
    return metrics.align_models(long, list(MODELS), ["meter"])


@query("model_comparison", with_(ZERO_INFLATED, split_of("zero_inflated", ["meter"]), " UNION ALL ".join(
    f"SELECT '{n}' AS model, * FROM ({metrics_of('(SELECT * FROM prepared)', 'actual', f'({p})', ['meter', 'split'])}) WHERE split <> 'train'"
    for n, p in MODELS.items())))
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.time_split(stand_ins.zero_inflated(spark, folder), "timestamp", ["meter"]).filter("split <> 'train'")
    variants = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(p).alias("forecast")) for n, p in MODELS.items()])
    each = rows.select("actual", "meter", "split", F.inline(variants))
    return rounded(metrics.regression_metrics(each, "actual", "forecast", ["model", "meter", "split"]))
