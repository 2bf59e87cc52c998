"""Forecast-error and zero-state metrics, all from one pass of mergeable sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.functions.scaling import clip, hard_threshold, inverse_log_minmax, safe_ratio

METRICS = ("mse", "mae", "rmse", "r2", "smape", "rmsle")
SUMS = ("n", "sse", "sae", "smape_sum", "sle", "y_sum", "y_squared_sum")


def error_sums(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Running sums per group; they can be added up over batches, splits or days."""
    y, p = F.col(actual), F.col(predicted)
    error = p - y
    log_error = F.log1p(clip(p, low=0.0)) - F.log1p(clip(y, low=0.0))
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.sum(error * error).alias("sse"),
        F.sum(F.abs(error)).alias("sae"),
        F.sum(safe_ratio(2 * F.abs(error), F.abs(y) + F.abs(p))).alias("smape_sum"),
        F.sum(log_error * log_error).alias("sle"),
        F.sum(y).alias("y_sum"),
        F.sum(y * y).alias("y_squared_sum"),
    )


def merge_sums(sums: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Roll sums up to coarser groups."""
    return sums.groupBy(*groups).agg(*[F.sum(name).alias(name) for name in SUMS])


def finish_metrics(sums: DataFrame) -> DataFrame:
    """Metrics from sums; r2 is 0 where the target does not vary."""
    n = F.col("n")
    spread = F.col("y_squared_sum") - F.col("y_sum") * F.col("y_sum") / n
    return sums.select(
        *[c for c in sums.columns if c not in SUMS],
        (F.col("sse") / n).alias("mse"),
        (F.col("sae") / n).alias("mae"),
        F.sqrt(F.col("sse") / n).alias("rmse"),
        F.when(spread <= 0, 0.0).otherwise(1 - F.col("sse") / spread).alias("r2"),
        (F.col("smape_sum") / n * 100).alias("smape"),
        F.sqrt(F.col("sle") / n).alias("rmsle"),
        n.alias("evaluated_row_count"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """All regression metrics per group."""
    return finish_metrics(error_sums(df, actual, predicted, groups))


def raw_scale(df: DataFrame, columns: Sequence[str], low: str = "target_min", high: str = "target_max") -> DataFrame:
    """Take scaled columns back to the measured scale."""
    return df.withColumns({c: inverse_log_minmax(F.col(c), F.col(low), F.col(high)) for c in columns})


def raw_scale_metrics(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = ()) -> DataFrame:
    """Metrics after the inverse transform of actual and predicted values."""
    return regression_metrics(raw_scale(df, [actual, predicted]), actual, predicted, groups)


def thresholded_metrics(
    df: DataFrame, actual: str, predicted: str, zero_probability: str, groups: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Metrics of the hard-thresholded prediction, named with the prefix ``thresholded_``."""
    hard = df.withColumn(predicted, hard_threshold(F.col(predicted), F.col(zero_probability), threshold))
    scored = regression_metrics(hard, actual, predicted, groups)
    return scored.withColumnsRenamed({m: f"thresholded_{m}" for m in METRICS})


def zero_state_metrics(
    df: DataFrame, actual: str, predicted: str, zero_probability: str, groups: Sequence[str] = (), threshold: float = 0.5
) -> DataFrame:
    """Confusion counts and rates with the zero state as the positive class."""
    is_zero = F.col(actual) <= 0
    said_zero = F.col(zero_probability) >= threshold
    counts = df.groupBy(*groups).agg(
        F.count_if(is_zero & said_zero).alias("tp"),
        F.count_if(~is_zero & said_zero).alias("fp"),
        F.count_if(is_zero & ~said_zero).alias("fn"),
        F.count_if(~is_zero & ~said_zero).alias("tn"),
        F.coalesce(F.sum(F.when(is_zero, F.col(predicted))), F.lit(0.0)).alias("_on_zero"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return counts.select(
        *groups,
        tp.alias("zero_true_positive_count"),
        fp.alias("zero_false_positive_count"),
        fn.alias("zero_false_negative_count"),
        tn.alias("zero_true_negative_count"),
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("zero_accuracy"),
        precision.alias("zero_precision"),
        recall.alias("zero_recall"),
        safe_ratio(2 * precision * recall, precision + recall).alias("zero_f1"),
        safe_ratio(fp, fp + tn).alias("zero_false_positive_rate"),
        safe_ratio(fn, fn + tp).alias("zero_false_negative_rate"),
        safe_ratio(F.col("_on_zero"), tp + fn).alias("mean_prediction_on_zero"),
    )


def smooth_l1(error: Column, beta: float) -> Column:
    """Quadratic below ``beta``, linear above."""
    size = F.abs(error)
    return F.when(size < beta, error * error / (2 * beta)).otherwise(size - beta / 2)


def zero_inflated_loss(
    df: DataFrame,
    actual: str,
    predicted: str,
    zero_logit: str,
    observed: str,
    groups: Sequence[str] = (),
    positive_weight: float = 1.0,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Weighted cross-entropy of the zero state plus smooth-L1 parts for positive and zero targets."""
    y, p, logit = F.col(actual), F.col(predicted), F.col(zero_logit)
    seen = F.col(observed)
    zero, positive = seen & (y <= 0), seen & (y > 0)
    log_part = F.log1p(F.exp(-F.abs(logit)))
    minus_log_yes = log_part + F.greatest(-logit, F.lit(0.0))
    minus_log_no = log_part + F.greatest(logit, F.lit(0.0))
    entropy = F.when(zero, positive_weight * minus_log_yes).otherwise(minus_log_no)
    parts = df.groupBy(*groups).agg(
        F.coalesce(F.avg(F.when(seen, entropy)), F.lit(0.0)).alias("zero_classification_loss"),
        F.coalesce(F.avg(F.when(positive, smooth_l1(p - y, 0.5))), F.lit(0.0)).alias("positive_regression_loss"),
        F.coalesce(F.avg(F.when(zero, smooth_l1(p, 0.1))), F.lit(0.0)).alias("zero_suppression_loss"),
        F.count_if(seen).alias("observed_count"),
        F.count_if(zero).alias("zero_count"),
        F.count_if(positive).alias("positive_count"),
    )
    loss = (
        weights[0] * F.col("zero_classification_loss")
        + weights[1] * F.col("positive_regression_loss")
        + weights[2] * F.col("zero_suppression_loss")
    )
    return parts.withColumn("loss", loss)


def masked_mse(df: DataFrame, actual: str, predicted: str, mask: str, groups: Sequence[str] = ()) -> DataFrame:
    """Squared error over the masked rows; 0 when the mask is empty."""
    error = F.col(predicted) - F.col(actual)
    return df.groupBy(*groups).agg(
        (
            F.coalesce(F.sum(F.when(F.col(mask), error * error)), F.lit(0.0))
            / F.greatest(F.count_if(F.col(mask)), F.lit(1))
        ).alias("masked_mse"),
        F.count_if(F.col(mask)).alias("masked_count"),
    )


def zero_positive_weight(df: DataFrame, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """Positive rows per zero row; 1 where there is no zero."""
    zeros, positives = F.count_if(F.col(target) <= 0), F.count_if(F.col(target) > 0)
    return df.groupBy(*groups).agg(
        zeros.alias("zero_count"),
        positives.alias("positive_count"),
        F.when(zeros == 0, 1.0).otherwise(positives / zeros).alias("zero_positive_weight"),
    )


def pool_metrics(scores: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Row-weighted pooling of finished metrics, as if all rows had been scored together."""
    n = F.col("evaluated_row_count")
    sse = F.col("mse") * n
    sst = F.when(F.col("r2") < 1, sse / (1 - F.col("r2"))).otherwise(0.0)
    total = F.sum(n)
    return scores.groupBy(*groups).agg(
        (F.sum(sse) / total).alias("mse"),
        (F.sum(F.col("mae") * n) / total).alias("mae"),
        F.sqrt(F.sum(F.col("rmse") * F.col("rmse") * n) / total).alias("rmse"),
        F.sqrt(F.sum(F.col("rmsle") * F.col("rmsle") * n) / total).alias("rmsle"),
        F.when(F.sum(sst) != 0, 1 - F.sum(sse) / F.sum(sst)).otherwise(1.0).alias("r2"),
        total.alias("evaluated_row_count"),
    )


def delta_from_baseline(
    scores: DataFrame, score: str, variant: str = "variant", baseline: str = "baseline", groups: Sequence[str] = ()
) -> DataFrame:
    """Difference of each variant's score from the baseline variant of the same group."""
    base = F.max(F.when(F.col(variant) == baseline, F.col(score))).over(Window.partitionBy(*groups))
    return scores.withColumn(f"delta_{score}", F.col(score) - base)


def long_metrics(scores: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row per id and metric."""
    return scores.unpivot(list(ids), list(metrics), "metric", "value")


def best_per_metric(long: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Mark the best row per metric: the smallest value, for r2 the largest; ties are all marked."""
    cost = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    best = F.min(cost).over(Window.partitionBy(*groups, "metric"))
    return long.withColumn("is_best", cost == best)


def align_models(long: DataFrame, models: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Side-by-side table: one column per model."""
    return long.groupBy(*groups, "metric").pivot("model", list(models)).agg(F.first("value"))
