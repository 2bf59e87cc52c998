"""Boosted trees, batch scoring, model selection and rolled-out forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelworks.functions.calendar import HOUR
from panelworks.functions.scaling import clip, to_number
from panelworks.operators import metrics
from panelworks.operators.rollout import LinearWindow, roll_out_windows
from panelworks.scale import cut_lineage


@dataclass
class TreeModel:
    """A fitted boosted-tree model with its feature names."""

    features: list[str]
    model: object
    history: DataFrame | None = None

    def score(self, df: DataFrame, low: float | None = 0.0, high: float | None = 1.0, output="prediction") -> DataFrame:
        """Add the clipped prediction."""
        ready = _assembled(df, self.features)
        scored = self.model.transform(ready)
        return scored.withColumn(output, clip(F.col("_raw"), low, high)).drop("_x", "_raw")

    def importances(self, spark) -> DataFrame:
        """Gain importance per feature."""
        values = self.model.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, values)), "feature string, importance double")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    # trees send missing values to one side: a value below every real one does that
    filled = {f"_{c}": F.coalesce(to_number(F.col(c)), F.lit(-999.0)) for c in features}
    ready = VectorAssembler(inputCols=list(filled), outputCol="_x").transform(df.withColumns(filled))
    return ready.drop(*filled)


def staged_choice(history: DataFrame, patience: int) -> DataFrame:
    """The best round of a staged history (round, error), given up after ``patience`` rounds without a new best.

    One row: ``best_round``, ``best_error``, and ``stopped``, whether the history is long enough to give up. What lies beyond the
    round at which patience ends does not count, however good; of equal errors the first wins. A history has a row per round.
    """
    in_order = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    best = F.min(F.struct("error", "round")).over(in_order)
    waited = history.withColumn("_best", best).withColumn("_waited", F.col("round") - F.col("_best.round"))
    seen = waited.withColumn("_over", F.max(F.when(F.col("_waited") >= patience, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    kept = seen.filter(F.coalesce(F.col("_over"), F.lit(0)) == 0)
    last = F.max_by(F.struct("_best", "_waited"), "round")
    return kept.agg(last.alias("_last")).select(
        F.col("_last._best.round").alias("best_round"), F.col("_last._best.error").alias("best_error"), (F.col("_last._waited") >= patience).alias("stopped")
    )


def first_trees(fitted: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The ensemble of the first ``count`` rounds."""
    java, gateway = fitted._java_obj, SparkSession.active().sparkContext._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for k, (tree, weight) in enumerate(zip(list(java.trees())[:count], list(java.treeWeights())[:count])):
        trees[k], weights[k] = tree, weight
    cut = GBTRegressionModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{fitted.uid}_{count}", trees, weights, java.numFeatures()))
    return cut.setFeaturesCol(fitted.getFeaturesCol()).setPredictionCol(fitted.getPredictionCol())


def fit_boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    depth: int = 10,
    rounds: int = 3000,
    step: float = 0.05,
    subsample: float = 0.8,
    feature_subset: str = "0.8",
    max_bins: int = 256,
    seed: int = 42,
    patience: int = 100,
) -> TreeModel:
    """Boosted regression trees on the training rows, up to the round with the least error on the validation rows.

    The search is given up after ``patience`` rounds without gain, or at ``rounds``. The fit starts with twice the patience and
    is repeated with twice the rounds while that is not enough; rounds that were fitted before come out the same, since each
    takes its seed from its number. ``history`` of the result has the validation error after every round.
    """
    known = df.filter("split IN ('train', 'valid')")
    ready = cut_lineage(_assembled(known, features).select("_x", F.col(target).cast("double").alias("_y"), "split"), "trees")
    train, valid = ready.filter("split = 'train'"), ready.filter("split = 'valid'")
    count = min(rounds, 2 * patience)
    while True:
        fitted = GBTRegressor(
            featuresCol="_x", labelCol="_y", predictionCol="_raw", maxDepth=depth, maxIter=count, stepSize=step,
            subsamplingRate=subsample, featureSubsetStrategy=feature_subset, maxBins=max_bins, seed=seed,
        ).fit(train)
        errors = fitted.evaluateEachIteration(valid, "squared")
        history = df.sparkSession.createDataFrame([(k, float(e)) for k, e in enumerate(errors, 1)], "round int, error double").coalesce(1)
        choice = staged_choice(history, patience).first()
        if choice["stopped"] or count >= rounds:
            break
        count = min(rounds, 2 * count)
    return TreeModel(list(features), first_trees(fitted, choice["best_round"]), history)


def fit_boosted_trees_by_key(df: DataFrame, key: str, features: Sequence[str], target: str, **options) -> dict[object, TreeModel]:
    """One ensemble per value of ``key`` (a meter: few values), each stopped by validation rows of its own."""
    values = [r[0] for r in df.filter("split = 'train'").select(key).distinct().orderBy(key).collect()]
    return {v: fit_boosted_trees(df.filter(F.col(key) == F.lit(v)), features, target, **options) for v in values}


def score_by_key(df: DataFrame, key: str, fitted: dict[object, TreeModel], **options) -> DataFrame:
    """Every row scored by the model of its key; rows of other keys are left out."""
    parts = [model.score(df.filter(F.col(key) == F.lit(v)), **options) for v, model in fitted.items()]
    return reduce(DataFrame.unionByName, parts)


def measure_family(scored: DataFrame, target: str, groups: Sequence[str]) -> DataFrame:
    """Metrics of every model of a scored family."""
    return metrics.regression_metrics(scored, target, "prediction", [*groups, "variant", "alpha"])


def score_and_measure(model, df: DataFrame, target: str, groups: Sequence[str] = ("split",)) -> DataFrame:
    """Batch scoring followed by the metrics of each group."""
    return metrics.regression_metrics(model.score(df), target, "prediction", groups)


def select_best(scores: DataFrame, candidate: str, score: str = "rmse", groups: Sequence[str] = ()) -> DataFrame:
    """The candidate with the lowest validation score; the first candidate wins a tie."""
    best = F.min_by(F.struct(candidate, score), F.struct(score, candidate))
    return scores.groupBy(*groups).agg(best.alias("_best")).select(*groups, "_best.*")


def roll_out_forecast(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target: str,
    weights: Sequence[float],
    intercept: float = 0.0,
    split: str = "test",
    write_back: tuple[float, float] | None = None,
    step_seconds: int = HOUR,
) -> DataFrame:
    """Autoregressive forecast of one split: each prediction becomes history for the next hour.

    ``weights[0]`` belongs to the hour just before. A row is predicted when its run, counted through
    earlier splits, has enough rows before it; other rows keep their measured value as history, and a
    gap starts over. See ``rollout.roll_out_windows``, of which this is the case without further features.
    """
    oldest_first = [[w] for w in list(weights)[::-1]]
    rolled = roll_out_windows(
        df, keys, ts, target, [], LinearWindow(oldest_first, intercept), len(oldest_first), split, write_back, step_seconds
    )
    return rolled.filter(F.col("prediction").isNotNull())
