"""Ridge regression: one model, or a whole family of models from a single pass over the data."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F, types as T

from panelworks.functions.scaling import clip, to_number
from panelworks.operators.splits import fit_imputed_scaler, standardise
from panelworks.scale import attach, cut_lineage


@dataclass
class LinearModel:
    """Weights of a linear forecast on standardised features."""

    features: list[str]
    weights: list[float]
    intercept: float
    scaler: dict[str, tuple[float, float]]

    def score(self, df: DataFrame, low: float | None = 0.0, high: float | None = 1.0, output="prediction") -> DataFrame:
        """Add the clipped prediction; the features of ``df`` stay unscaled."""
        renamed = {f"_{c}": F.col(c) for c in self.features}
        ready = standardise(df.withColumns(renamed), {f"_{c}": v for c, v in self.scaler.items()}, impute_first=True)
        terms = [F.col(f"_{c}") * F.lit(w) for c, w in zip(self.features, self.weights)]
        value = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return ready.withColumn(output, clip(value, low, high)).drop(*renamed)


def fit_ridge(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0) -> LinearModel:
    """Ridge regression on mean-imputed, standardised features of the training rows.

    The penalty is ``alpha`` times the squared weights against the plain sum of squared errors, with
    an unpenalised intercept; the regularisation parameter is rescaled to that convention. A feature that is constant
    over the training rows has weight 0.
    """
    features = list(features)
    stats = {row["column"]: row for row in fit_imputed_scaler(df, [*features, target]).collect()}
    scaler = {c: (stats[c]["mean"], stats[c]["std"]) for c in features}
    n, mean, spread = stats[target]["row_count"], stats[target]["mean"], stats[target]["spread"]
    if not n:
        raise ValueError("no training rows")
    varying = [c for c in features if stats[c]["spread"] > 0]
    if not spread or not varying:
        return LinearModel(features, [0.0] * len(features), float(mean), scaler)
    train = standardise(df.filter("split = 'train'").select(*varying, target), {c: scaler[c] for c in varying}, impute_first=True)
    ready = VectorAssembler(inputCols=varying, outputCol="_x").transform(train).select("_x", target)
    fitted = LinearRegression(
        featuresCol="_x", labelCol=target, solver="normal", elasticNetParam=0.0, standardization=False,
        regParam=alpha * spread / n,
    ).fit(ready)
    found = dict(zip(varying, fitted.coefficients))
    return LinearModel(features, [float(found.get(c, 0.0)) for c in features], float(fitted.intercept), scaler)


def lag_weights(model: LinearModel) -> tuple[list[float], float]:
    """Weights and intercept of a lag model on unscaled values, as the roll-out needs them."""
    raw = [w / model.scaler[c][1] for c, w in zip(model.features, model.weights)]
    shift = sum(w * model.scaler[c][0] for c, w in zip(model.features, raw))
    return raw, model.intercept - shift


def _sum_products(keys: list[str], columns: list[str]):
    """Per partition and key, the cross products of all columns, accumulated over the batches."""

    def accumulate(batches):
        totals = {}
        for batch in batches:
            groups = batch.groupby(keys, dropna=False) if keys else [((), batch)]
            for key, rows in groups:
                values = rows[columns].to_numpy(float)
                product = values.T @ values
                totals[key] = totals[key] + product if key in totals else product
        for key, product in totals.items():
            out = pd.DataFrame({"_cells": [product.ravel().tolist()]})
            for name, value in zip(keys, key):
                out[name] = value
            yield out[[*keys, "_cells"]]

    return accumulate


def _solver(keys: list[str], features: list[str], variants: dict[str, list[str]], alphas: list[float]):
    """Each row is one key with its statistics and cross products; it becomes one row per variant and penalty."""
    width = len(features) + 1

    def solve(batches):
        for batch in batches:
            fitted = {name: [] for name in [*keys, "variant", "alpha", "intercept", "weights", "means"]}
            for row in batch.to_dict("records"):
                matrix = np.zeros(width * width)
                matrix[[c["cell"] for c in row["_cells"]]] = [c["value"] for c in row["_cells"]]
                matrix = matrix.reshape(width, width)
                stds = np.array([row[f"_std_{c}"] for c in features])
                for name, chosen in variants.items():
                    places = [features.index(c) for c in chosen]
                    block, moment = matrix[np.ix_(places, places)], matrix[places, -1]
                    for alpha in alphas:
                        weights = np.zeros(len(features))
                        weights[places] = np.linalg.solve(block + alpha * np.eye(len(places)), moment)
                        weights = np.divide(weights, stds, out=np.zeros(len(features)), where=stds > 0)
                        for column, value in zip(
                            fitted,
                            [*(row[k] for k in keys), name, alpha, row["_y_mean"], weights.tolist(), [row[f"_mean_{c}"] for c in features]],
                        ):
                            fitted[column].append(value)
            yield pd.DataFrame(fitted)

    return solve


def fit_ridge_family(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    alphas: Iterable[float] = (1.0,),
    keys: Sequence[str] = (),
    variants: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Ridge models for every key, penalty and feature subset.

    All of them need only the cross products of the standardised training columns: they are summed
    per key in one pass, and the small systems of each key are solved by the task that holds its sums,
    so there may be as many keys as there are groups. The result has one row per model: ``keys``,
    ``variant``, ``alpha``, ``intercept``, and per feature its weight on the raw value and the mean
    that replaces a missing one. Keys are not null.
    """
    features, keys = list(features), list(keys)
    variants = {name: list(chosen) for name, chosen in ({"all": features} if variants is None else variants).items()}
    train = df.filter("split = 'train'").select(
        *keys, *[to_number(F.col(c)).alias(c) for c in features], F.col(target).cast("double").alias("_y")
    )
    facts = [F.count("*").alias("_n"), F.avg("_y").alias("_y_mean")]
    for c in features:
        # filling gaps with the mean adds no squared deviation, it only spreads the sum over all rows
        facts += [
            F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_mean_{c}"),
            F.coalesce(F.sqrt(F.var_pop(c) * F.count(c) / F.count("*")), F.lit(0.0)).alias(f"_std_{c}"),
        ]
    stats = cut_lineage(train.groupBy(*keys).agg(*facts).filter("_n > 0"), "ridge-statistics")
    if stats.isEmpty():
        raise ValueError("no training rows")
    if keys:
        joined = train.join(stats, keys)
    else:
        only = stats.first()
        joined = train.withColumns({c: F.lit(only[c]) for c in stats.columns})
    deviations = [
        F.when(F.col(f"_std_{c}") > 0, (F.coalesce(F.col(c), F.col(f"_mean_{c}")) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}"))
        .otherwise(0.0)
        .alias(c)
        for c in features
    ]
    columns = [*features, "_y"]
    ready = joined.select(*keys, *deviations, (F.col("_y") - F.col("_y_mean")).alias("_y"))
    schema = T.StructType([*[train.schema[k] for k in keys], T.StructField("_cells", T.ArrayType(T.DoubleType()))])
    partial = ready.mapInPandas(_sum_products(keys, columns), schema)
    summed = (
        partial.select(*keys, F.posexplode("_cells").alias("cell", "_value"))
        .groupBy(*keys, "cell")
        .agg(F.sum("_value").alias("value"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("cell", "value")).alias("_cells"))
    )
    model_schema = T.StructType(
        [
            *[train.schema[k] for k in keys],
            T.StructField("variant", T.StringType()), T.StructField("alpha", T.DoubleType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("means", T.ArrayType(T.DoubleType())),
        ]
    )
    each = summed.join(stats, keys) if keys else summed.withColumns({c: F.lit(only[c]) for c in stats.columns})
    return each.mapInPandas(_solver(keys, features, variants, [float(a) for a in alphas]), model_schema)


def score_ridge_family(
    df: DataFrame,
    family: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = (),
    low: float | None = 0.0,
    high: float | None = 1.0,
) -> DataFrame:
    """Every row scored by every model of its key, in one pass: adds variant, alpha and prediction."""
    keys = list(keys)
    models = family.groupBy(*keys).agg(F.collect_list(F.struct("variant", "alpha", "intercept", "weights", "means")).alias("_models"))
    if keys:
        each = attach(df, models, keys, "inner")
    else:
        each = df.withColumn("_models", models.select("_models").scalar())
    unfolded = each.select(*df.columns, F.explode("_models").alias("_m"))
    value = F.col("_m.intercept")
    for place, name in enumerate(features):
        mean = F.col("_m.means")[place]
        value = value + F.col("_m.weights")[place] * (F.coalesce(to_number(F.col(name)), mean) - mean)
    return unfolded.select(
        *df.columns, F.col("_m.variant").alias("variant"), F.col("_m.alpha").alias("alpha"),
        clip(value, low, high).alias("prediction"),
    )
