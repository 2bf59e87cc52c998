"""From scaled split tables to forecasts and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelworks.functions.calendar import HOUR
from panelworks.operators import metrics
from panelworks.operators.continuity import filled_panel, forward_fill
from panelworks.operators.enrich import complete_panel
from panelworks.operators.models import roll_out_forecast
from panelworks.operators.ordering import SLICE_DAYS
from panelworks.operators.profile import fit_profile, predict_profile
from panelworks.operators.ridge import fit_ridge, lag_weights
from panelworks.operators.rollout import Predict, roll_out_windows
from panelworks.operators.splits import SPLITS
from panelworks.operators.windows import lag_features
from panelworks.scale import cut_lineage


def profile_forecast(prepared: DataFrame, target: str = "meter_reading") -> DataFrame:
    """Historical-profile prediction for every row of the split tables."""
    profile = fit_profile(prepared.filter("split = 'train'"), target)
    return predict_profile(profile, prepared)


def profile_scores(prepared: DataFrame, target: str = "meter_reading", raw: bool = False) -> DataFrame:
    """Forecast error of the historical profile per meter and split, scaled or measured scale."""
    scored = profile_forecast(prepared, target)
    measure = metrics.raw_scale_metrics if raw else metrics.regression_metrics
    return measure(scored, target, "prediction", ["meter", "split"])


def autoregressive_forecast(
    prepared: DataFrame,
    keys: Sequence[str],
    window: int,
    ts: str = "timestamp",
    target: str = "meter_reading",
    alpha: float = 1.0,
    split: str = "test",
    step_seconds: int = HOUR,
    clip_to: tuple[float, float] | None = (0.0, 1.0),
) -> DataFrame:
    """Fit a lag model on training windows and roll it out over a later split."""
    train = prepared.filter("split = 'train'")
    lagged = lag_features(train, keys, ts, target, window, step_seconds=step_seconds)
    model = fit_ridge(lagged, [f"lag_{k}" for k in range(1, window + 1)], target, alpha)
    weights, intercept = lag_weights(model)
    return roll_out_forecast(prepared, keys, ts, target, weights, intercept, split, clip_to, step_seconds)


def panel_forecast(
    prepared: DataFrame,
    nodes: DataFrame,
    weights: Sequence[float],
    intercept: float = 0.0,
    entity: str = "building_id",
    ts: str = "timestamp",
    target: str = "meter_reading",
    split: str = "test",
    step_seconds: int = HOUR,
    clip_to: tuple[float, float] | None = (0.0, 1.0),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Roll a lag model out over the completed panel and return the observed cells of the split.

    The history of a node is its forward-filled reading, filled within each split. Predictions are
    written back for every node and hour of the panel, observed or not; only observed ones are scored.
    """
    rows = prepared.select(entity, ts, target, "split")
    spread = nodes.select(entity).distinct().withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    # the fill reads the panel twice, the roll-out reads the filled cells several times
    panel = cut_lineage(complete_panel(rows, spread, entity, ts, ["split"], slice_days), "panel")
    actual = panel.withColumn("_actual", F.col(target))
    filled = forward_fill(actual, [entity, "split"], ts, [target], "observed", 0.0, slice_days)
    cells = cut_lineage(filled, "filled")
    rolled = roll_out_forecast(cells, [entity], ts, target, weights, intercept, split, clip_to, step_seconds)
    return rolled.join(cells.filter("observed").select(entity, ts, F.col("_actual")), [entity, ts]).select(
        entity, ts, F.col("_actual").alias(target), "split", "prediction"
    )


def panel_window_forecast(
    prepared: DataFrame,
    nodes: DataFrame,
    features: Sequence[str],
    predict: Predict,
    window: int,
    entity: str = "building_id",
    ts: str = "timestamp",
    target: str = "meter_reading",
    split: str = "test",
    step_seconds: int = HOUR,
    clip_to: tuple[float, float] | None = (0.0, 1.0),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Roll a model on windows of the target and ``features`` out over the completed panel.

    A node that is not observed in an hour keeps its last observed features (0 before the first one, within each split), and
    its prediction as target. The result has every observed row of the split with ``prediction``, null where the panel has
    no full window before it or the node is not in ``nodes``, and ``known``: whether it is.
    """
    columns = [target, *features]
    known = nodes.select(entity).distinct()
    spread = known.withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    rows = prepared.select(entity, ts, "split", *(F.col(c).cast("double").alias(c) for c in columns))
    cells = cut_lineage(filled_panel(rows, spread, columns, ["split"], entity, ts, 0.0, slice_days), "filled")
    rolled = roll_out_windows(cells, [entity], ts, target, features, predict, window, split, clip_to, step_seconds, ["observed"])
    seen = rolled.filter("observed").select(entity, ts, target, "split", "prediction", F.lit(True).alias("known"))
    unknown = rows.filter(F.col("split") == split).join(known, entity, "left_anti")
    return seen.unionByName(unknown.select(entity, ts, target, "split", F.lit(None).cast("double").alias("prediction"), F.lit(False).alias("known")))
