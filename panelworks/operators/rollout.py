"""Roll-out of models on windows of all features: predictions become history, the other features stay as measured."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelworks.functions.calendar import HOUR
from panelworks.functions.scaling import clip
from panelworks.operators import metrics
from panelworks.operators.continuity import contiguous_runs

# Windows (rows, hours, columns), the oldest hour first and the target in column 0, to one value per row.
Predict = Callable[[np.ndarray], np.ndarray]

# Bytes of windows that one task may hold.
STATE_BYTES = 128 << 20


class LinearWindow:
    """A linear model on the flattened window."""

    def __init__(self, weights: Sequence[Sequence[float]], intercept: float = 0.0) -> None:
        self.weights, self.intercept = np.asarray(weights, dtype=float), float(intercept)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        return windows.reshape(len(windows), -1) @ self.weights.ravel() + self.intercept


class Histories:
    """The last ``window`` rows of each series of a task, as rings in one array (series, window, columns)."""

    def __init__(self, window: int, width: int) -> None:
        self.window, self.slots = window, {}
        self.rings = np.zeros((0, window, width))

    def slots_of(self, keys: pd.DataFrame) -> np.ndarray:
        """Place of each row's series; new series get new places."""
        code, names = pd.MultiIndex.from_frame(keys).factorize()
        known = [self.slots.setdefault(name, len(self.slots)) for name in names.tolist()]
        if len(self.slots) > len(self.rings):
            more = np.zeros((max(len(self.slots), 2 * len(self.rings)) - len(self.rings), *self.rings.shape[1:]))
            self.rings = np.concatenate([self.rings, more])
        return np.asarray(known, dtype=np.int64)[code]

    def windows(self, slots: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The rows before ``places`` of each series, the oldest first."""
        return self.rings[slots[:, None], (places[:, None] + np.arange(self.window)) % self.window]

    def write(self, slots: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
        self.rings[slots, places % self.window] = rows


def _roll(keys: list[str], ts: str, columns: list[str], predict: Predict, window: int, write_back: tuple[float, float] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The rows of a task come hour by hour; all its series take a step together.
        held = Histories(window, len(columns))
        for batch in batches:
            slots, places = held.slots_of(batch[keys]), batch["_place"].to_numpy()
            values, wanted = batch[columns].to_numpy(float), batch["_predict"].to_numpy(bool)
            hours = batch[ts].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], hours[1:] != hours[:-1]])) if len(batch) else []
            forecast = np.full(len(batch), np.nan)
            for first, last in zip(starts, [*starts[1:], len(batch)], strict=True):
                rows = np.arange(first, last)
                asked = rows[wanted[first:last]]
                if len(asked):
                    guess = predict(held.windows(slots[asked], places[asked]))
                    guess = np.where(np.isfinite(guess), guess, 0.0)
                    forecast[asked] = guess
                    values[asked, 0] = guess if write_back is None else np.clip(guess, *write_back)
                held.write(slots[rows], places[rows], values[rows])
            yield batch.drop(columns=["_predict", "_place", "_needed"]).assign(prediction=forecast)[batch["_needed"].to_numpy(bool)]

    return run


def roll_out_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target: str,
    features: Sequence[str],
    predict: Predict,
    window: int,
    split: str = "test",
    write_back: tuple[float, float] | None = None,
    step_seconds: int = HOUR,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``split`` with its ``prediction``, null for a row without a full window before it.

    A row's window is the ``window`` rows of its run, counted through earlier splits. Real features enter it as they are;
    the target enters as measured before the first prediction of a run and as predicted, limited to ``write_back``, from then
    on. A gap starts over, so the rows after it are history until the window is full again. Columns of ``carry`` pass through.
    Series are spread over enough tasks that their windows fit; a task steps through time with all its series at once.
    """
    keys, columns = list(keys), [target, *features]
    span = df.filter(F.col("split") == split).agg(F.min(ts).alias("first"), F.max(ts).alias("last")).first()
    kind = df.schema[ts].dataType
    # The split and the window before it are all that can matter, and the bounds reach the scan.
    earliest = F.lit(span["first"]).cast(kind) - F.make_dt_interval(secs=F.lit(window * step_seconds))
    recent = df.filter((F.col(ts) >= earliest) & (F.col(ts) <= F.lit(span["last"]).cast(kind)))
    runs = contiguous_runs(recent.select(*keys, ts, *columns, "split", *carry), keys, ts, step_seconds)
    place, own = F.col("run_position"), F.col("split") == split
    rows = runs.select(
        *keys, ts, *(F.col(c).cast("double").alias(c) for c in columns), "split", *carry,
        (own & (place >= window)).alias("_predict"), place.cast("long").alias("_place"), own.alias("_needed"),
    )
    series = recent.select(F.approx_count_distinct(F.struct(*keys))).first()[0]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-series * window * len(columns) * 8 // STATE_BYTES))
    ordered = rows.repartition(parts, *keys).sortWithinPartitions(ts, *keys)
    schema = T.StructType([f for f in rows.schema.fields if not f.name.startswith("_")] + [T.StructField("prediction", T.DoubleType())])
    rolled = ordered.mapInPandas(_roll(keys, ts, columns, predict, window, write_back), schema)
    return rolled.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def roll_out_scores(
    rolled: DataFrame,
    actual: str,
    ts: str,
    groups: Sequence[str] = (),
    limits: tuple[float, float] | None = None,
    known: Column | None = None,
) -> DataFrame:
    """Error metrics of the predicted rows with the counters of a roll-out, per group, from one pass.

    Counters: evaluated, skipped (no full window before it, or a series that is not known) and unknown rows, and the
    timestamps with an evaluated row. ``limits`` clip a prediction before it is scored.
    """
    groups = list(groups)
    value = F.col("prediction") if limits is None else clip(F.col("prediction"), *limits)
    flagged = rolled.withColumns({"prediction": value, "_evaluated": value.isNotNull(), "_known": F.lit(True) if known is None else known})
    sums = metrics.error_sums(flagged, actual, "prediction", [*groups, ts, "_evaluated", "_known"])
    hourly = sums.groupBy(*groups, ts).agg(
        *(F.sum(F.when(F.col("_evaluated"), F.col(s))).alias(s) for s in metrics.SUMS),
        F.sum(F.when(~F.col("_evaluated"), F.col("n")).otherwise(0)).alias("_skipped"),
        F.sum(F.when(~F.col("_known"), F.col("n")).otherwise(0)).alias("_unknown"),
    )
    total = hourly.groupBy(*groups).agg(
        *(F.sum(s).alias(s) for s in metrics.SUMS),
        F.sum("_skipped").alias("skipped_row_count"), F.sum("_unknown").alias("unknown_row_count"), F.count("n").alias("evaluated_timestamp_count"),
    )
    return metrics.finish_metrics(total).withColumn("evaluated_row_count", F.coalesce("evaluated_row_count", F.lit(0)))
