"""Roll-outs of windows with all features against a plain loop."""

import datetime as dt
import math
import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from panelworks.operators.rollout import LinearWindow, roll_out_scores, roll_out_windows
from panelworks.plans.forecasting import panel_window_forecast

START = dt.datetime(2016, 1, 1)
SCHEMA = "key long, timestamp timestamp_ntz, y double, x double, z double, split string"


def at(hour):
    return START + dt.timedelta(hours=hour)


def _curved():
    def curved(windows):
        """Not linear, and not finite for some values."""
        total = np.tanh(windows[:, :, 0]).sum(axis=1) + windows[:, -1, 1] * windows[:, 0, 2]
        return np.where(windows[:, -1, 1] > 0.95, np.inf, total)

    return curved


curved = _curved()


def looped(rows, predict, window, write_back):
    """One series after the other, hour by hour."""
    out = {}
    for key in {r[0] for r in rows}:
        history, last = deque(maxlen=window), None
        for _, ts, y, x, z, split in sorted(r for r in rows if r[0] == key):
            if last is None or ts - last != dt.timedelta(hours=1):
                history.clear()
            value = y
            if split == "test":
                out[key, ts] = None
                if len(history) == window:
                    guess = float(predict(np.array([history], dtype=float))[0])
                    guess = guess if math.isfinite(guess) else 0.0
                    out[key, ts] = guess
                    value = min(max(guess, write_back[0]), write_back[1]) if write_back else guess
            history.append([value, x, z])
            last = ts
    return out


def some_rows(seed=1, series=9, hours=80):
    rng = random.Random(seed)
    rows = []
    for key in range(series):
        for h in range(hours):
            if rng.random() > 0.04 * (key % 3):
                split = "train" if h < 50 else "valid" if h < 60 else "test"
                rows.append((key, at(h), rng.random() * 2, rng.random(), rng.random() - 0.5, split))
    return rows


def rolled(df, predict, window, write_back):
    found = roll_out_windows(df, ["key"], "timestamp", "y", ["x", "z"], predict, window, write_back=write_back).collect()
    return {(r["key"], r["timestamp"]): r["prediction"] for r in found}


def same(found, wanted):
    assert set(found) == set(wanted)
    for place, value in wanted.items():
        assert (found[place] is None) == (value is None), place
        assert value is None or abs(found[place] - value) < 1e-9, place


def test_windows_of_all_features_against_a_loop(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    linear = LinearWindow([[0.1 * k, -0.2, 0.05 * k] for k in range(6)], 0.3)
    for predict, window, limits in ((curved, 4, (0.0, 1.0)), (curved, 24, None), (linear, 6, (0.0, 1.0)), (linear, 6, None)):
        wanted = looped(rows, predict, window, limits)
        assert any(v is None for v in wanted.values()) and any(v is not None for v in wanted.values())
        same(rolled(df, predict, window, limits), wanted)


def test_small_batches_give_the_same(spark):
    rows = some_rows(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        same(rolled(spark.createDataFrame(rows, SCHEMA), curved, 5, (0.0, 1.0)), looped(rows, curved, 5, (0.0, 1.0)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counters_of_a_series_with_gaps(spark):
    rows = [(1, at(h), 0.5, 0.0, 0.0, "test") for h in (0, 1, 2, 3, 5, 6, 7)]
    found = roll_out_windows(spark.createDataFrame(rows, SCHEMA), ["key"], "timestamp", "y", [], LinearWindow([[0.0], [1.0]]), 2)
    assert sorted(r["timestamp"].hour for r in found.filter("prediction is not null").collect()) == [2, 3, 7]
    scores = roll_out_scores(found, "y", "timestamp").first()
    assert (scores["evaluated_row_count"], scores["skipped_row_count"], scores["unknown_row_count"], scores["evaluated_timestamp_count"]) == (3, 4, 0, 3)
    assert scores["mse"] == 0


def test_scores_are_of_clipped_predictions(spark):
    rows = [(1, at(0), 1.0, 0.0, 0.0, "train"), (1, at(1), 1.0, 0.0, 0.0, "test"), (2, at(1), 1.0, 0.0, 0.0, "test")]
    found = roll_out_windows(spark.createDataFrame(rows, SCHEMA), ["key"], "timestamp", "y", [], LinearWindow([[5.0]]), 1)
    assert roll_out_scores(found, "y", "timestamp").first()["mse"] == 16
    clipped = roll_out_scores(found, "y", "timestamp", ["split"], (0.0, 1.0)).first()
    assert (clipped["mse"], clipped["evaluated_row_count"], clipped["skipped_row_count"]) == (0, 1, 1)
    nothing = roll_out_scores(found.filter("key = 2"), "y", "timestamp").first()
    assert (nothing["evaluated_row_count"], nothing["skipped_row_count"], nothing["mse"]) == (0, 1, None)


def test_panel_keeps_last_features_and_counts_unknown_nodes(spark):
    hours = [("train", 0), ("train", 1), ("test", 2), ("test", 3), ("test", 4)]
    rows = [(10, at(h), 0.2 * h + 0.1, float(h), 0.0, s) for s, h in hours if h != 3]
    rows += [(11, at(h), 0.3, 1.0, 0.0, s) for s, h in hours]
    rows += [(99, at(h), 0.9, 1.0, 0.0, "test") for h in (2, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = panel_window_forecast(df, df.filter("split = 'train'"), ["x"], LinearWindow([[1.0, 0.0], [0.0, 0.1]]), 2, entity="key", target="y", clip_to=(0.0, 1.0))
    got = {(r["key"], r["timestamp"].hour): r["prediction"] for r in found.collect()}
    # Node 10 is not observed at hour 3: its features stay those of hour 2, its target is the prediction.
    second = 0.1 * 1.0 + 0.1
    want = {(10, 2): second, (10, 4): second + 0.1 * 2.0, (11, 2): 0.4, (11, 3): 0.4, (11, 4): 0.5, (99, 2): None, (99, 3): None}
    assert set(got) == set(want)
    assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())
    scores = roll_out_scores(found, "y", "timestamp", known=F.col("known")).first()
    assert (scores["evaluated_row_count"], scores["skipped_row_count"], scores["unknown_row_count"], scores["evaluated_timestamp_count"]) == (5, 2, 2, 3)
