"""Runs, windows, fills and roll-outs against plain Python on random series."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelworks.operators import continuity, enrich, models, ordering, splits, windows

START = datetime(2016, 1, 1)
SCHEMA = "key int, timestamp timestamp_ntz, value double"


def random_series(seed, keys=4, hours=400, keep=0.8):
    rng = random.Random(seed)
    rows = []
    for key in range(keys):
        density = 1.0 if key == 0 else keep
        rows += [(key, START + timedelta(hours=h), float(rng.randint(0, 3))) for h in range(hours) if rng.random() < density]
    return rows


def by_key(rows):
    found = {}
    for key, ts, value in sorted(rows):
        found.setdefault(key, []).append((ts, value))
    return found


def runs_in_python(rows):
    out = {}
    for key, series in by_key(rows).items():
        segment, start, place, previous = 0, None, 0, None
        for ts, _ in series:
            gap = previous is not None and ts - previous != timedelta(hours=1)
            if previous is None or gap:
                segment, start, place = segment + gap, ts, 0
            else:
                place += 1
            out[(key, ts)] = (previous, gap, segment, start, place)
            previous = ts
    return out


@pytest.mark.parametrize("seed, keep, days", [(1, 0.8, 1), (2, 0.97, 2), (3, 0.5, 3), (4, 0.999, 1), (5, 0.05, 1)])
def test_runs_across_slices(spark, seed, keep, days):
    rows = random_series(seed, keep=keep)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r["key"], r["timestamp"]): (r["previous_ts"], r["is_gap"], r["segment"], r["run_start"], r["run_position"])
        for r in continuity.contiguous_runs(df, ["key"], "timestamp", slice_days=days).collect()
    }
    assert got == runs_in_python(rows)


def test_evaluable_counts_of_a_broken_series(spark):
    rows = [(1, START + timedelta(hours=h), 1.0) for h in (0, 1, 2, 3, 5, 6, 7)]
    flagged = continuity.evaluable_rows(spark.createDataFrame(rows, SCHEMA), ["key"], "timestamp", 2)
    hours = {(r["timestamp"] - START).seconds // 3600: r["evaluable"] for r in flagged.collect()}
    assert [h for h, e in sorted(hours.items()) if e] == [2, 3, 7]
    assert [h for h, e in sorted(hours.items()) if not e] == [0, 1, 5, 6]


@pytest.mark.parametrize("stride", [1, 3])
def test_sequences_and_lags(spark, stride):
    rows = random_series(7, keep=0.95)
    df = spark.createDataFrame(rows, SCHEMA)
    places = runs_in_python(rows)
    values = {(k, ts): v for k, ts, v in rows}
    want = {}
    for (key, ts), (*_, place) in places.items():
        if place >= 5 and (place - 5) % stride == 0:
            want[(key, ts)] = [values[(key, ts - timedelta(hours=k))] for k in range(1, 6)]
    lagged = windows.lag_features(df, ["key"], "timestamp", "value", 5, stride, slice_days=1).collect()
    assert {(r["key"], r["timestamp"]): [r[f"lag_{k}"] for k in range(1, 6)] for r in lagged} == want
    listed = windows.sequence_windows(df, ["key"], "timestamp", ["value"], "value", 5, stride, slice_days=1).collect()
    assert {(r["key"], r["timestamp"]): [s["value"] for s in reversed(r["sequence"])] for r in listed} == want
    assert all(r["next_target"] == values[(r["key"], r["timestamp"])] for r in listed)


def test_row_positions_with_ties(spark):
    rows = [(1, START + timedelta(days=d % 50), float(d)) for d in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = ordering.row_positions(df, ["key"], "timestamp", ties=["value"], slice_days=7).collect()
    order = [(r["timestamp"], r["value"]) for r in sorted(placed, key=lambda r: r["position"])]
    assert order == sorted(order) and [r["position"] for r in sorted(placed, key=lambda r: r["position"])] == list(range(150))


def test_forward_fill_carries_whole_rows_across_slices(spark):
    rng = random.Random(3)
    rows = [(k, START + timedelta(hours=h), float(h), None if h % 5 else 1.0, rng.random() < 0.05) for k in range(3) for h in range(300)]
    df = spark.createDataFrame(rows, "key int, timestamp timestamp_ntz, a double, b double, seen boolean")
    got = {
        (r["key"], r["timestamp"]): (r["a"], r["b"])
        for r in continuity.forward_fill(df, ["key"], "timestamp", ["a", "b"], "seen", slice_days=1).collect()
    }
    for key in range(3):
        last = (0.0, 0.0)
        for k, ts, a, b, seen in rows:
            if k == key:
                last = (a, b) if seen else last
                assert got[(key, ts)] == last


def test_panel_counts_unknown_nodes_and_fills(spark):
    rows = [("2016-01-01 00:00:00", 0.1, 10, 4), ("2016-01-01 00:00:00", 0.2, 11, 5), ("2016-01-01 01:00:00", 0.3, 12, 6)]
    df = spark.createDataFrame(rows, "timestamp string, meter_reading double, building_id int, feature int")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    nodes = spark.createDataFrame([(10,), (11,)], "building_id int")
    counts = enrich.unknown_node_counts(enrich.locate_nodes(df, nodes)).first()
    assert tuple(counts) == (3, 2, 1)
    panel = enrich.complete_panel(df, nodes)
    assert panel.count() == 4
    assert {r["timestamp"].hour for r in panel.filter("observed").collect()} == {0}
    filled = continuity.forward_fill(panel, ["building_id"], "timestamp", ["meter_reading", "feature"], "observed", 0)
    assert sorted((r["timestamp"].hour, r["building_id"], r["feature"]) for r in filled.collect()) == [
        (0, 10, 4), (0, 11, 5), (1, 10, 4), (1, 11, 5)]


def test_rolling_blocks_match_pandas(spark):
    rows = random_series(11, keys=2, hours=300)
    pdf = spark.createDataFrame(rows, SCHEMA).toPandas().sort_values(["key", "timestamp"])
    got = windows.rolling_statistics(spark.createDataFrame(rows, SCHEMA), "timestamp", "value", 12, ["key"], slice_days=2)
    got = got.toPandas().sort_values(["key", "timestamp"])
    want = pdf.groupby("key")["value"].rolling(12)
    np.testing.assert_allclose(got["rolling_mean"].to_numpy(float), want.mean().to_numpy(), atol=1e-9)
    np.testing.assert_allclose(got["rolling_std"].to_numpy(float), want.std().to_numpy(), atol=1e-6)


def test_row_halo_blocks_see_their_neighbours(spark):
    df = spark.range(100).select(F.col("id").alias("position"))
    blocks = ordering.with_row_halo(df, "position", before=3, after=2, block_rows=10)
    seen = {}
    for row in blocks.collect():
        seen.setdefault(row["_block"], []).append(row["position"])
    assert sorted(seen[4]) == list(range(37, 52))
    assert ordering.home_rows(blocks).count() == 100


def test_zero_runs(spark):
    values = [0, 0, 1, 0, 0, 0, 5, 0]
    rows = [(1, START + timedelta(hours=h), float(v)) for h, v in enumerate(values) if h != 4]
    got = continuity.longest_zero_run(spark.createDataFrame(rows, SCHEMA), ["key"], "timestamp", "value").first()
    assert (got["run_count"], got["longest_run"]) == (4, 2)


def rolled_in_python(rows, first_test, weights, low, high):
    window, out = len(weights), {}
    places = runs_in_python(rows)
    for key, series in by_key(rows).items():
        state = {}
        for ts, value in series:
            place = places[(key, ts)][4]
            if ts >= first_test and place >= window:
                guess = sum(w * state[ts - timedelta(hours=i + 1)] for i, w in enumerate(weights))
                out[(key, ts)] = guess
                state[ts] = min(max(guess, low), high)
            else:
                state[ts] = value
    return out


def test_rollout_matches_a_plain_loop(spark):
    rows = random_series(21, keys=6, hours=500, keep=0.97)
    df = splits.time_split(spark.createDataFrame(rows, SCHEMA), "timestamp")
    first = df.filter("split = 'test'").agg(F.min("timestamp")).first()[0]
    got = models.roll_out_forecast(df, ["key"], "timestamp", "value", [0.9, -0.4, 0.3], write_back=(0.0, 1.0)).collect()
    want = rolled_in_python(rows, first, [0.9, -0.4, 0.3], 0.0, 1.0)
    assert {(r["key"], r["timestamp"]) for r in got} == set(want)
    for r in got:
        assert r["prediction"] == pytest.approx(want[(r["key"], r["timestamp"])])


def test_rollout_state_crosses_arrow_batches(spark):
    rows = random_series(22, keys=3, hours=300, keep=0.99)
    df = splits.time_split(spark.createDataFrame(rows, SCHEMA), "timestamp", ratios=(0.3, 0.3, 0.4))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    run = lambda: {
        (r["key"], r["timestamp"]): r["prediction"]
        for r in models.roll_out_forecast(df, ["key"], "timestamp", "value", [0.5, 0.5]).collect()
    }
    whole = run()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        assert run() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_filled_panel_equals_completing_and_filling(spark, monkeypatch):
    monkeypatch.setattr(continuity, "FILL_POSITIONS", 3)
    rows = [(b, s, h, float(10 * b + h)) for b, s, h in itertools.product((1, 2, 3), ("train", "test"), range(9)) if (b * h + len(s)) % 4 and h % 5 != b]
    rows.append((9, "train", 2, None))
    df = spark.createDataFrame(rows, "building_id int, split string, h int, v double").selectExpr("building_id", "split", "timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, h) AS timestamp", "v")
    nodes = df.select("building_id", "split").distinct().unionByName(spark.createDataFrame([(7, "test")], "building_id int, split string"))
    panel = enrich.complete_panel(df, nodes, keys=["split"])
    want = continuity.forward_fill(panel, ["building_id", "split"], "timestamp", ["v"], "observed", 0.0)
    got = continuity.filled_panel(df, nodes, ["v"], ["split"])
    names = ["building_id", "split", "timestamp", "v", "observed"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
