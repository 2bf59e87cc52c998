"""Neighbour search against brute force, graph identities, fitted models, removal search and streams."""

import itertools
import math
import statistics
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelworks.operators import boxes, graph, models, neighbours, removal, ridge
from panelworks.operators.neighbours import attribute_metric, cosine_metric, nearest_neighbours
from panelworks.scale import attach, cut_lineage
from panelworks.streaming.continuity_state import continuity_stream, late_rows, placed
from panelworks.streaming.daily_profile import daily_profile, read_file_stream, run_to_table

METRIC = attribute_metric(equal={"site": 0.6}, near={"size": (0.4, 2.0)})


def brute_force(ids, similarity, k):
    edges = set()
    for i, a in enumerate(ids):
        ranked = sorted((-round(similarity[i][j], 9), b) for j, b in enumerate(ids) if j != i)
        edges |= {(a, b, round(-s, 6)) for s, b in ranked[:k] if s < 0}
    return edges


def found(edges):
    return {(r["src"], r["dst"], round(r["weight"], 6)) for r in edges.collect()}


@pytest.mark.parametrize("k", [1, 3, 20, 200])
def test_attribute_neighbours_with_a_hot_profile(spark, k):
    rng = np.random.default_rng(5)
    rows = [(i * 3, "hot", 1.0) for i in range(40)]  # a third of the nodes are copies
    rows += [(i * 3 + 1, rng.choice(["a", "b", "hot"]).item(), float(rng.integers(0, 30)) / 4) for i in range(80)]
    pdf = spark.createDataFrame(rows, "id int, site string, size double")
    sim = [[0.6 * (a[1] == b[1]) + 0.4 * np.exp(-abs(a[2] - b[2]) / 2.0) for b in rows] for a in rows]
    got = found(nearest_neighbours(pdf, "id", METRIC, k, block_rows=7))
    assert got == brute_force([r[0] for r in rows], sim, k)


@pytest.mark.parametrize("k", [2, 10])
def test_embedding_neighbours(spark, k):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    vectors = np.repeat(centres, 24, axis=0) + 0.1 * rng.normal(size=(120, 8))
    vectors[:40] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = found(nearest_neighbours(df, "id", cosine_metric("v"), k, block_rows=16))
    assert got == brute_force(list(range(120)), unit @ unit.T, k)


def test_search_leaves_far_cells_out(spark):
    rows = [(i, "s", float(100 * (i // 50) + i % 50 / 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, site string, size double")
    sim = [[0.6 + 0.4 * np.exp(-abs(a[2] - b[2]) / 2.0) for b in rows] for a in rows]
    assert found(nearest_neighbours(df, "id", METRIC, 4, block_rows=32)) == brute_force([r[0] for r in rows], sim, 4)


def test_matrices_stay_small_with_many_pivots(spark):
    most = 1 << 20

    def similarity(a, b):
        assert len(a[0]) * len(b[0]) <= most
        return METRIC.similarity(a, b)

    small = SimpleNamespace(**{**vars(METRIC), "similarity": similarity})
    nodes = spark.range(3000).selectExpr("id", "concat('s', id % 40) AS site", "CAST(id * 37 % 3001 AS DOUBLE) AS size").coalesce(1)
    assert nearest_neighbours(nodes, "id", small, 2, pivot_count=1500).groupBy("src").count().filter("count = 2").count() == 3000


def test_profiles_travel_once_to_a_group_of_cells(spark, monkeypatch):
    written = {}

    def cut(df, label):
        written[label] = cut_lineage(df, label)
        return written[label]

    monkeypatch.setattr(neighbours, "cut_lineage", cut)
    vectors = np.random.default_rng(8).normal(size=(400, 16))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    got = found(nearest_neighbours(df, "id", cosine_metric("v"), 5, block_rows=150))
    assert got == brute_force(list(range(400)), unit @ unit.T, 5)
    # random vectors: nearly every cell has to be searched; vectors are not written for it, and there is a row a profile
    assert written["searches"].count() == 400 and "v" not in written["searches"].columns


@pytest.mark.parametrize("block_rows", [9, 60, None])
def test_boxes_find_all_neighbours_with_missing_values(spark, block_rows):
    rng = np.random.default_rng(11)
    metric = attribute_metric({"site": 0.4, "use": 0.3}, {"size": (0.2, 1.0), "age": (0.1, 10.0)})
    pick = lambda values: values[int(rng.integers(len(values)))]
    rows = [(i, pick(["a", "b", None]), pick(["x", "y", "z"]), pick([None, float(rng.normal())]), pick([None, 3.0, float(i % 9)])) for i in range(150)]
    rows += [(i, "a", "x", 0.5, None) for i in range(150, 190)]  # more equal nodes than k
    df = spark.createDataFrame(rows, "id int, site string, use string, size double, age double")

    def near(a, b, scale):
        return float(a is None and b is None) if a is None or b is None else math.exp(-abs(a - b) / scale)

    sim = [[0.4 * (a[1] == b[1]) + 0.3 * (a[2] == b[2]) + 0.2 * near(a[3], b[3], 1.0) + 0.1 * near(a[4], b[4], 10.0) for b in rows] for a in rows]
    got = found(nearest_neighbours(df, "id", metric, 6, block_rows=block_rows))
    assert got == brute_force([r[0] for r in rows], sim, 6)


def test_a_cell_is_not_compared_with_all_of_itself():
    compared = []

    def similarity(a, b):
        compared.append(len(a[0]) * len(b[0]))
        return METRIC.similarity(a, b)

    n, rng = 6000, np.random.default_rng(12)
    frame = pd.DataFrame({"profile": range(n), "site": [f"s{i % 5}" for i in range(n)], "size": rng.random(n) * 40})
    table = pa.Table.from_pandas(frame).append_column("nodes", pa.array([[i] for i in range(n)])).append_column("cell", pa.array(np.zeros(n, dtype="int32")))
    box = ({"site": np.array(["s0", "s4"], dtype=object)}, np.array([0]), (np.array([[0.5, 0.0]]), np.array([[1.5, 40.0]]), np.zeros((1, 2), bool)))
    at_home, _ = boxes._search(SimpleNamespace(**{**vars(METRIC), "similarity": similarity}), ["site"], ["size"], 5, 9, box)
    result = at_home(table)
    assert sum(compared) < 0.1 * n * n
    for i in (0, 17, 5999):
        alike = METRIC.similarity(*METRIC.prepare(frame.iloc[i : i + 1], frame))[0].round(9)
        assert result["others"][i].as_py() == sorted(range(n), key=lambda j: (-alike[j] if j != i else -1.0, j))[:6]


def test_equal_neighbour_lists_are_summed_once(spark, monkeypatch):
    sent, weighted_sums = [], graph._weighted_sums

    def counted(edges, *others):
        sent.append(edges.count())
        return weighted_sums(edges, *others)

    monkeypatch.setattr(graph, "_weighted_sums", counted)
    edges = [(s, d, 0.1 * (d + 1)) for s in range(10, 30) for d in range(5)] + [(s, s, 0.5) for s in range(31)] + [(30, 1, 0.25), (30, 29, 2.0), (31, 99, 1.0)]
    panel = [(n, f"2024-0{1 + 3 * (h % 2)}-01 0{h}:00:00", None if (n, h) == (1, 2) else n + h / 10, n * h) for n in range(31) for h in range(4) if (n + h) % 3]
    df = spark.createDataFrame(panel, "building_id int, timestamp string, a double, b bigint").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = graph.aggregate_neighbours(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"), df, ["a", "b"])
    expected = {}
    for s, d, w in edges:
        for n, t, a, b in panel:
            if n == d:
                old = expected.get((s, t), (None, None))
                expected[s, t] = (old[0] if a is None else (old[0] or 0) + w * a, (old[1] or 0) + w * b)
    rows = {(r["building_id"], str(r["timestamp"])): (r["a"], r["b"]) for r in got.collect()}
    assert rows.keys() == expected.keys()
    for key, (a, b) in expected.items():
        assert rows[key][1] == pytest.approx(b) and (rows[key][0] is None if a is None else rows[key][0] == pytest.approx(a))
    # the list of the twenty goes out once and comes back as one edge for each of them
    assert sent == [5, 20 + len(edges) - 100]


def test_vectors_are_compared_in_single_precision_first(spark):
    exact = []
    metric = cosine_metric("v")

    def similarity(a, b):
        exact.append(len(a[0]) * len(b[0]))
        return cosine_metric("v").similarity(a, b)

    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(3, 700)).repeat(20, axis=0) + 1e-7 * rng.normal(size=(60, 700))  # apart by less than single precision shows
    frame = pd.DataFrame({"profile": range(60), "v": vectors.tolist(), "group": 0, "cell": 0, "bits": [b"\x80"] * 60, "floor": np.nan})
    search = neighbours._search_block(SimpleNamespace(**{**vars(metric), "similarity": similarity}), 4, 15, [[0]])
    got = search(frame, frame[["profile", "v", "cell"]])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    alike = np.einsum("id,jd->ij", unit, unit).clip(-1, 1).round(15)
    assert not exact and len(got) == 240
    for i, part in got.groupby("profile"):
        best = sorted((alike[i, j] for j in range(60) if j != i), reverse=True)[:4]
        assert part["similarity"].tolist() == pytest.approx(best, abs=3e-15)


def test_no_neighbours_for_k_zero(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "id int, site string, size double")
    assert nearest_neighbours(df, "id", METRIC, 0).count() == 0


def test_graph_rows_sum_to_one_and_fusion(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25)], "src bigint, dst bigint, weight double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    whole = graph.normalise_rows(edges, nodes, "id")
    sums = whole.groupBy("src").agg(F.sum("weight").alias("w")).collect()
    assert len(sums) == 3 and all(r["w"] == pytest.approx(1.0) for r in sums)
    for alpha, same in ((0.0, edges), (1.0, whole)):
        fused = graph.fuse_graphs(whole, edges, alpha).filter("weight <> 0")
        assert found(fused) == found(same)
    listed = graph.edge_list(whole, nodes, "id").collect()
    assert {(r["src_index"], r["dst_index"]) for r in listed} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)}


def regression_rows(spark, n=400):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + [0.0, 300.0, 5.0]
    y = 0.4 + 0.1 * x[:, 0] - 0.001 * x[:, 1] + rng.normal(size=n) * 0.05
    gaps = rng.random(size=n) < 0.1
    rows = [
        ("train" if i < n * 0.8 else "test", i % 3, None if gaps[i] else float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(y[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "split string, meter int, a double, b double, c double, y double"), rows


def closed_form(rows, alpha):
    train = [r for r in rows if r[0] == "train"]
    x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in train])
    y = np.array([r[5] for r in train])
    mean = np.nanmean(x, axis=0)
    x = np.where(np.isnan(x), mean, x)
    std = x.std(axis=0)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    return w, y.mean(), mean, std


@pytest.mark.parametrize("alpha", [0.1, 1.0, 100.0])
def test_ridge_matches_the_closed_form(spark, alpha):
    df, rows = regression_rows(spark)
    model = ridge.fit_ridge(df, ["a", "b", "c"], "y", alpha)
    weights, intercept, _, _ = closed_form(rows, alpha)
    assert model.weights == pytest.approx(weights.tolist(), rel=1e-6)
    assert model.intercept == pytest.approx(intercept)


def test_ridge_family_equals_single_models(spark):
    df, rows = regression_rows(spark)
    family = ridge.fit_ridge_family(df, ["a", "b", "c"], "y", [0.1, 10.0], ["meter"], {"all": ["a", "b", "c"], "no_a": ["b", "c"]})
    assert family.count() == 12
    for row in family.filter("variant = 'all'").collect():
        part = [r for r in rows if r[1] == row["meter"]]
        weights, intercept, mean, std = closed_form(part, row["alpha"])
        assert row["weights"] == pytest.approx((weights / std).tolist(), rel=1e-6)
        assert row["intercept"] == pytest.approx(intercept) and row["means"] == pytest.approx(mean.tolist())
    assert all(r["weights"][0] == 0.0 for r in family.filter("variant = 'no_a'").collect())
    single = ridge.fit_ridge(df.filter("meter = 1"), ["a", "b", "c"], "y", 10.0)
    want = single.score(df.filter("meter = 1")).agg(F.sum("prediction")).first()[0]
    scored = ridge.score_ridge_family(df, family, ["a", "b", "c"], ["meter"])
    got = scored.filter("meter = 1 AND variant = 'all' AND alpha = 10.0").agg(F.sum("prediction")).first()[0]
    assert got == pytest.approx(want)


def test_constant_feature_and_target(spark):
    df = spark.createDataFrame([("train", 1.0, 2.0), ("train", 1.0, 2.0)], "split string, a double, y double")
    assert ridge.fit_ridge(df, ["a"], "y").score(df, None, None).first()["prediction"] == pytest.approx(2.0)
    varied = spark.createDataFrame([("train", 1.0, float(i % 5), float(i % 5)) for i in range(50)], "split string, a double, b double, y double")
    both, alone = (ridge.fit_ridge(varied, names, "y", 10.0) for names in (["a", "b"], ["b"]))
    assert both.weights == [0.0, *alone.weights] and both.intercept == alone.intercept
    family = ridge.fit_ridge_family(df, ["a"], "y")
    assert ridge.score_ridge_family(df, family, ["a"], (), None, None).first()["prediction"] == pytest.approx(2.0)


def test_boosted_trees_beat_the_mean(spark):
    df, _ = regression_rows(spark)
    df = df.withColumn("split", F.when((F.col("split") == "train") & (F.col("meter") == 2), "valid").otherwise(F.col("split")))
    tree = models.fit_boosted_trees(df, ["a", "b", "c"], "y", depth=3, rounds=5, step=0.3, max_bins=32)
    score = models.score_and_measure(tree, df.filter("split = 'test'"), "y", []).first()
    assert score["r2"] > 0.2
    assert tree.importances(spark).count() == 3
    errors = [r["error"] for r in tree.history.orderBy("round").collect()]
    assert tree.model.getNumTrees == int(np.argmin(errors)) + 1
    valid = tree.score(df.filter("split = 'valid'"), None, None)
    assert valid.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] == pytest.approx(min(errors))


def test_trees_per_key_have_validation_rows_of_their_own(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "train" if i < 60 else "valid" if i < 80 else "test", float(x), float(x * (k + 1) + rng.normal(0, 0.1))) for k in range(2) for i, x in enumerate(rng.random(90))]
    df = spark.createDataFrame(rows, "meter int, split string, a double, y double")
    fitted = models.fit_boosted_trees_by_key(df, "meter", ["a"], "y", depth=2, rounds=6, step=0.5, max_bins=16, patience=2)
    scored = models.score_by_key(df, "meter", fitted, low=None, high=None)
    assert list(fitted) == [0, 1] and scored.count() == len(rows)
    slope = {r["meter"]: r["s"] for r in scored.groupBy("meter").agg(F.regr_slope("prediction", "a").alias("s")).collect()}
    assert slope[1] > 1.5 > slope[0]


@pytest.mark.parametrize(
    "errors, patience, wanted",
    [
        ([0.5, 0.4, 0.45, 0.41, 0.42, 0.1], 3, (2, 0.4, True)),
        ([0.5, 0.6, 0.4, 0.7, 0.3, 0.35], 2, (5, 0.3, False)),
        ([0.5, 0.6, 0.4, 0.7, 0.3, 0.35, 0.4, 0.1], 2, (5, 0.3, True)),
        ([0.5, 0.6, 0.7], 2, (1, 0.5, True)),
        ([0.3, 0.3, 0.3, 0.3, 0.2], 3, (1, 0.3, True)),
        ([0.3, 0.3, 0.3, 0.2], 3, (4, 0.2, False)),
        ([0.4], 1, (1, 0.4, False)),
    ],
)
def test_patience(spark, errors, patience, wanted):
    history = spark.createDataFrame(list(enumerate(errors, 1)), "round int, error double")
    assert tuple(models.staged_choice(history, patience).first()) == wanted


def test_selection(spark):
    scores = spark.createDataFrame([(1.0, 0.3), (2.0, 0.2), (3.0, 0.2)], "alpha double, rmse double")
    assert models.select_best(scores, "alpha").first()["alpha"] == 2.0


def test_attach_gives_the_same_with_and_without_broadcast(spark):
    fact = spark.range(50).select((F.col("id") % 7).alias("k"))
    params = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = sorted(map(tuple, attach(fact, params, ["k"]).collect()), key=str)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = sorted(map(tuple, attach(fact, params, ["k"]).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert small == large and len(small) == 50


def _removal_ratio(rows, gone):
    days = {}
    for d, b, v in rows:
        if b not in gone:
            days[d] = max(v, days.get(d, 0.0))
    return max(days.values()) / statistics.median(days.values()) if days else None


def _smallest_removals(rows, candidates, limit):
    for size in range(len(candidates) + 1):
        ratios = {c: _removal_ratio(rows, c) for c in itertools.combinations(candidates, size)}
        good = {c: r for c, r in ratios.items() if r is not None and r <= limit}
        if good:
            return size, good
    return None, {}


def test_minimal_removal_of_every_key_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    candidates = {"a": [1, 2, 5, 7], "b": [0, 1, 2, 3, 4, 5, 6], "c": [3], "d": list(range(9)), "e": [1, 2]}
    rows = {
        key: [(f"2016-01-{d + 1:02d}", b, float(rng.integers(5, 15) * (4 if b in (2, 5) and d % 6 == 0 else 1))) for d in range(28) for b in range(9) if key != "e" or b in (1, 2) or d % 4]
        for key in candidates
    }
    daily = spark.createDataFrame([(k, *r) for k, own in rows.items() for r in own], "meter string, date string, building_id int, meter_reading double")
    chosen = spark.createDataFrame([(k, c) for k, own in candidates.items() for c in own], "meter string, building_id int")
    solutions, log = removal.minimal_removal(daily, chosen, 1.5, ["meter"])
    found = {k: {tuple(r["removed"]): r["ratio"] for r in solutions.filter(F.col("meter") == k).collect()} for k in candidates}
    logged = {k: [(r["remove_count"], r["combinations"], r["solutions"]) for r in log.filter(F.col("meter") == k).orderBy("remove_count").collect()] for k in candidates}
    for key, own in candidates.items():
        size, good = _smallest_removals(rows[key], own, 1.5)
        assert found[key] == pytest.approx(good)
        assert all(n == math.comb(len(own), k) for k, n, _ in logged[key])
        if good:
            assert logged[key][-1][0] == size and logged[key][-1][2] == len(good)
    assert any(found.values()) and not all(found.values())
    best = {(r["meter"], r["building_id"]) for r in removal.best_removal(solutions, ["meter"]).collect()}
    assert best == {(k, b) for k, own in found.items() if own for b in min(own, key=lambda c: (own[c], c))}


def test_minimal_removal_without_keys_and_with_many_candidates(spark):
    rows = [(f"2016-01-{d + 1:02d}", b, 10.0 + (30.0 if (b, d) in ((61, 3), (75, 9)) else b / 100)) for d in range(15) for b in range(80)]
    daily = spark.createDataFrame(rows, "date string, building_id int, meter_reading double")
    solutions, log = removal.minimal_removal(daily, spark.range(5, 80).select(F.col("id").cast("int").alias("building_id")), 2.0)
    assert [r["removed"] for r in solutions.collect()] == [[61, 75]]
    assert [(r["remove_count"], r["combinations"]) for r in log.orderBy("remove_count").collect()] == [(0, 1), (1, 75), (2, 75 * 37)]


def test_removal_without_solution_is_empty(spark):
    daily = spark.createDataFrame([("d1", 1, 1.0), ("d2", 1, 9.0), ("d3", 1, 1.0)], "date string, building_id int, meter_reading double")
    nobody = spark.createDataFrame([(7,)], "building_id int")
    solutions, log = removal.minimal_removal(daily, nobody, 2.0)
    # What always stays is over the limit, so that nothing is tried beyond the empty set.
    assert solutions.count() == 0 and [row["remove_count"] for row in log.collect()] == [0]
    everyone = spark.createDataFrame([(1,)], "building_id int")
    assert removal.minimal_removal(daily, everyone, 2.0)[0].count() == 0
    assert removal.minimal_removal(daily, nobody.limit(0), 20.0)[0].first()["removed"] == []


def test_continuity_state_over_several_batches(spark, tmp_path):
    base = "2016-01-01 00:00:00"
    batches = [[0, 1, 2], [3, 4, 7], [8, 9, 10, 11]]
    source = f"{tmp_path}/in"
    for number, hours in enumerate(batches):
        rows = spark.createDataFrame([(1, h) for h in hours] + [(2, h * 2) for h in hours], "key int, h int").selectExpr(
            "key", f"timestamp_ntz'{base}' + make_dt_interval(0, h) AS timestamp"
        )
        rows.coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = read_file_stream(spark, source, "*.parquet", schema, files_per_batch=1)
    out = run_to_table(continuity_stream(stream, ["key"], "timestamp", 2), "test-continuity", "append")
    flags = {(r["key"], r["timestamp"].hour): r["evaluable"] for r in out.collect()}
    assert [h for (k, h), e in sorted(flags.items()) if k == 1 and e] == [2, 3, 4, 9, 10, 11]
    assert not any(e for (k, _), e in flags.items() if k == 2) and len(flags) == 20


def _continuity(spark, source, folder, hours, watermark):
    rows = [(k, h) for k, own in hours.items() for h in own]
    table = spark.createDataFrame(rows, "key int, h int").selectExpr("key", "timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, h) AS timestamp")
    table.coalesce(1).write.mode("append").parquet(source)
    stream = read_file_stream(spark, source, "*.parquet", table.schema)
    return run_to_table(continuity_stream(stream, ["key"], "timestamp", 2, watermark=watermark), "ends", "append", folder)


def test_finished_series_leave_no_state_and_late_rows_leave_by_the_side(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    state = lambda: {r["key"]["key"]: r["value"]["groupState"]["length"] for r in spark.read.format("statestore").load(f"{folder}/state").collect()}
    _continuity(spark, source, folder, {1: [0, 1, 2], 2: [0, 1, 2]}, "3 hours")
    assert state() == {1: 3, 2: 3}
    # Series 1 has ended; series 2 brings a row that it had already, and one from before its last.
    rows = _continuity(spark, source, folder, {2: [3, 2, 4, 1]}, "3 hours")
    assert sorted((r["key"], r["timestamp"].hour) for r in late_rows(rows).collect()) == [(2, 1), (2, 2)]
    _continuity(spark, source, folder, {2: [5, 6, 7, 8]}, "3 hours")
    rows = _continuity(spark, source, folder, {2: [9], 3: [9]}, "3 hours")
    assert state() == {2: 10, 3: 1}
    got = {(r["key"], r["timestamp"].hour): (r["run_position"], r["evaluable"]) for r in placed(rows).collect()}
    assert got == {(2, h): (h, h >= 2) for h in range(10)} | {(1, h): (h, h >= 2) for h in range(3)} | {(3, 9): (0, False)}


def test_current_table_holds_one_row_a_key_and_few_versions(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(5):
        spark.range(part * 30, part * 30 + 30).selectExpr(
            "timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS ts", "nullif(id % 3, 2) AS meter", "cast(id as double) AS v"
        ).write.mode("append").parquet(source)
        table = spark.read.parquet(source)
        profile = daily_profile(read_file_stream(spark, source, "*.parquet", table.schema), "ts", "v", ["meter"])
        current = run_to_table(profile, "current", "update", folder, ["date", "meter"])
        assert sorted(map(tuple, current.collect()), key=str) == sorted(map(tuple, daily_profile(table, "ts", "v", ["meter"]).collect()), key=str)
    assert len(list((tmp_path / "out" / "current").iterdir())) <= 2


def test_streamed_profile_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/events"
    for part in range(3):
        spark.range(part * 100, part * 100 + 100).selectExpr(
            "timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS ts", "id % 3 AS meter", "cast(id as double) AS v"
        ).coalesce(1).write.mode("append").parquet(source)
    table = spark.read.parquet(source)
    stream = read_file_stream(spark, source, "*.parquet", table.schema, files_per_batch=1)
    got = run_to_table(daily_profile(stream, "ts", "v", ["meter"]), "test-profile", "update", keys=["date", "meter"])
    want = daily_profile(table, "ts", "v", ["meter"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_days_are_those_of_the_wall_clock(spark):
    rows = spark.sql("SELECT timestamp_ntz'2016-01-01 23:30:00' AS ts, 1 AS meter, 2.0D AS v UNION ALL SELECT timestamp_ntz'2016-01-02 00:30:00', 1, 3.0D")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            days = sorted((str(r["date"]), r["reading_sum"]) for r in daily_profile(rows, "ts", "v", ["meter"]).collect())
            assert days == [("2016-01-01", 2.0), ("2016-01-02", 3.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    def add(first):
        spark.range(first, first + 3).selectExpr("1 AS key", "timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS timestamp").coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = read_file_stream(spark, source, "*.parquet", "key int, timestamp timestamp_ntz", files_per_batch=1)
        rows = run_to_table(continuity_stream(stream, ["key"], "timestamp", 4), "resumed", "append", folder)
        return sorted((r["timestamp"].hour, r["run_position"]) for r in rows.collect())

    add(0)
    assert drain() == [(0, 0), (1, 1), (2, 2)]
    add(3)
    assert drain() == [(h, h) for h in range(6)]


def test_neighbours_of_repeated_nodes_and_missing_features(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, None, 1.0), (3, "a", None), (4, None, 1.0), (5, "b", 9.0)]
    nodes = spark.createDataFrame(rows, "node long, site string, size double")
    metric = attribute_metric({"site": 0.5}, {"size": (0.5, 1.0)})
    edges = {(r["src"], r["dst"]): round(r["weight"], 3) for r in nearest_neighbours(nodes, "node", metric, 4).collect()}
    assert edges[2, 4] == edges[4, 2] == 1.0
    assert edges[1, 2] == edges[2, 1] == 0.5 and edges[1, 3] == edges[3, 1] == 0.5
    assert (2, 3) not in edges and not any(a == b for a, b in edges)
    loops = [r for r in graph.normalise_rows(nearest_neighbours(nodes, "node", metric, 4), nodes, "node").collect() if r["src"] == r["dst"]]
    assert len(loops) == 5
