"""Hard negatives against plain Python and SQL."""

import math
import random

import numpy as np
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from panelworks.llm import hard_negatives
from panelworks.llm.hard_negatives import Block, Nearest, Windows, anchors_of, mine, op11_hard_negatives, whole_numbers

COLUMNS = "vec_id long, embedding array<float>, label int"


def expected(rows):
    taken = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taken.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    anchors = {}
    for vec_id, vector, label in taken:
        if vec_id % 100 == 0:
            packed = np.array(vector, "<i4").tobytes()
            anchors[vec_id] = min(anchors.get(vec_id, (label, packed, vector)), (label, packed, vector))
    out = []
    for a, (label, _, vector) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(vector, v, strict=True)), i, k) for i, v, k in taken if i != a and len(v) == len(vector)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            hits = sorted(s[:2] for s in scored if s[2] != label and -30 * ps <= -100 * s[0] <= -90 * ps)[:10]
            out += [(a, p, rank, i, -ps, -s) for rank, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def found(df):
    vectors = whole_numbers(df)
    return sorted(map(tuple, mine(vectors, anchors_of(vectors)).collect()))


def some_vectors(seed, n, dims, labels):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = [(i, [x + rng.gauss(0, 0.5) for x in centres[i % labels]], (i % labels) if rng.random() < 0.8 else rng.randrange(labels)) for i in range(n)]
    return rows


def test_against_plain_python(spark):
    rows = some_vectors(1, 900, 24, 4)
    rows += [(1000, rows[3][1], 3), (1001, rows[3][1], 0), (1002, rows[3][1], 0), (1100, [0.0] * 24, 1), (1200, [-x for x in rows[5][1]], 1)]
    assert found(spark.createDataFrame(rows, COLUMNS)) == expected(rows) != []


def test_small_blocks_and_shards(spark, monkeypatch):
    rows = some_vectors(2, 700, 16, 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    monkeypatch.setattr(hard_negatives, "SHARD", 2)
    assert found(spark.createDataFrame(rows, COLUMNS)) == expected(rows) != []


def test_odd_rows(spark):
    rows = some_vectors(3, 220, 8, 2)
    rows += [
        (None, rows[0][1], 0), (301, None, 0), (302, rows[0][1], None), (303, [None] + rows[0][1][1:], 0), (304, [float("nan")] + rows[0][1][1:], 1),
        (305, [float("inf")] + rows[0][1][1:], 1), (306, [], 0), (400, [], 0), (407, [], 1), (308, rows[0][1][:3], 0), (500, rows[1][1][:3], 1), (309, rows[2][1][:3], 1),
        (-100, rows[4][1], 0), (310, rows[4][1], -3), (5, rows[5][1], 1), (5, rows[5][1], 1), (7, rows[7][1], 0), (100, rows[9][1], 1),
    ]
    assert found(spark.createDataFrame(rows, COLUMNS)) == expected(rows)
    wide = spark.createDataFrame(rows, COLUMNS).select("*", F.lit(1).alias("vector"), F.lit(2).alias("score"), F.lit("x").alias("payload"))
    assert found(wide) == expected(rows)
    assert found(spark.createDataFrame([], COLUMNS)) == []
    assert found(spark.createDataFrame([(100, [2.0**30, 1.0], 1), (1, [1.0, 2.0], 1)], COLUMNS)) == []


def test_bounds_hold_and_spare_reading():
    """Rows that leave early could not have been wanted; clustered rows are left before all dimensions are read."""
    rng = np.random.default_rng(4)
    scale = 0.7 ** np.arange(32)
    columns = np.floor(256 * rng.normal(size=(32, 2000)) * scale[:, None]).astype("<i4")
    block = Block(0, np.arange(2000), columns)
    vector = np.floor(256 * rng.normal(size=32) * scale).astype("<i4")
    score = vector.astype(np.int64) @ columns.astype(np.int64)
    near = Nearest(-1, vector, np.zeros(0))
    rows, exact, cells = block.scan(vector, near.alive)
    assert (exact == score[rows]).all() and set(np.argsort(-score, kind="stable")[:5]) <= set(rows.tolist())
    assert cells < 32 * 2000 // 2
    tops = Windows(-1, vector, np.array([score.max(), score.max() // 2]))
    rows, exact, cells = block.scan(vector, tops.alive)
    for low, high in tops.ranges:
        inside = np.flatnonzero((score >= low) & (score <= high))
        assert set(inside[np.argsort(-score[inside], kind="stable")[:10]].tolist()) <= set(rows.tolist())
    assert cells < 32 * 2000


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert not differences(op11_hard_negatives(spark, folder).toArrow(), connect(folder).sql(hard_negatives.SQL).to_arrow_table())
