"""Exact nearest neighbours of every node without comparing all pairs.

Nodes with equal features are compared once, as one profile. Profiles are assigned to the nearest of
about two times the square root of their number of pivots. Each profile first searches its own cell, which bounds the distance of its
k-th neighbour; the triangle inequality then tells which other cells can still hold a nearer one, and
only those are searched. Neighbouring cells are searched together, in groups of bounded size: a profile travels once to
a group, with a bit per cell to search there, and brings back its k best of the whole group. A crowded cell and the
profiles searching a group are cut into blocks, which become many tasks. Vectors are compared in single precision first, with
room for its error, and exactly where that may matter.

Nodes whose similarity is a sum of agreements per column are found by boxes instead (``boxes``): pivots times profiles is too
much for millions of them. ``pivot_count`` has no meaning there.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelworks.operators.boxes import nearest_by_boxes
from panelworks.scale import cut_lineage

# Least and most profiles of a block. Every block is sent to those it meets, so what is sent falls as blocks grow.
BLOCK_ROWS = 2048
MOST_BLOCK_ROWS = 32768
# Numbers of a matrix that one step holds at once, whatever the number of pivots and the size of a block.
STEP_NUMBERS = 1 << 20
# Pairs found in a block before only the k best of each profile are kept.
MOST_FOUND = 1 << 20
# Bounds are widened by this much, far above the rounding of similarities and of float arithmetic.
SLACK = 1e-5


# A metric is a namespace of plain functions, so that it travels to the workers by value:
#   columns     the feature columns it compares
#   prepare     two frames of features as two lists of arrays, a row each
#   similarity  matrix between two such lists
#   distance    turns similarities into distances that obey the triangle inequality
#   distance_column  the same as a column expression
#   total       similarity of equal nodes
#   rough       a cheaper matrix of similarities and its largest error, to tell which pairs need the exact one
#   pairs       exact similarities of some pairs
# Where the similarity is a sum of agreements per column, boxes bound it better than pivots do:
#   parts       weight of each column, and the scale in which numbers agree, None where a column counts when equal
#   near        the number columns, which come last


def attribute_metric(equal: dict[str, float], near: dict[str, tuple[float, float]]) -> SimpleNamespace:
    """Weighted agreement of node attributes; 1 - similarity is a metric.

    Text columns count when equal; number columns count as exp(-distance / scale). A missing value is a value of its own:
    equal to a missing one, and without anything in common with the others.
    """
    total = sum(equal.values()) + sum(weight for weight, _ in near.values())

    def prepare(a: pd.DataFrame, b: pd.DataFrame) -> tuple[list, list]:
        codes = [pd.factorize(pd.concat([a[name], b[name]], ignore_index=True))[0] for name in equal]
        numbers = [[frame[name].to_numpy(float) for name in near] for frame in (a, b)]
        return [c[: len(a)] for c in codes] + numbers[0], [c[len(a) :] for c in codes] + numbers[1]

    def similarity(a: list, b: list) -> np.ndarray:
        score = np.zeros((len(a[0]), len(b[0])))
        for weight, x, y in zip(equal.values(), a, b):
            score += weight * (x[:, None] == y[None, :])
        for (weight, scale), x, y in zip(near.values(), a[len(equal) :], b[len(equal) :]):
            agreement = x[:, None] - y[None, :]
            np.abs(agreement, out=agreement)
            agreement /= -scale
            np.exp(agreement, out=agreement)
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                missing = np.isnan(x)[:, None] & np.isnan(y)[None, :]
                agreement = np.where(np.isnan(agreement), missing, agreement)
            agreement *= weight
            score += agreement
        return score

    def distance(score):
        return np.maximum(total - score, 0.0)

    return SimpleNamespace(
        columns=[*equal, *near], prepare=prepare, similarity=similarity, distance=distance, total=total,
        parts=[*((weight, None) for weight in equal.values()), *near.values()], near=list(near),
        distance_column=lambda score: F.greatest(total - score, F.lit(0.0)),
    )


def cosine_metric(vector: str) -> SimpleNamespace:
    """Cosine of vectors scaled to length 1; the metric is the chord length."""

    def unit(frame: pd.DataFrame) -> np.ndarray:
        rows = np.array(frame[vector].tolist(), dtype=float).reshape(len(frame), -1)
        norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.maximum(norms, 1e-12)

    def prepare(a: pd.DataFrame, b: pd.DataFrame) -> tuple[list, list]:
        return [unit(a)], [unit(b)]

    def similarity(a: list, b: list) -> np.ndarray:
        return np.clip(a[0] @ b[0].T, -1.0, 1.0)

    def distance(score):
        return np.sqrt(np.maximum(2.0 - 2.0 * score, 0.0))

    def rough(a: list, b: list) -> tuple[np.ndarray, float]:
        # half of the bytes; the error of a sum of products is below its number of terms times the rounding of one
        return a[0].astype(np.float32) @ b[0].astype(np.float32).T, (a[0].shape[1] + 8) * 2.0**-23

    def pairs(a: list, b: list, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        found, step = np.zeros(len(row)), max(1, STEP_NUMBERS // max(1, a[0].shape[1]))
        for start in range(0, len(row), step):
            part = slice(start, start + step)
            found[part] = np.einsum("ij,ij->i", a[0][row[part]], b[0][column[part]])
        return np.clip(found, -1.0, 1.0)

    return SimpleNamespace(
        columns=[vector], prepare=prepare, similarity=similarity, distance=distance, total=1.0, rough=rough, pairs=pairs,
        distance_column=lambda score: F.sqrt(F.greatest(2.0 - 2.0 * score, F.lit(0.0))),
    )


def _assign_to_pivots(metric, pivots: pd.DataFrame):
    def assign(batches):
        for batch in batches:
            features, centres = metric.prepare(batch, pivots)
            cells, nearest = [], []
            step = max(1, STEP_NUMBERS // max(1, len(pivots)))
            for start in range(0, len(batch), step):
                distances = metric.distance(metric.similarity([f[start : start + step] for f in features], centres))
                cells.append(distances.argmin(axis=1).astype("int32"))
                nearest.append(distances.min(axis=1))
            if cells:
                yield batch.assign(cell=np.concatenate(cells), cell_distance=np.concatenate(nearest))

    return assign


def _groups_of_cells(metric, pivots: pd.DataFrame, sizes: dict[int, int], block_rows: int) -> list[list[int]]:
    """Cells put together with near ones into groups of at most ``block_rows`` members; a larger cell is a group of its own."""
    guides = pivots.iloc[: math.isqrt(len(pivots)) + 1]
    features, centres = metric.prepare(pivots, guides)
    apart = metric.distance(metric.similarity(features, centres))
    groups, filled = [], block_rows
    for cell in np.lexsort((apart.min(axis=1), apart.argmin(axis=1))).tolist():
        size = sizes.get(cell, 0)
        if size:
            if filled + size > block_rows:
                groups.append([])
                filled = 0
            groups[-1].append(cell)
            filled += size
    return groups


def _choose_cells(metric, pivots: pd.DataFrame, radius: np.ndarray, nearest: np.ndarray, k: int, reach: float, groups: list[list[int]]):
    """Per profile, the cells besides its own that may hold one of its k nearest: per group of cells, a bit for each.

    Two bounds hold for the distance of the k-th neighbour: the one found in the own cell (``bound``,
    null if there were fewer), and pivot distance plus member distance. ``nearest`` has, per cell, the
    k + 1 smallest distances of its members to the pivot (inf where fewer).
    """

    def choose(batches):
        for batch in batches:
            features, centres = metric.prepare(batch, pivots)
            step = max(1, STEP_NUMBERS // max(1, nearest.size))
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                to_pivot = metric.distance(metric.similarity([f[start : start + step] for f in features], centres))
                bounds = (to_pivot[:, :, None] + nearest[None]).reshape(len(part), -1)
                # the k + 1 nearest include the profile itself
                limit = np.minimum(np.partition(bounds, k, axis=1)[:, k], reach)
                limit = np.fmin(limit, part["bound"].to_numpy(float)) + SLACK
                home = part["cell"].to_numpy()
                own = part["cell_distance"].to_numpy()[:, None]
                below = np.maximum(to_pivot - radius, (to_pivot - own) / 2)
                may_hold = (below <= limit[:, None]) & (radius >= 0)
                may_hold[np.arange(len(part)), home] = False
                found, bits = [[] for _ in home], [[] for _ in home]
                for group, cells in enumerate(groups):
                    wanted = may_hold[:, cells]
                    packed = np.packbits(wanted, axis=1)
                    for row in np.flatnonzero(wanted.any(axis=1)).tolist():
                        found[row].append(group)
                        bits[row].append(packed[row].tobytes())
                yield pd.DataFrame({"profile": part["profile"].to_numpy(), "floor": part["floor"].to_numpy(), "groups": found, "bits": bits})

    return choose


def _search_block(metric, k: int, digits: int, groups: list[list[int]]):
    """The k best per profile among the members of a block, cell by cell as far as the profile's bits ask for it."""

    def best_of(rows, others, scores):
        order = np.lexsort((others, -scores, rows))
        rows, others, scores = rows[order], others[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < k
        return rows[kept], others[kept], scores[kept], rows[place == k - 1], scores[place == k - 1]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows, others, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if len(left) and len(right):
            cells = groups[left["group"].iloc[0]]
            right = right.sort_values(["cell", "profile"], kind="stable").reset_index(drop=True)
            features, members = metric.prepare(left, right)
            names, ids, homes = left["profile"].to_numpy(), right["profile"].to_numpy(), right["cell"].to_numpy()
            packed = np.frombuffer(b"".join(left["bits"]), dtype=np.uint8).reshape(len(left), -1)
            # nothing below the k-th at home can count, nor what is not above 0
            floor = np.fmax(left["floor"].to_numpy(float), np.nextafter(0.0, 1.0))
            held = [(rows, others, scores)]
            waiting = 0
            for place, cell in enumerate(cells):
                first, last = np.searchsorted(homes, cell), np.searchsorted(homes, cell, "right")
                asking = np.flatnonzero(packed[:, place // 8] >> (7 - place % 8) & 1)
                if first == last or not len(asking):
                    continue
                theirs, own = [m[first:last] for m in members], ids[first:last]
                step = max(1, STEP_NUMBERS // (last - first))
                for start in range(0, len(asking), step):
                    some = asking[start : start + step]
                    points = [f[some] for f in features]
                    score, error = metric.rough(points, theirs)
                    at = np.minimum(np.searchsorted(own, names[some]), len(own) - 1)
                    itself = own[at] == names[some]
                    score[itself, at[itself]] = -np.inf
                    error += 10.0**-digits
                    limit = floor[some] - error
                    if len(own) > k and (score >= limit[:, None]).sum() > 2 * k * len(some):
                        # everything that may be as good as the k-th, ties included
                        limit = np.maximum(limit, -np.partition(-score, k - 1, axis=1)[:, k - 1] - 2 * error)
                    row, col = np.nonzero(score >= limit[:, None])
                    exact = np.round(metric.pairs(points, theirs, row, col), digits)
                    kept = exact >= floor[some][row]
                    row, col = row[kept], col[kept]
                    held.append((some[row], own[col], exact[kept]))
                    waiting += len(row)
                    if waiting > MOST_FOUND:
                        rows, others, scores, full, worst = best_of(*(np.concatenate(h) for h in zip(*held)))
                        floor[full] = np.maximum(floor[full], worst)
                        held, waiting = [(rows, others, scores)], 0
            rows, others, scores = best_of(*(np.concatenate(h) for h in zip(*held)))[:3]
            rows = names[rows]
        return pd.DataFrame({"profile": rows, "other": others, "similarity": scores}).astype({"profile": "int64", "other": "int64", "similarity": "float64"})

    return search


def _bounded_top(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n rows per key; Spark limits each group map-side before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def nearest_neighbours(
    nodes: DataFrame,
    node: str,
    metric,
    k: int,
    digits: int = 9,
    block_rows: int | None = None,
    pivot_count: int | None = None,
) -> DataFrame:
    """Edges (src, dst, weight) from every node to its k most similar others with similarity above 0.

    Similarities are rounded to ``digits`` and ties go to the smaller id. A node that is listed repeatedly counts once, with
    the smallest of its features. Blocks have ``block_rows`` profiles, by default enough of them for all cores.
    """
    spark = nodes.sparkSession
    features = list(metric.columns)
    if k <= 0:
        empty = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                              T.StructField("weight", T.DoubleType())])
        return spark.createDataFrame([], empty)
    in_boxes = hasattr(metric, "parts")
    kinds = {f: ("double" if f in metric.near else "string") if in_boxes else nodes.schema[f].dataType for f in features}
    listed = nodes.select(F.col(node).cast("long").alias("node"), F.struct(*[F.col(f).cast(t).alias(f) for f, t in kinds.items()]).alias("_f"))
    source = cut_lineage(listed.groupBy("node").agg(F.min("_f").alias("_f")).select("node", "_f.*"), "nodes")
    if in_boxes:
        return nearest_by_boxes(source, metric, k, digits, block_rows)

    grouped = source.groupBy(*features).agg(F.min("node").alias("profile"), F.count("*").alias("members"))
    # comparing is heavy for few bytes, so the spread is set by the cores and not by the size
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    profiles = cut_lineage(grouped.repartition(tasks, "profile"), "profiles")
    n = profiles.count()
    wanted = pivot_count or 2 * math.isqrt(n) + 1
    block_rows = block_rows or min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, math.ceil(n / math.sqrt(4 * tasks))))
    pivots = profiles.orderBy(F.xxhash64("profile"), "profile").limit(wanted).select(*features).toPandas()

    schema = T.StructType([*profiles.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("cell_distance", T.DoubleType())])
    assigned = cut_lineage(profiles.mapInPandas(_assign_to_pivots(metric, pivots), schema), "cells")

    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("cell_distance").alias("radius")).collect()
    closest = _bounded_top(assigned.select("cell", "cell_distance", "profile"), ["cell"],
                           ["cell_distance", "profile"], k + 1)
    radius = np.full(len(pivots), -1.0)
    nearest = np.full((len(pivots), k + 1), np.inf)
    for row in sizes:
        radius[row["cell"]] = row["radius"]
    lists = closest.groupBy("cell").agg(F.array_sort(F.collect_list("cell_distance")).alias("d")).collect()
    for row in lists:
        nearest[row["cell"], : len(row["d"])] = row["d"]

    reach = float(metric.distance(0.0))  # beyond it the similarity is not above 0

    members = {row["cell"]: row["n"] for row in sizes}
    groups = _groups_of_cells(metric, pivots, members, block_rows)
    weight = [sum(members[c] for c in cells) for cells in groups]
    place = [(c, g, i) for g, cells in enumerate(groups) for i, c in enumerate(cells)]
    of_cell = spark.createDataFrame(place or [(0, 0, 0)], "cell int, group int, bit int")

    def search(queries: DataFrame, demand: dict[int, int]) -> DataFrame:
        """The k best of each searched block per profile; queries have ``group`` and ``bits``."""
        cuts = [(g, math.ceil(weight[g] / block_rows), math.ceil(most / block_rows)) for g, most in demand.items()]
        table = spark.createDataFrame(cuts, "group int, member_blocks int, search_blocks int")
        slot = F.hash("profile")
        right = assigned.join(F.broadcast(of_cell.join(F.broadcast(table), "group")), "cell").select(
            "profile", *features, "cell", "group",
            F.pmod(slot, F.col("member_blocks")).alias("member_block"),
            F.explode(F.sequence(F.lit(0), F.col("search_blocks") - 1)).alias("search_block"),
        )
        left = queries.join(F.broadcast(table), "group").select(
            "profile", *features, "floor", "bits", "group",
            F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("member_block"),
            F.pmod(slot, F.col("search_blocks")).alias("search_block"),
        )
        block = ["group", "member_block", "search_block"]
        # both sides may come from the same table: fresh column identities keep them apart
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        # one shuffle per side, with as many partitions as there are blocks, up to the cores of the cluster
        spread = max(1, min(sum(m * q for _, m, q in cuts), 4 * tasks))
        return (
            left.repartition(spread, *block).groupBy(*block)
            .cogroup(right.repartition(spread, *block).groupBy(*block))
            .applyInPandas(_search_block(metric, k, digits, groups), "profile long, other long, similarity double")
        )

    order = [F.desc("similarity"), F.asc("other")]
    masks = [(c, g, np.packbits(np.arange(len(groups[g])) == i).tobytes()) for c, g, i in place]
    own_bits = spark.createDataFrame(masks, "cell int, group int, bits binary")
    at_home = search(
        assigned.join(F.broadcast(own_bits), "cell").withColumn("floor", F.lit(None).cast("double")), dict(enumerate(weight))
    ) if masks else spark.createDataFrame([], "profile long, other long, similarity double")
    near = cut_lineage(_bounded_top(at_home, ["profile"], order, k), "near")
    pairs = near
    if len(sizes) > 1:
        # the k-th at home, less the rounding of similarities, is at most this far away; null if there is none
        full = near.groupBy("profile").agg(F.min("similarity").alias("floor"), F.count("*").alias("_found"))
        known = full.filter(F.col("_found") == k).select(
            "profile", "floor", metric.distance_column(F.col("floor") - 10.0**-digits).alias("bound")
        )
        bounded = assigned.join(known, "profile", "left").select(*assigned.columns, "floor", "bound")
        searching = cut_lineage(
            bounded.mapInPandas(
                _choose_cells(metric, pivots, radius, nearest, k, reach, groups),
                "profile long, floor double, groups array<int>, bits array<binary>",
            ),
            "searches",
        )
        asked = searching.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n"))
        demand = {r["group"]: r["n"] for r in asked.collect()}
        if demand:
            each = searching.join(assigned.select("profile", *features), "profile").select(
                "profile", *features, "floor", F.explode(F.arrays_zip("groups", "bits")).alias("_g")
            )
            queries = each.select("profile", *features, "floor", F.col("_g.groups").alias("group"), F.col("_g.bits").alias("bits"))
            pairs = near.unionByName(search(queries, demand))
    best = _bounded_top(pairs, ["profile"], order, k)

    # a profile with several members is its own nearest neighbour
    own = profiles.filter("members > 1").select(
        "profile", F.col("profile").alias("other"), F.lit(float(metric.total)).alias("similarity")
    )
    links = best.unionByName(own)
    described = profiles.select("profile", *[F.col(f).alias(f"_{f}") for f in features])
    members_of = source.join(described, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in features])
    first_members = _bounded_top(members_of.select("profile", "node"), ["profile"], ["node"], k + 1)
    options = links.join(first_members.withColumnsRenamed({"profile": "other", "node": "dst"}), "other")
    ranked = _bounded_top(options, ["profile"], [F.desc("similarity"), F.asc("dst")], k + 1)
    short_lists = ranked.groupBy("profile").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "dst"))).alias("_options")
    )
    others = F.slice(F.filter("_options", lambda o: o["dst"] != F.col("node")), 1, k)
    return (
        members_of.select("profile", "node")
        .join(short_lists, "profile")
        .select(F.col("node").alias("src"), F.explode(others).alias("_o"))
        .select("src", F.col("_o.dst").alias("dst"), (-F.col("_o.minus")).alias("weight"))
    )
