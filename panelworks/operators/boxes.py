"""Exact nearest neighbours for similarities that are sums of agreements per column.

Such a similarity falls with the gap in each column, so a box of nodes has a highest similarity with anything outside it.
Profiles are dealt to cells by a tree of cuts, made from a spread of them; each cell is cut further into leaves by the task
that holds it. A leaf meets the others in the order of what they can offer, until none can hold one of the k best. Only
profiles near the edge of their cell are sent to the other cells that may hold nearer ones. How the cuts fall decides how
much is compared, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelworks.scale import cut_lineage

# Profiles of the spread per cell.
SPREAD = 64
# Least and most profiles of a cell.
CELL_ROWS = 2048
MOST_CELL_ROWS = 32768
# Profiles of a leaf, and members that a leaf meets first and at each later step.
LEAF_ROWS = 64
FIRST_MEMBERS = 192
STEP_MEMBERS = 768
# Numbers of a matrix that one step holds at once.
STEP_NUMBERS = 1 << 20


def _tools(parts: list[tuple[float, float | None]]):
    """Cuts, leaves, boxes and bounds for columns of numbers; a column without scale counts when equal.

    Functions inside a function travel to the workers by value.
    """

    def cut(x: np.ndarray):
        """Column and threshold that part the rows where most similarity is lost; None where all rows are equal."""
        best, found = -1.0, None
        for column, (weight, scale) in enumerate(parts):
            values = np.sort(np.where(np.isnan(x[:, column]), np.inf, x[:, column]))
            if values[0] == values[-1]:
                continue
            low, high = values[len(values) // 10], values[-1 - len(values) // 10]
            width = weight if scale is None else 0.0 if low == high else weight * -math.expm1(-(high - low) / scale)
            if width > best:
                middle = values[len(values) // 2]
                at = middle if middle > values[0] else values[np.searchsorted(values, middle, "right")]
                best, found = width, (column, at)
        return found

    def leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
        """Places of the rows, leaf by leaf."""
        found, waiting = [], [np.arange(len(x))] if len(x) else []
        while waiting:
            rows = waiting.pop()
            parted = cut(x[rows]) if len(rows) > most else None
            if parted is None:
                found += [rows[i : i + most] for i in range(0, len(rows), most)]
                continue
            below = x[rows, parted[0]] < parted[1]
            waiting += [rows[~below], rows[below]]
        return found

    def boxes(x: np.ndarray, groups: list[np.ndarray]):
        """Smallest and largest number per leaf and column (NaN where there is none), and whether one is missing."""
        order = np.concatenate(groups)
        starts = np.cumsum([0] + [len(g) for g in groups[:-1]])
        placed = x[order]
        return np.fmin.reduceat(placed, starts), np.fmax.reduceat(placed, starts), np.logical_or.reduceat(np.isnan(placed), starts)

    def highest(a, b) -> np.ndarray:
        """The most that anything in a box of ``a`` can have in common with anything in a box of ``b``."""
        score = np.zeros((len(a[0]), len(b[0])))
        for column, (weight, scale) in enumerate(parts):
            (low, high, missing), (lowest, most, absent) = ((f[:, column] for f in side) for side in (a, b))
            with np.errstate(invalid="ignore"):
                gap = lowest[None, :] - high[:, None]
                np.fmax(gap, low[:, None] - most[None, :], out=gap)
            if scale is None:
                near = (gap <= 0).astype(float)
            else:
                near = np.maximum(gap, 0.0, out=gap)
                near /= -scale
                np.exp(near, out=near)
                near[np.isnan(near)] = 0.0
            if missing.any() and absent.any():
                near = np.maximum(near, missing[:, None] & absent[None, :])
            near *= weight
            score += near
        return score

    return cut, leaves, boxes, highest


def _ranks():
    """Texts as numbers in their order: their place among given texts, halves between them; missing ones are NaN."""

    def ranks(texts: pd.Series, among: np.ndarray) -> np.ndarray:
        codes, values = pd.factorize(texts)
        values = np.asarray(values, dtype=object)
        place = (np.searchsorted(among, values) + np.searchsorted(among, values, "right")) / 2 if len(among) else np.zeros(len(values))
        return np.append(place, np.nan)[codes]

    return ranks


def _tree(spread: pd.DataFrame, texts: list[str], numbers: list[str], parts, most: int):
    """Cuts of the spread as arrays: column, threshold, the two following nodes, and the cell where a node is a leaf."""
    cut, ranks = _tools(parts)[0], _ranks()
    among = {c: np.array(sorted(spread[c].dropna().unique()), dtype=object) for c in texts}
    x = np.column_stack([ranks(spread[c], among[c]) for c in texts] + [spread[c].to_numpy(float) for c in numbers])
    nodes, waiting, cells = [[0, 0.0, 0, 0, -1]], [(0, np.arange(len(x)))], 0
    while waiting:
        node, rows = waiting.pop()
        parted = cut(x[rows]) if len(rows) > most else None
        if parted is None:
            nodes[node][4] = cells
            cells += 1
            continue
        below = x[rows, parted[0]] < parted[1]
        nodes[node] = [parted[0], parted[1], len(nodes), len(nodes) + 1, -1]
        nodes += [[0, 0.0, 0, 0, -1], [0, 0.0, 0, 0, -1]]
        waiting += [(len(nodes) - 2, rows[below]), (len(nodes) - 1, rows[~below])]
    return among, [np.array(n) for n in zip(*nodes)]


def _deal(texts: list[str], numbers: list[str], tree):
    among, (column, at, below, above, cell) = tree
    ranks = _ranks()

    def deal(batches):
        for batch in batches:
            frame = batch.select([*texts, *numbers]).to_pandas()
            x = np.column_stack([ranks(frame[c], among[c]) for c in texts] + [frame[c].to_numpy(float) for c in numbers])
            node = np.zeros(len(x), dtype=np.int64)
            while (inside := np.flatnonzero(cell[node] < 0)).size:
                here = node[inside]
                node[inside] = np.where(x[inside, column[here]] < at[here], below[here], above[here])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[node].astype("int32"))], [*batch.schema.names, "cell"])

    return deal


def _search(metric, texts: list[str], numbers: list[str], k: int, digits: int, boxes_of_cells=None):
    """The k + 1 best nodes per profile among the members of a cell; at home also the cells that may hold better ones.

    ``boxes_of_cells`` is given at home: the texts that bound the cells, and per cell its number and box.
    """
    tools, ranks = _tools(metric.parts), _ranks()
    total, lost = round(float(metric.total), digits), 10.0**-digits
    names = ["profile", *texts, *numbers]

    def lists(table: pa.Table, name: str):
        column = table.column(name).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        starts = column.offsets.to_numpy().astype(np.int64)
        return column.flatten().to_numpy(zero_copy_only=False), starts[:-1] - starts[0], np.diff(starts)

    def expanded(rows, starts, counts):
        """Places of all entries of the lists that ``rows`` name, and which row each belongs to."""
        each = counts[rows]
        owner = np.repeat(np.arange(len(rows)), each)
        return owner, np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[rows], each)

    def search(asking: pd.DataFrame, members: pd.DataFrame, nodes, floor: np.ndarray, at_home: bool):
        _, leaves, boxes, highest = tools
        features, theirs = metric.prepare(asking, members)
        x, y = np.column_stack(features).astype(float), np.column_stack(theirs).astype(float)
        groups, held_by = leaves(x, LEAF_ROWS), leaves(y, LEAF_ROWS)
        mine, box = boxes(x, groups), boxes(y, held_by)
        sizes = np.array([len(g) for g in held_by])
        ids, starts, counts = nodes
        where, found = np.full(len(y), -1), []
        for place, rows in enumerate(groups):
            bound = highest(tuple(b[place : place + 1] for b in mine), box)[0]
            order = np.argsort(-bound, kind="stable")
            points = [f[rows] for f in features]
            point_boxes = (x[rows], x[rows], np.isnan(x[rows]))
            # the best so far, a node each; the own nodes are among them
            best = np.full((len(rows), k + 1), -np.inf)
            if at_home:
                best[np.arange(k + 1)[None, :] < counts[rows][:, None]] = total
            limit = np.maximum(floor[rows], best.min(axis=1))
            held, done, most = [], 0, FIRST_MEMBERS
            while done < len(order):
                order = order[: np.searchsorted(-bound[order], -(limit.min() - lost), "right")]
                upto = done + max(1, int(np.searchsorted(np.cumsum(sizes[order[done:]]), most, "right")))
                some, done, most = order[done:upto], upto, STEP_MEMBERS
                if len(some) and len(held):
                    can = highest(point_boxes, tuple(b[some] for b in box)) >= limit[:, None] - lost
                    some = some[can.any(axis=0)]
                if not len(some):
                    continue
                columns = np.concatenate([held_by[i] for i in some])
                score = np.round(metric.similarity(points, [f[columns] for f in theirs]), digits)
                if at_home:
                    where[columns] = np.arange(len(columns))
                    own = np.flatnonzero(where[rows] >= 0)
                    score[own, where[rows[own]]] = -np.inf
                    where[columns] = -1
                best = -np.partition(-np.concatenate([best, score], axis=1), k, axis=1)[:, : k + 1]
                limit = np.maximum(limit, best.min(axis=1))
                row, column = np.nonzero(score >= limit[:, None])
                held.append((row, columns[column], score[row, column]))
            if held:
                row, column, score = (np.concatenate(h) for h in zip(*held))
                kept = score >= limit[row]
                found.append((rows[row[kept]], column[kept], score[kept]))
        row, column, score = (np.concatenate(h) for h in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
        if at_home:
            own = np.arange(len(x))
            row, column, score = np.append(row, own), np.append(column, own), np.append(score, np.full(len(x), total))
        pair, entry = expanded(column, starts, counts)
        row, node, score = row[pair], ids[entry], score[pair]
        order = np.lexsort((node, -score, row))
        row, node, score = row[order], node[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
        row, node, score = row[kept], node[kept], score[kept]
        ends = np.searchsorted(row, np.arange(len(x) + 1)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(ends), pa.array(node.astype(np.int64)))
        scores = pa.ListArray.from_arrays(pa.array(ends), pa.array(score.astype(float)))
        full = np.diff(ends) == k + 1
        worst = np.full(len(x), -np.inf)
        worst[full] = score[ends[1:][full] - 1]
        return others, scores, np.maximum(worst, floor), groups

    def other_cells(frame: pd.DataFrame, worst: np.ndarray, groups, home: int):
        _, _, boxes, highest = tools
        among, numbers_of, box = boxes_of_cells
        x = np.column_stack([ranks(frame[c], among[c]) for c in texts] + [frame[c].to_numpy(float) for c in numbers])
        elsewhere = numbers_of != home
        mine = boxes(x, groups)
        found = [np.zeros(0, dtype=np.int32)] * len(x)
        step = max(1, STEP_NUMBERS // max(1, len(numbers_of)))
        for start in range(0, len(groups), step):
            bounds = highest(tuple(b[start : start + step] for b in mine), box)
            for rows, bound in zip(groups[start : start + step], bounds):
                near = np.flatnonzero((bound >= worst[rows].min() - lost) & elsewhere)
                if len(near):
                    can = highest((x[rows], x[rows], np.isnan(x[rows])), tuple(b[near] for b in box)) >= worst[rows][:, None] - lost
                    for row, cells in zip(rows.tolist(), can):
                        found[row] = numbers_of[near[cells]].astype(np.int32)
        ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int32)))

    def at_home(table: pa.Table) -> pa.Table:
        frame = table.select(names).to_pandas()
        floor = np.full(len(frame), np.nextafter(0.0, 1.0))
        others, scores, worst, groups = search(frame, frame, lists(table, "nodes"), floor, True)
        cells = other_cells(frame, worst, groups, table.column("cell")[0].as_py())
        kept = table.select([*names, "nodes"])
        for name, column in (("floor", pa.array(worst)), ("others", others), ("scores", scores), ("cells", cells)):
            kept = kept.append_column(name, column)
        return kept

    def visiting(left: pa.Table, right: pa.Table) -> pa.Table:
        frame, members = left.select(names).to_pandas(), right.select(names).to_pandas()
        if not len(frame) or not len(members):
            return pa.table({"profile": pa.array([], pa.int64()), "others": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        others, scores, _, _ = search(frame, members, lists(right, "nodes"), left.column("floor").to_numpy(), False)
        found = pa.table({"profile": left.column("profile").combine_chunks(), "others": others, "scores": scores})
        return found.filter(pa.array(np.diff(others.offsets.to_numpy()) > 0))

    return at_home, visiting


def _boxes_of_cells(assigned: DataFrame, texts: list[str], numbers: list[str]):
    """The texts that bound the cells, the cells' numbers, and their boxes; also their sizes."""
    bounds = [f(c).alias(f"{name}_{i}") for i, c in enumerate([*texts, *numbers]) for name, f in (
        ("low", F.min), ("high", F.max), ("missing", lambda c: F.count_if(F.col(c).isNull() | (F.col(c).isNaN() if c in numbers else F.lit(False))))
    )]
    # NaN is as good as missing, and would be the largest number
    clean = assigned.select("cell", *texts, *numbers)
    clean = clean.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    rows = clean.groupBy("cell").agg(F.count("*").alias("n"), *bounds).toPandas()
    ranks, among, columns = _ranks(), {}, {"low": [], "high": [], "missing": []}
    for i, c in enumerate([*texts, *numbers]):
        if c in texts:
            among[c] = np.array(sorted({*rows[f"low_{i}"].dropna(), *rows[f"high_{i}"].dropna()}), dtype=object)
        for name in ("low", "high"):
            columns[name].append(ranks(rows[f"{name}_{i}"], among[c]) if c in texts else rows[f"{name}_{i}"].to_numpy(float))
        columns["missing"].append(rows[f"missing_{i}"].to_numpy() > 0)
    box = tuple(np.column_stack(columns[name]) for name in ("low", "high", "missing"))
    return (among, rows["cell"].to_numpy(), box), dict(zip(rows["cell"].tolist(), rows["n"].tolist()))


def nearest_by_boxes(source: DataFrame, metric, k: int, digits: int, block_rows: int | None) -> DataFrame:
    """Edges of ``nearest_neighbours`` for nodes ``node`` with a similarity of agreements per column."""
    spark = source.sparkSession
    texts, numbers = metric.columns[: -len(metric.near) or None], metric.columns[len(metric.columns) - len(metric.near) :]
    features = [*texts, *numbers]
    first = Window.partitionBy(*features).orderBy("node")
    members = source.filter("node IS NOT NULL").withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= k + 1)
    grouped = members.groupBy(*features).agg(F.min("node").alias("profile"), F.sort_array(F.collect_list("node")).alias("nodes"))
    # comparing is heavy for few bytes, so the spread is set by the cores and not by the size
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    profiles = cut_lineage(grouped.select("profile", *features, "nodes").repartition(tasks, "profile"), "profiles")
    n, crowded = profiles.agg(F.count("*"), F.count_if(F.size("nodes") > k)).first()
    block_rows = block_rows or min(MOST_CELL_ROWS, max(CELL_ROWS, math.ceil(n / (2 * tasks))))
    wanted = SPREAD * math.ceil(n / block_rows) if n > block_rows else 0
    spread = profiles.orderBy(F.xxhash64("profile"), "profile").limit(wanted).select(*features).toPandas()
    tree = _tree(spread, texts, numbers, metric.parts, SPREAD)
    schema = T.StructType([*profiles.schema.fields, T.StructField("cell", T.IntegerType())])
    assigned = cut_lineage(profiles.mapInArrow(_deal(texts, numbers, tree), schema), "cells")
    boxes, sizes = _boxes_of_cells(assigned, texts, numbers)
    described = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in profiles.schema.fields)
    at_home, visiting = _search(metric, texts, numbers, k, digits, boxes)
    spread_over = max(1, min(len(sizes), 4 * tasks))
    near = cut_lineage(
        assigned.repartition(spread_over, "cell").groupBy("cell").applyInArrow(
            at_home, f"{described}, floor double, others array<bigint>, scores array<double>, cells array<int>"),
        "near",
    )
    asking = near.select("profile", *features, "floor", F.explode("cells").alias("cell"))
    demand = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    options = near.select("profile", "nodes", F.arrays_zip((F.transform("scores", lambda s: -s)).alias("minus"), F.col("others").alias("dst")).alias("_options"))
    if demand:
        cuts = [(c, math.ceil(sizes[c] / block_rows), math.ceil(most / block_rows)) for c, most in demand.items()]
        table = F.broadcast(spark.createDataFrame(cuts, "cell int, member_blocks int, search_blocks int"))
        slot, block = F.hash("profile"), ["cell", "member_block", "search_block"]
        left = asking.join(table, "cell").select(
            "profile", *features, "floor", "cell", F.pmod(slot, F.col("search_blocks")).alias("search_block"),
            F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)).alias("member_block"),
        )
        right = assigned.join(table, "cell").select(
            "profile", *features, "nodes", "cell", F.pmod(slot, F.col("member_blocks")).alias("member_block"),
            F.explode(F.sequence(F.lit(0), F.col("search_blocks") - 1)).alias("search_block"),
        )
        count = max(1, min(sum(m * q for _, m, q in cuts), 4 * tasks))
        found = (
            left.repartition(count, *block).groupBy(*block).cogroup(right.repartition(count, *block).groupBy(*block))
            .applyInArrow(visiting, "profile long, others array<bigint>, scores array<double>")
        )
        entries = found.select("profile", F.arrays_zip((F.transform("scores", lambda s: -s)).alias("minus"), F.col("others").alias("dst")).alias("_more"))
        more = entries.groupBy("profile").agg(F.flatten(F.collect_list("_more")).alias("_more"))
        both = F.slice(F.array_sort(F.concat("_options", "_more")), 1, k + 1)
        options = options.join(more, "profile", "left").withColumn("_options", F.when(F.col("_more").isNull(), F.col("_options")).otherwise(both)).drop("_more")

    def edges(listed: DataFrame) -> DataFrame:
        others = F.slice(F.filter("_options", lambda o: o["dst"] != F.col("src")), 1, k)
        return listed.select("src", F.explode(others).alias("_o")).select("src", F.col("_o.dst").alias("dst"), (-F.col("_o.minus")).alias("weight"))

    links = edges(options.select(F.explode("nodes").alias("src"), "_options"))
    if crowded:
        # nodes beyond the first k + 1 of a profile are in nobody's list, and all have the same one
        hot = options.filter(F.size("nodes") > k).withColumn("_last", F.col("nodes")[k]).select("profile", "_options", "_last")
        named = hot.join(profiles.select("profile", *[F.col(f).alias(f"_{f}") for f in features]), "profile")
        rest = source.join(named, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in features]).filter("node > _last")
        links = links.unionByName(edges(rest.select(F.col("node").alias("src"), "_options")))
    return links
