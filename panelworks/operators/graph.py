"""Similarity graphs between entities as edge tables, and neighbour aggregation over them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelworks.functions.scaling import to_number
from panelworks.operators.enrich import value_codes
from panelworks.operators.neighbours import attribute_metric, cosine_metric, nearest_neighbours
from panelworks.operators.summaries import fill_with_median
from panelworks.scale import attach, cut_lineage

# Weights and scales of the attribute similarity.
SITE_WEIGHT = 0.35
PRIMARY_USE_WEIGHT = 0.30
SIZE_WEIGHT = 0.15
AGE_WEIGHT = 0.10
FLOOR_WEIGHT = 0.10
AGE_SCALE = 10.0
FLOOR_SCALE = 3.0
TOP_K = 20
# Readings that a task sums, about.
MOST_SUMS = 1_000_000

ATTRIBUTES = attribute_metric(
    equal={"site_id": SITE_WEIGHT, "primary_use": PRIMARY_USE_WEIGHT},
    near={"size": (SIZE_WEIGHT, 1.0), "age": (AGE_WEIGHT, AGE_SCALE), "floor_count": (FLOOR_WEIGHT, FLOOR_SCALE)},
)


def similarity_attributes(buildings: DataFrame, entity: str = "building_id", reference_year: int = 2016) -> DataFrame:
    """Attributes the similarity compares: gaps in numbers take the median, gaps in text a common mark."""
    named = buildings.select(
        entity,
        *[F.coalesce(F.col(c).cast("string"), F.lit(f"missing {c}")).alias(c) for c in ("site_id", "primary_use")],
        to_number(F.col("square_feet")).alias("square_feet"),
        (
            to_number(F.col("age")) if "age" in buildings.columns else reference_year - to_number(F.col("year_built"))
        ).alias("age"),
        to_number(F.col("floor_count")).alias("floor_count"),
    )
    named = fill_with_median(named, ("square_feet", "age", "floor_count"), 0.0)
    size = F.log1p(F.greatest(F.col("square_feet"), F.lit(0.0)))
    return named.select(entity, "site_id", "primary_use", size.alias("size"), "age", "floor_count")


def attribute_graph(
    buildings: DataFrame, k: int = TOP_K, entity: str = "building_id", reference_year: int = 2016, **options
) -> DataFrame:
    """Edges to the k most similar buildings, weighted by attribute similarity."""
    attributes = similarity_attributes(buildings, entity, reference_year)
    return nearest_neighbours(attributes, entity, ATTRIBUTES, k, **options)


def embedding_graph(embeddings: DataFrame, node: str, vector: str, k: int = TOP_K, **options) -> DataFrame:
    """Edges to the k nodes with the largest positive cosine similarity."""
    return nearest_neighbours(embeddings.select(node, vector), node, cosine_metric(vector), k, **options)


def normalise_rows(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Add a self edge of weight 1 per node and divide by the row sum."""
    distinct = nodes.select(F.col(node).cast("long").alias("src")).distinct()
    loops = distinct.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    every = edges.filter("src <> dst").unionByName(loops)
    total = F.sum("weight").over(Window.partitionBy("src"))
    return every.withColumn("weight", F.col("weight") / total)


def fuse_graphs(learned: DataFrame, static: DataFrame, alpha: float) -> DataFrame:
    """alpha * learned + (1 - alpha) * static over the union of their edges, without a join."""
    weighted = learned.select("src", "dst", (F.col("weight") * alpha).alias("weight")).unionByName(
        static.select("src", "dst", (F.col("weight") * (1 - alpha)).alias("weight"))
    )
    return weighted.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def edge_list(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Non-zero edges with ids, 0-based node indexes and the self-loop flag."""
    index = value_codes(nodes.select(F.col(node).cast("long").alias(node)), node)
    indexed = attach(edges.filter("weight <> 0"), index.toDF("src", "src_index"), ["src"])
    indexed = attach(indexed, index.toDF("dst", "dst_index"), ["dst"])
    return indexed.select(
        "src_index", "dst_index", F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), "weight",
        (F.col("src") == F.col("dst")).alias("is_self_loop"),
    )


def _packed(panel: DataFrame, node: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """The panel as arrays, a row per node and quarter of a year: ``dst``, ``_ts`` and an array per column."""
    when = F.date_trunc("quarter", ts) if panel.schema[ts].dataType.typeName().startswith(("timestamp", "date")) else F.lit(0)
    rows = panel.select(F.col(node).cast("long").alias("dst"), when.alias("_quarter"), F.struct(F.col(ts).alias("_ts"), *columns).alias("_row"))
    packed = rows.filter("dst IS NOT NULL").groupBy("dst", "_quarter").agg(F.collect_list("_row").alias("_rows"))
    return packed.select("dst", F.col("_rows._ts").alias("_ts"), *[F.col("_rows")[c].alias(f"_{c}") for c in columns])


def _weighted_sums(edges: DataFrame, packed: DataFrame, columns: Sequence[str], ts: str, parts: int) -> DataFrame:
    """Weighted sums per ``src`` and timestamp. Series travel as arrays to the nodes they count for, and are opened there."""
    keys = [c for c in ("dst", "made") if c in packed.columns]
    sent = edges.join(packed, keys).select("src", "weight", "_ts", *[f"_{c}" for c in columns]).repartition(parts, "src")
    rows = sent.select("src", "weight", *[f"_{c}" for c in columns], F.posexplode("_ts").alias("_at", ts))
    return rows.groupBy("src", ts).agg(*[F.sum(F.col("weight") * F.get(f"_{c}", "_at")).alias(c) for c in columns])


def aggregate_neighbours(
    edges: DataFrame, panel: DataFrame, columns: Sequence[str], ts: str = "timestamp", node: str = "building_id"
) -> DataFrame:
    """Weighted sum of the neighbours' features per hour and node.

    A series crosses the network as arrays, once per edge, and not as rows; the sums are made where the node is, without
    another shuffle. The join on the neighbour is an ordinary equality join: adaptive execution splits a node that many
    others point to. Nodes whose neighbours and weights are the same (as those of equal buildings are) share one sum,
    which then counts as a neighbour of weight 1.
    """
    spark = edges.sparkSession
    every = edges.groupBy("src").agg(F.collect_list(F.struct("dst", "weight")).alias("_every"))
    own = lambda e: F.coalesce(e["dst"] == F.col("src"), F.lit(False))
    lists = every.select(
        "src", F.array_sort(F.filter("_every", lambda e: ~own(e))).alias("_list"), F.filter("_every", own).alias("_own")
    )
    # two hashes from different seeds tell lists apart
    hashes = {"_key": F.xxhash64("_list"), "_check": F.xxhash64(F.lit("check"), "_list")}
    lists = cut_lineage(lists.withColumns(hashes), "neighbour-lists")
    packed = cut_lineage(_packed(panel, node, ts, columns), "packed-panel")
    shared = cut_lineage(
        lists.filter(F.size("_list") > 1).groupBy("_key", "_check").agg(F.min("src").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"),
        "shared-lists",
    )
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    nodes, degree = lists.agg(F.count("*"), F.sum(F.size("_list") + 1)).first()
    cells = packed.agg(F.sum(F.size("_ts"))).first()[0] or 0
    parts = max(tasks, math.ceil(cells * (degree or 0) / max(nodes, 1) / MOST_SUMS))
    opened = lambda table, name: table.select("src", F.explode(name).alias("_e")).select("src", "_e.dst", "_e.weight")
    if shared.isEmpty():
        summed = _weighted_sums(opened(lists, F.concat("_list", "_own")), packed, columns, ts, parts)
    else:
        of_first = lists.join(shared.withColumnRenamed("_first", "src").select("src"), "src", "left_semi")
        sums = _weighted_sums(opened(of_first, "_list"), packed, columns, ts, parts)
        made = _packed(sums, "src", ts, columns).withColumn("made", F.lit(True))
        placed = lists.join(shared.select("_key", "_check", "_first"), ["_key", "_check"], "left")
        alone = F.when(F.col("_first").isNull(), F.concat("_list", "_own")).otherwise(F.col("_own"))
        direct = opened(placed, alone).withColumn("made", F.lit(False))
        through = placed.filter("_first IS NOT NULL").select("src", F.col("_first").alias("dst"), F.lit(1.0).alias("weight"), F.lit(True).alias("made"))
        whole = packed.withColumn("made", F.lit(False)).unionByName(made)
        summed = _weighted_sums(direct.unionByName(through), whole, columns, ts, parts)
    return summed.select(ts, F.col("src").alias(node), *columns)
