"""Queries over similarity graphs and neighbour aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.catalogue.registry import query, rounded
from panelworks.catalogue.sql import BUILDINGS, READINGS, with_
from panelworks.operators import graph
from panelworks.sources import stand_ins

K = 20

ATTRIBUTE_EDGES = ["""
attributes AS (SELECT building_id, site_id, primary_use,
  ln(1 + greatest(coalesce(square_feet, (SELECT median(square_feet) FROM buildings)), 0)) AS size,
  coalesce(2016 - year_built, (SELECT median(2016 - year_built) FROM buildings)) AS age, floor_count AS floors FROM buildings)""", """
pairs AS (SELECT a.building_id AS src, b.building_id AS dst, round(0.35::DOUBLE * CAST(a.site_id = b.site_id AS INTEGER)
    + 0.3::DOUBLE * CAST(a.primary_use = b.primary_use AS INTEGER) + 0.15::DOUBLE * exp(-abs(a.size - b.size))
    + 0.1::DOUBLE * exp(-abs(a.age - b.age) / 10.0) + 0.1::DOUBLE * exp(-abs(a.floors - b.floors) / 3.0), 9) AS weight
  FROM attributes a JOIN attributes b ON a.building_id <> b.building_id)""", f"""
attribute_edges AS (SELECT src, dst, weight FROM pairs
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= {K})"""]

EMBEDDING_EDGES = [f"""
cosines AS (SELECT a.vec_id AS src, b.vec_id AS dst,
    round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS weight
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)""", f"""
embedding_edges AS (SELECT src, dst, weight FROM cosines WHERE weight > 0
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= {K})"""]


def normalised_sql(edges: str, nodes: str, name: str) -> str:
    return f"""
{name} AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS weight
  FROM (SELECT * FROM {edges} UNION ALL SELECT node, node, 1.0 FROM (SELECT DISTINCT {nodes})))"""


ATTRIBUTE_GRAPH = normalised_sql("attribute_edges", "building_id AS node FROM buildings", "attribute_graph")
EMBEDDING_GRAPH = normalised_sql("embedding_edges", "vec_id AS node FROM embeddings", "embedding_graph")


def attribute_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.attribute_graph(stand_ins.buildings(spark, folder), K)


def embedding_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.embedding_graph(stand_ins.table(spark, folder, "embeddings"), "vec_id", "embedding", K)


def attribute_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graph.normalise_rows(attribute_edges(spark, folder), stand_ins.buildings(spark, folder), "building_id")


@query("attribute_similarity", with_(BUILDINGS, *ATTRIBUTE_EDGES, "SELECT src, dst, round(weight, 6) AS weight FROM attribute_edges"))
def attribute_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(attribute_edges(spark, folder))


@query("attribute_graph_normalised", with_(BUILDINGS, *ATTRIBUTE_EDGES, ATTRIBUTE_GRAPH, "SELECT src, dst, round(weight, 6) AS weight FROM attribute_graph"))
def attribute_graph_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(attribute_graph(spark, folder))


@query("embedding_similarity", with_(*EMBEDDING_EDGES, "SELECT src, dst, round(weight, 6) AS weight FROM embedding_edges"))
def embedding_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(embedding_edges(spark, folder))


@query("fused_graph", with_(BUILDINGS, *ATTRIBUTE_EDGES, ATTRIBUTE_GRAPH, *EMBEDDING_EDGES, EMBEDDING_GRAPH, """
SELECT src, dst, round(0.3 * coalesce(l.weight, 0) + 0.7 * coalesce(s.weight, 0), 6) AS weight
FROM embedding_graph l FULL JOIN attribute_graph s USING (src, dst)"""))
def fused_graph(spark: SparkSession, folder: str) -> DataFrame:
    learned = graph.normalise_rows(
        embedding_edges(spark, folder), stand_ins.table(spark, folder, "embeddings"), "vec_id"
    )
    return rounded(graph.fuse_graphs(learned, attribute_graph(spark, folder), 0.3))


@query("edge_list", with_(*EMBEDDING_EDGES, EMBEDDING_GRAPH, """
ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM (SELECT DISTINCT vec_id FROM embeddings))""", """
SELECT s.place AS src_index, d.place AS dst_index, src AS src_id, dst AS dst_id, round(weight, 6) AS weight, src = dst AS is_self_loop
FROM embedding_graph JOIN ids s ON s.vec_id = src JOIN ids d ON d.vec_id = dst WHERE weight <> 0"""))
def edge_list(spark: SparkSession, folder: str) -> DataFrame:
    nodes = stand_ins.table(spark, folder, "embeddings")
    edges = graph.normalise_rows(embedding_edges(spark, folder), nodes, "vec_id")
    listed = rounded(graph.edge_list(edges, nodes, "vec_id"))
    return listed.withColumns({c: F.col(c).cast("bigint") for c in ("src_index", "dst_index")})


@query("neighbour_features", with_(BUILDINGS, READINGS, *ATTRIBUTE_EDGES, ATTRIBUTE_GRAPH, """
panel AS (SELECT building_id, timestamp, sum(meter_reading) AS meter_reading, count(*) AS meters FROM readings GROUP BY 1, 2)""", """
SELECT timestamp, src AS building_id, round(sum(weight * meter_reading), 5) AS meter_reading, round(sum(weight * meters), 5) AS meters
FROM attribute_graph JOIN panel ON building_id = dst GROUP BY 1, 2"""))
def neighbour_features(spark: SparkSession, folder: str) -> DataFrame:
    panel = (
        stand_ins.readings(spark, folder)
        .groupBy("building_id", "timestamp")
        .agg(F.sum("meter_reading").alias("meter_reading"), F.count("*").alias("meters"))
    )
    return rounded(graph.aggregate_neighbours(attribute_graph(spark, folder), panel, ["meter_reading", "meters"]), 5)
