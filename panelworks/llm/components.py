"""Connected components of a table of links, by alternating stars; tables of a checked size are finished by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelworks.scale import cut_lineage

# Links that one task finishes: 16 bytes each, and about ten times that while it works.
ONE_TASK = 1_000_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links with the smallest node that it reaches: labels sink along links, and pointers are doubled."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label
        label = label[label]
        x, y = label[one], label[two]
        label = label.copy()
        np.minimum.at(label, x, y)
        np.minimum.at(label, y, x)
        np.minimum.at(label, one, y)
        np.minimum.at(label, two, x)
        if (label == before).all() and (x == y).all():
            return nodes, nodes[label]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step: each node hands its (larger or smaller) neighbours its smallest one. Minima are summed before the shuffle,
    and a node with very many links is split by adaptive execution when it is joined with its minimum."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    told = both.join(least, "a")
    if large:
        moved = told.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _contracted(links: DataFrame, names: tuple[str, str] = ("a", "b"), roots: bool = False) -> DataFrame:
    """The links of each partition as stars around the smallest node that they reach there, ONE_TASK links at a time."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        node, least = least_reached(*(np.concatenate([np.asarray(h.column(c)) for h in held]) for c in "ab"))
        keep = slice(None) if roots else node != least
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if not roots and sum(h.num_rows for h in held) >= ONE_TASK:
                yield star(held)
                held = []
        if held:
            yield star(held)

    return links.mapInArrow(run, f"{names[0]} long, {names[1]} long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), nulls and loops aside; the component is its smallest node."""
    state = lambda: links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = cut_lineage(_contracted(links.filter("a <> b").select("a", "b")), "components")
    before = None
    while True:
        now = state()
        if now[0] <= ONE_TASK:
            return _contracted(links.coalesce(1), ("node", "component"), True)
        if now == before:
            break
        before = now
        links = cut_lineage(_contracted(_star(_star(links, True), False)), "components")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
