"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors become whole numbers and are stored by columns, in blocks of about ROWS rows of one label, each with the smallest
and largest value of every dimension. An anchor reads the dimensions of a block in descending order of its own magnitudes.
After every few dimensions the least and most that the rest can add, from the block's extremes, bound each row's score;
rows whose bounds cannot reach what is asked for leave the candidate bitmap, and only the others are read on. Scores of
rows that stay to the last dimension are exact.

1. Positives: in the blocks of its own label an anchor asks for rows that can reach the fifth largest lower bound.
2. Negatives: in the other blocks it asks for rows that can lie in the window of one of its positives, and reach the tenth
   largest lower bound of the rows that lie there for sure.

Blocks are rows of a written table; anchors are written to the shared folder in shards and read one after the other by
every task, so no task holds more than its block, a shard, and the best rows of a shard's anchors. The best rows of all
blocks are merged by Spark. Nothing is approximate.

Defined cases: rows with a null id, label or vector, or a component that is null, not finite or beyond 2^18 in magnitude
(its scores might not fit a long) take no part; vectors of another length than the anchor's are no candidates; an empty
vector scores 0; rows that share a vec_id are rows of their own, an anchor's other rows are those of another vec_id, and
the least (label, vector) of an id speaks for it as an anchor; extra columns are ignored; an anchor without a positive, or a
window without a negative, has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelworks.llm import blobs, kernel
from panelworks.llm.catalogue import read, registered
from panelworks.llm.shards import map_array, write_array
from panelworks.scale import cut_lineage, scratch_path

SCALE, LARGEST = 256, 2.0**18
POSITIVES, NEGATIVES = 5, 10
# Shares of a positive's score, in percent, between which a negative's lies.
LEAST, MOST = 30, 90
# Rows of a block, anchors of a shard, dimensions between two looks at the bounds.
ROWS, SHARD, STEP = 4096, 2048, 8

_VECTORS = "vec_id long, label long, vector binary"


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, vectors as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = np.asarray(pc.list_value_length(lists), dtype=np.int64)
            values = np.asarray(pc.fill_null(pc.list_flatten(lists).cast(pa.float64()), float("nan")))
            ends = np.cumsum(size)
            fine = kernel.sums_within(~(np.abs(values) < LARGEST), np.concatenate([[0], ends])) == 0
            numbers = np.floor(SCALE * np.where(np.abs(values) < LARGEST, values, 0)).astype("<i4")
            vectors = [numbers[e - n : e].tobytes() for e, n in zip(ends, size, strict=True)]
            rows = kernel.record_batch(vec_id=batch.column("vec_id"), label=batch.column("label"), vector=pa.array(vectors, pa.binary()))
            yield rows.filter(pa.array(fine))

    known = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").dropna()
    return known.mapInArrow(run, _VECTORS)


class Block:
    """Rows of one label by columns, with the extremes of every dimension."""

    def __init__(self, label: int, ids: np.ndarray, columns: np.ndarray) -> None:
        self.label, self.ids, self.dims = label, ids, len(columns)
        # Doubles are exact where no sum of products can reach 2^53.
        self.largest = float(np.abs(columns, dtype=np.float64).max(initial=0))
        self.columns = columns
        self.exact = columns.astype(np.float64)
        self.low, self.high = columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)

    def scan(self, vector: np.ndarray, alive: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows that ``alive`` never rules out by its (least, most) possible scores, with their scores; how much was read."""
        vector = vector.astype(np.int64)
        order = np.argsort(-np.abs(vector), kind="stable")
        one, two = vector * self.low, vector * self.high
        rest = lambda part: np.concatenate([np.cumsum(part[order][::-1])[::-1], [0]])
        least, most = rest(np.minimum(one, two)), rest(np.maximum(one, two))
        doubles = float(np.abs(vector).sum()) * self.largest < 2.0**53
        weights, columns = (vector.astype(np.float64), self.exact) if doubles else (vector, self.columns)
        rows, score, cells = np.arange(len(self.ids)), np.zeros(len(self.ids), dtype=weights.dtype), 0
        for at in range(0, self.dims, STEP):
            dims = order[at : at + STEP]
            part = columns[dims] if len(rows) == len(self.ids) else columns[dims[:, None], rows]
            score = score + weights[dims] @ (part if doubles else part.astype(np.int64))
            cells += len(rows) * len(dims)
            seen = at + len(dims)
            keep = alive(score + least[seen], score + most[seen])
            if not keep.all():
                rows, score = rows[keep], score[keep]
                if not len(rows):
                    break
        return rows, score.astype(np.int64), cells


def _best(score: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:count]
    return score[order], ids[order]


def _kth(values: np.ndarray, k: int) -> int | None:
    """The k-th largest value, None if there are fewer."""
    return None if len(values) < k else np.partition(values, len(values) - k)[len(values) - k]


class Nearest:
    """Search of a block for the best rows of an anchor's own label."""

    def __init__(self, anchor: int, vector: np.ndarray, _scores: np.ndarray) -> None:
        self.anchor, self.vector = anchor, vector

    def alive(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        # So many rows score that much at least, besides the anchor itself.
        bar = _kth(least, POSITIVES + 1)
        return np.ones(len(most), dtype=bool) if bar is None else most >= bar

    def best(self, ids: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, int | None, int, int]]:
        other = ids != self.anchor
        for s, i in zip(*_best(score[other], ids[other], POSITIVES), strict=True):
            yield self.anchor, None, int(i), int(s)


class Windows:
    """Search of a block for the best rows in the windows below the scores of an anchor's positives."""

    def __init__(self, anchor: int, vector: np.ndarray, scores: np.ndarray) -> None:
        self.anchor, self.vector, self.scores = anchor, vector, scores
        self.ranges = [(-(-LEAST * int(p) // 100), MOST * int(p) // 100) for p in scores]

    def alive(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(least), dtype=bool)
        for low, high in self.ranges:
            inside = (most >= low) & (least <= high)
            bar = _kth(least[(least >= low) & (most <= high)], NEGATIVES)
            keep |= inside if bar is None else inside & (most >= bar)
        return keep

    def best(self, ids: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, int | None, int, int]]:
        for p, (low, high) in zip(self.scores, self.ranges, strict=True):
            fits = (score >= low) & (score <= high)
            for s, i in zip(*_best(score[fits], ids[fits], NEGATIVES), strict=True):
                yield self.anchor, int(p), int(i), int(s)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """(label, dims, payload): packed blocks of rows in order of label and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[int, bytes]]] = {}

        def packed(key: tuple[int, int]) -> pa.RecordBatch:
            rows = held.pop(key)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            columns = np.frombuffer(b"".join(r[1] for r in rows), "<i4").reshape(len(rows), key[1]).T
            payload = blobs.pack(ids, np.ascontiguousarray(columns).ravel())
            return kernel.record_batch(label=pa.array([key[0]], pa.int64()), dims=pa.array([key[1]], pa.int32()), payload=pa.array([payload], pa.binary()))

        for batch in batches:
            for vec_id, label, vector in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector")), strict=True):
                key = label, len(vector) // 4
                rows = held.setdefault(key, [])
                rows.append((vec_id, vector))
                if len(rows) >= ROWS:
                    yield packed(key)
        for key in list(held):
            yield packed(key)

    parts = max(1, -(-vectors.count() // ROWS))
    return vectors.repartitionByRange(parts, "label", "vec_id").mapInArrow(run, "label long, dims int, payload binary")


def _shards(anchors: DataFrame) -> list[tuple[str, int]]:
    """Write anchors (vec_id, label, vector, scores) to the shared folder; (path, dims) of each shard."""
    folder = scratch_path(anchors.sparkSession, "anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def written(dims: int) -> pa.RecordBatch:
            ids, labels, vectors, scores = zip(*held.pop(dims), strict=True)
            path = f"{folder}/{uuid.uuid4().hex}"
            flat = np.array([s for own in scores for s in own], dtype=np.int64)
            counts = np.array([len(s) for s in scores], dtype=np.int64)
            packed = blobs.pack(np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64), counts, flat, np.frombuffer(b"".join(vectors), "<i4"))
            write_array(path, np.frombuffer(packed, np.uint8))
            return kernel.record_batch(path=pa.array([path]), dims=pa.array([dims], pa.int32()))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "vector", "scores")), strict=True):
                dims = len(row[2]) // 4
                held.setdefault(dims, []).append(row)
                if len(held[dims]) >= SHARD:
                    yield written(dims)
        for dims in list(held):
            yield written(dims)

    parts = max(1, -(-anchors.count() // SHARD))
    listed = cut_lineage(anchors.repartitionByRange(parts, "label", "vec_id").mapInArrow(run, "path string, dims int"), "anchor-shards")
    return [(r["path"], r["dims"]) for r in listed.collect()]  # one per SHARD anchors


def _searched(blocks: DataFrame, shards: list[tuple[str, int]], kind: type, same: bool) -> DataFrame:
    """(anchor_id, positive_score, vec_id, score): the best rows of each task's blocks for every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, dims, payload in zip(*(batch.column(c).to_pylist() for c in ("label", "dims", "payload")), strict=True):
                ids, columns = blobs.unpack(payload)
                block = Block(label, ids, columns.reshape(dims, len(ids)))
                for path in (p for p, d in shards if d == dims):
                    names, labels, counts, scores, vectors = blobs.unpack(map_array(path, "u1").tobytes())
                    ends, out = np.cumsum(counts), []
                    vectors = vectors.reshape(len(names), dims)
                    for k in np.flatnonzero((labels == label) == same):
                        search = kind(int(names[k]), vectors[k], scores[ends[k] - counts[k] : ends[k]])
                        rows, score, _ = block.scan(vectors[k], search.alive)
                        out += search.best(ids[rows], score)
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["anchor_id", "positive_score", "vec_id", "score"])

    return blocks.mapInArrow(run, "anchor_id long, positive_score long, vec_id long, score long")


def mine(vectors: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of ``anchors`` among ``vectors``, both as ``whole_numbers`` gives them; anchors have distinct ids."""
    blocks = cut_lineage(blocks_of(vectors), "vector-blocks")
    none = F.array().cast("array<long>").alias("scores")
    near = _searched(blocks, _shards(anchors.select("*", none)), Nearest, True)
    by = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= POSITIVES)
    positives = cut_lineage(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    scores = positives.filter("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))
    hard = _searched(blocks, _shards(anchors.join(scores, "vec_id")), Windows, False)
    by = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= NEGATIVES)
    return positives.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def anchors_of(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The rows whose id is divisible by ``every``, one per id."""
    chosen = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return chosen.select("vec_id", "row.label", "row.vector")


SQL = """
with taken as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: coalesce(not isfinite(x), true))) = 0
), scored as (
    select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from taken a join taken b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
    select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id, row_number() over w::int as rank, n.vec_id as negative_id, positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same and 100 * n.score between 30 * positive_score and 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 10
"""


@registered("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    vectors = cut_lineage(whole_numbers(table.select("vec_id", label.alias("label"), "embedding")), "vectors")
    return mine(vectors, anchors_of(vectors))
