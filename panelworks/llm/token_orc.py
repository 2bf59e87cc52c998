"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id and sorted, so that files, stripes and row groups hold narrow id ranges: stripes
are read in parallel, and a look-up of documents skips stripes and row groups by their statistics and Bloom filters.
The ids of all documents before a document follow from one sum per file part, which is short, and the running sum that
the file keeps inside the part.

Defined cases: a null or empty text has the end id only; a null doc_id sorts first; repeated rows are kept, in any order
among themselves; extra columns are ignored; an empty table gives a folder without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelworks.llm import kernel
from panelworks.llm.catalogue import read, registered
from panelworks.llm.vocabulary import encoded_slices
from panelworks.scale import batch_bytes, scratch_path

END_ID = 2
# Bytes of texts that a worker gets at once.
BATCH_BYTES = 4 << 20
ORC_OPTIONS = {
    "orc.compress": "LZ4",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
FILE_SCHEMA = "doc_id long, part int, part_start long, ids array<int>"


def write_tokens(documents: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID) -> None:
    """Encode every whole text and write (doc_id, part, part_start, ids) in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch, flat, offsets in encoded_slices(batches, vocabulary_path, True, end_id):
            rows = batch.num_rows
            yield kernel.record_batch(
                doc_id=batch.column("doc_id"),
                part=pa.array(np.full(rows, part, dtype=np.int32)),
                part_start=pa.array(seen + offsets[:-1]),
                ids=pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))),
            )
            seen += int(offsets[-1])

    with batch_bytes(documents.sparkSession, BATCH_BYTES):
        (
            documents.select(F.col("doc_id").cast("long"), "text")
            .repartitionByRange("doc_id")
            .sortWithinPartitions("doc_id")
            .mapInArrow(run, FILE_SCHEMA)
            .write.format("orc")
            .options(**ORC_OPTIONS)
            .save(path)
        )


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of the files; with ``doc_ids`` the predicate reaches the stripes' statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, before): how many ids the parts before hold; one row per file part."""
    sizes = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.size("ids")).alias("n"))
    ordered = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("before"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids_crc32) of every row of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = np.asarray(ids.offsets)
            data = memoryview(np.ascontiguousarray(np.asarray(ids.values), dtype="<u4")).cast("B")
            yield kernel.record_batch(
                doc_id=batch.column("doc_id"),
                part=batch.column("part"),
                part_start=batch.column("part_start"),
                n_tokens=pa.array(np.diff(at).astype(np.int64)),
                ids_crc32=pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
            )

    return tokens.mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")


@registered("op4_token_orc")
def op4_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(read(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    tokens = read_tokens(spark, path)
    # One row per part: as many as the shuffle has partitions.
    starts = F.broadcast(part_starts(tokens))
    return digests(tokens).join(starts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
