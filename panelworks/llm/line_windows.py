"""Removal of repeated passages by overlapping windows of three consecutive lines.

Lines without a word are left alone and do not count as neighbours; the others are compared without the white space
around them. Every run of three such lines is a window. A window that occurs anywhere earlier (smaller doc_id, or
further up in the same text) is repeated; the lines of all repeated windows of a text are merged and removed. Windows
travel as two 64-bit hashes with their place, and hot windows are reduced to their first place before the shuffle.

Defined cases: a null text stays null and an empty one empty; a text of fewer than three lines with words is kept; rows
without a doc_id are kept as they are; rows that share a doc_id are seen as the same document; extra columns of any
name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import kernel
from panelworks.llm.catalogue import read, registered

WINDOW = 3
WHITE = " \t\n\x0b\x0c\r"
_WINDOWS = "w long, v long, doc_id long, place int, lines array<int>"
_GONE, COUNTS = "_lines_gone", ("n_lines", "n_removed")
_OWN_COUNTS = ("_n_lines", "_n_removed")


def _filled_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number within the row, and hash of each line that has a word."""
    starts, ends, _ = kernel.word_spans(data, offsets)
    feeds = np.flatnonzero(data == 10)
    bounds = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    line_ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    line_starts = np.empty_like(line_ends)
    line_starts[1:] = line_ends[:-1] + 1
    line_starts[bounds[:-1]] = offsets[:-1]
    first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    filled = np.flatnonzero(last > first)
    row = kernel.rows_of(bounds)
    number = np.arange(len(row)) - bounds[:-1][row]
    hashes = kernel.span_hashes(kernel.prefix_sums(data), starts[first[filled]], ends[last[filled] - 1])
    return row[filled], number[filled], hashes


def line_windows(documents: DataFrame) -> DataFrame:
    """One row per window: its hashes, its document and place there, and the numbers of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            row, number, lines = _filled_lines(*kernel.text_bytes(batch.column("text")))
            count = max(0, len(row) - WINDOW + 1)
            own = np.flatnonzero(row[:count] == row[len(row) - count :])
            place = own - np.searchsorted(row, row[own])
            other = kernel.mix(lines + np.uint64(0x5851F42D4C957F2D))
            members = np.stack([number[own + k] for k in range(WINDOW)], axis=1).astype(np.int32).ravel()
            yield kernel.record_batch(
                w=pa.array(kernel.chain(lines, WINDOW)[own].view(np.int64)),
                v=pa.array(kernel.chain(other, WINDOW)[own].view(np.int64)),
                doc_id=batch.column("doc_id").take(pa.array(row[own])),
                place=pa.array(place.astype(np.int32)),
                lines=pa.ListArray.from_arrays(pa.array(np.arange(0, WINDOW * len(own) + 1, WINDOW, dtype=np.int32)), pa.array(members)),
            )

    return documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _WINDOWS)


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, gone): numbers of the lines that repeated windows cover, one row per document that has any."""
    windows = line_windows(documents)
    first = (
        windows.groupBy("w", "v")
        .agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("w", "v", "first")
    )
    return (
        windows.join(first, ["w", "v"])
        .filter(F.struct("doc_id", "place") > F.col("first"))
        .select(F.col("doc_id").alias("_of"), F.explode("lines").alias("line"))
        .groupBy("_of")
        .agg(F.collect_set("line").alias(_GONE))
    )


def remove_repeated_lines(documents: DataFrame, counts: tuple[str, str] = COUNTS) -> DataFrame:
    """All columns of ``documents`` with the cleaned text, and how many lines with words it had and lost, as ``counts``."""
    names = documents.columns
    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), *(f"{c} long" for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            row, _, _ = _filled_lines(*kernel.text_bytes(batch.column("text")))
            removed = np.zeros(len(texts), dtype=np.int64)
            for k, gone in enumerate(batch.column(_GONE).to_pylist()):
                if gone:
                    out = set(gone)
                    texts[k] = "\n".join(line for i, line in enumerate(texts[k].split("\n")) if i not in out)
                    removed[k] = len(out)
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, batch.schema.field("text").type)}
            numbers = (np.bincount(row, minlength=len(texts)).astype(np.int64), removed)
            yield kernel.record_batch(**columns, **dict(zip(counts, map(pa.array, numbers), strict=True)))

    gone = repeated_lines(documents)
    joined = documents.join(gone, documents["doc_id"].cast("long") == gone["_of"], "left").select(*(documents[c] for c in names), _GONE)
    return joined.mapInArrow(run, schema)


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents with cleaned texts; those whose every line was a repetition go."""
    cleaned = remove_repeated_lines(documents, _OWN_COUNTS)
    return cleaned.filter("_n_removed = 0 or _n_removed < _n_lines").drop(*_OWN_COUNTS)


SQL = r"""
with lines as (
    select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents
), filled as (
    select doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line, row_number() over (partition by doc_id order by i) as k
    from lines where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''
), windows as (
    select doc_id, k, line as a, lead(line, 1) over w as b, lead(line, 2) over w as c, i as i1, lead(i, 1) over w as i2, lead(i, 2) over w as i3
    from filled window w as (partition by doc_id order by k)
), later as (
    select * from (select *, row_number() over (partition by a, b, c order by doc_id, k) as n from windows where c is not null) where n > 1
), gone as (
    select distinct doc_id, unnest([i1, i2, i3]) as i from later
), counts as (
    select doc_id, count(*) as n_lines from filled group by doc_id
), rest as (
    select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text, count(*) as kept
    from lines l anti join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id
), removed as (
    select doc_id, count(*) as n_removed from gone group by doc_id
)
select d.doc_id, coalesce(c.n_lines, 0) as n_lines, coalesce(g.n_removed, 0) as n_removed,
       case when d.text is not null then coalesce(r.text, '') end as text
from documents d left join counts c using (doc_id) left join removed g using (doc_id) left join rest r using (doc_id)
"""


@registered("op2_line_windows", SQL)
def op2_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_lines(read(spark, folder, "documents").select("doc_id", "text")).select("doc_id", *COUNTS, "text")
