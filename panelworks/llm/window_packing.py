"""Packing of token sequences with a bounded number of open windows.

Every task reads its documents once. Whole windows of a long document are emitted as they are; its rest goes to the open
window in which it leaves the least room. When no open window has room for it, the fullest one is topped up with the
head of the rest and emitted, so that an emitted window is always full. What is open at the end of a task is handed on:
the leftovers of several tasks meet in one group and are packed again in the same way, and only the last windows of a
group are cut at powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each for itself; extra columns are
ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import kernel
from panelworks.llm.catalogue import read, registered
from panelworks.llm.vocabulary import encoded_slices
from panelworks.scale import cut_lineage

LENGTH = 4096
OPEN_WINDOWS = 16
# Tasks whose leftovers meet; each leaves at most OPEN_WINDOWS windows.
FAN_IN = 32
END_ID = 2

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LEFT = "left_group long, left_task long, left_order long, left_ids binary"

# A piece in a window: (doc_id, start, doc_tokens, ids).
Piece = tuple[int | None, int, int, np.ndarray]


class Packer:
    """Open windows of one task; ``emit`` gets the pieces of each full window."""

    def __init__(self, emit: Callable[[list[Piece]], None], length: int = LENGTH, windows: int = OPEN_WINDOWS) -> None:
        self.emit, self.length, self.windows = emit, length, windows
        self.open: list[list[Piece]] = []
        self.filled: list[int] = []

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        while len(ids) >= self.length:
            self.emit([(doc_id, start, doc_tokens, ids[: self.length])])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [(self.filled[w], w) for w in range(len(self.open)) if self.filled[w] + len(ids) <= self.length]
            if not fits and len(self.open) < self.windows:
                self.open.append([])
                self.filled.append(0)
                continue
            _, window = max(fits) if fits else max((n, w) for w, n in enumerate(self.filled))
            head = ids[: self.length - self.filled[window]]
            self.open[window].append((doc_id, start, doc_tokens, head))
            self.filled[window] += len(head)
            start, ids = start + len(head), ids[len(head) :]
            if self.filled[window] == self.length:
                self.emit(self.open.pop(window))
                self.filled.pop(window)

    def leftovers(self) -> list[Piece]:
        """The pieces of the open windows, the fullest window first."""
        order = sorted(range(len(self.open)), key=lambda w: -self.filled[w])
        return [piece for w in order for piece in self.open[w]]


def _rows(windows: list[tuple[int, list[Piece]]]) -> dict[str, list]:
    out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
    for sequence, pieces in windows:
        offset = 0
        for doc_id, start, total, ids in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
            for column, value in zip(out.values(), (doc_id, start, len(ids), crc, total, sequence, offset), strict=True):
                column.append(value)
            offset += len(ids)
    return out


def _first_pass(documents: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    kinds = pa.schema([*((c, pa.int64()) for c in _rows([])), ("left_group", pa.int64()), ("left_task", pa.int64()), ("left_order", pa.int64()), ("left_ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        full: list[tuple[int, list[Piece]]] = []
        made = 0

        def emit(pieces: list[Piece]) -> None:
            nonlocal made
            full.append(((task << 36) + made, pieces))
            made += 1

        def batch_of(rows: dict[str, list], **left) -> pa.RecordBatch:
            n = len(rows["doc_id"])
            return pa.RecordBatch.from_arrays([pa.array((rows | left).get(f.name, [None] * n), f.type) for f in kinds], schema=kinds)

        packer = Packer(emit)
        for batch, flat, offsets in encoded_slices(batches, vocabulary_path, False, end_id):
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                packer.add(doc_id, 0, int(b - a), flat[a:b])
            packer.open = [[(d, s, t, ids.copy()) for d, s, t, ids in w] for w in packer.open]  # lets the slice go
            yield batch_of(_rows(full))
            full.clear()
        rest = packer.leftovers()
        rows = {"doc_id": [p[0] for p in rest], "start": [p[1] for p in rest], "doc_tokens": [p[2] for p in rest], "length": [len(p[3]) for p in rest]}
        yield batch_of(rows, left_group=[task // FAN_IN] * len(rest), left_task=[task] * len(rest), left_order=list(range(len(rest))), left_ids=[p[3].tobytes() for p in rest])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"{PIECES}, {LEFT}")


def _merge(table: pa.Table) -> pa.Table:
    """Pack the leftovers of one group of tasks; the last windows are cut at powers of two."""
    table = table.sort_by([("left_task", "ascending"), ("left_order", "ascending")])
    group = table.column("left_group")[0].as_py()
    windows: list[tuple[int, list[Piece]]] = []

    def emit(pieces: list[Piece]) -> None:
        windows.append(((1 << 62) + (group << 24) + len(windows), pieces))

    packer = Packer(emit, windows=1)
    for row in table.select(["doc_id", "start", "doc_tokens", "left_ids"]).to_pylist():
        packer.add(row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["left_ids"], dtype=np.uint32))
    rest = packer.leftovers()
    size = LENGTH // 2
    while rest:
        if sum(len(p[3]) for p in rest) < size:
            size //= 2
            continue
        taken: list[Piece] = []
        room = size
        while room:
            doc_id, start, total, ids = rest[0]
            taken.append((doc_id, start, total, ids[:room]))
            rest[:1] = [(doc_id, start + room, total, ids[room:])] if len(ids) > room else []
            room -= min(room, len(ids))
        emit(taken)
    return pa.table({k: pa.array(v, pa.int64()) for k, v in _rows(windows).items()})


def pack(documents: DataFrame, vocabulary_path: str, end_id: int = END_ID) -> DataFrame:
    """One row per piece; see PIECES."""
    first = cut_lineage(_first_pass(documents, vocabulary_path, end_id), "packing")
    columns = [c.split()[0] for c in PIECES.split(", ")]
    merged = first.filter("left_ids is not null").groupBy("left_group").applyInArrow(_merge, PIECES)
    return first.filter("left_ids is null").select(*columns).unionByName(merged)


@registered("op8_window_packing")
def op8_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
