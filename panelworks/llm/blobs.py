"""Packed arrays as rows, so that many small records shuffle as few compressed ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from panelworks.llm import kernel

# Rows of every packed exchange: the part they meet in, what they hold, and the arrays.
SCHEMA = "part int, kind int, payload binary"
_ZSTD = pa.Codec.is_available("zstd")
FAST, DENSE = (pa.Codec("zstd", 1), pa.Codec("zstd", 7)) if _ZSTD else (pa.Codec("lz4"),) * 2


def pack(*arrays: np.ndarray, codec: pa.Codec = FAST) -> bytes:
    """Arrays of any types, compressed together; bytes of equal place stand together, as those of sorted numbers are alike."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    head = np.array([len(raw), len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], dtype="<i8")
    return head.tobytes() + codec.compress(raw, asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    size, n = (int(x) for x in np.frombuffer(payload, "<i8", 2))
    kinds = np.frombuffer(payload, "<i8", 2 * n, 16).reshape(n, 2)
    raw = np.frombuffer(FAST.decompress(payload[16 + 16 * n :], decompressed_size=size, asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for kind, length in kinds.tolist():
        dtype = np.dtype(chr(kind))
        part = raw[at : at + length * dtype.itemsize]
        out.append(part.reshape(dtype.itemsize, length).T.copy().view(dtype).ravel() if dtype.itemsize > 1 else part.view(dtype))
        at += length * dtype.itemsize
    return out


def joined(payloads: list[bytes]) -> list[np.ndarray]:
    """The arrays of several payloads, each put end to end."""
    return [np.concatenate(p) for p in zip(*map(unpack, payloads), strict=True)]


def of_kind(table: pa.Table, kind: int) -> list[np.ndarray] | None:
    kinds = np.asarray(table.column("kind"))
    payloads = [p for p, k in zip(table.column("payload").to_pylist(), kinds, strict=True) if k == kind]
    return joined(payloads) if payloads else None


def rows(items: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return kernel.record_batch(part=pa.array([r[0] for r in items], pa.int32()), kind=pa.array([r[1] for r in items], pa.int32()), payload=pa.array([r[2] for r in items], pa.binary()))


def groups(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each part with the indexes of its members."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    kinds, first = np.unique(part[order], return_index=True)
    return list(zip(kinds.tolist(), np.split(order, first[1:]), strict=True))


def split(part: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row per part."""
    return [(p, kind, pack(*(a[own] for a in arrays))) for p, own in groups(part)]


def bucket(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, by its leading bits."""
    return ((hashes >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int32)


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all members of the stretches."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
