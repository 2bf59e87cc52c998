"""Interpolated modified Kneser-Ney language model over words, counted in Spark and scored from memory-mapped arrays.

Counting: every task sums the pairs (previous token, token) of its texts and sends them, packed and sorted, to the bucket
of the previous token, where all that follows one context meets; contexts that hold over a thousandth of all tokens are
spread over all buckets by the token that follows. A bucket writes its pairs as a sorted array of 64-bit hashes with
their counts. Context totals and the numbers of distinct predecessors of each token, both already summed in the bucket,
meet once more per token and are written the same way.

Scoring: a task sorts the pairs of a block of texts by bucket and hash and looks them up in the mapped arrays front to
back, so that each block reads an array once and holds only its own tokens in memory.

The order is two or three. With three, tasks sum triples and send them to the bucket of the middle token, where its pairs
meet with all that precede them and its contexts of two tokens with all that follow. Only contexts that end in a spread
token meet once more. Pairs then count their distinct predecessors. A text begins with two begin tokens.

Defined cases: a null or empty text is its end token alone; repeated rows count each for itself; rows with a null doc_id
are learned from; extra columns are ignored; with no training rows every token has the probability of an unknown one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import kernel, shards
from panelworks.llm.catalogue import read, registered
from panelworks.llm.hyper_language import remainder_is
from panelworks.scale import cut_lineage, scratch_path

END = np.uint64(0xE11D00000000001F)
BEGIN = np.uint64(0xBE61000000000011)
# Tokens of context, and one, that the query's model sees.
ORDER = 3
# Tokens that a task counts, or looks up, at once.
BLOCK_TOKENS = 2_000_000
# A context with a larger share of all tokens is spread over the buckets; at most 1 / share of them exist.
HOT_SHARE = 1e-3
_CUT = np.uint64(16)
_PACKED = "bucket int, payload binary"
_SUMS = "bucket int, kind int, payload binary, n1 long, n2 long, n3 long, n4 long"


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of the tokens before them, and the offset of each text plus the end."""
    data, offsets = kernel.text_bytes(batch.column("text"))
    starts, ends, bounds = kernel.word_spans(data, offsets)
    words = kernel.word_hashes(data, starts, ends)
    n = len(bounds) - 1
    at = bounds + np.arange(n + 1)
    token = np.empty(len(words) + n, dtype=np.uint64)
    last = np.zeros(len(token), dtype=bool)
    last[at[1:] - 1] = True
    token[last], token[~last] = END, words
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[at[:-1]] = BEGIN
    return token, before, at


def _earlier(before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before the one before, of which 48 bits are kept."""
    earlier = np.empty_like(before)
    earlier[1:] = before[:-1]
    earlier[at[:-1]] = BEGIN
    return earlier >> _CUT << _CUT


def _context(earlier: np.ndarray, before: np.ndarray) -> np.ndarray:
    return kernel.mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + (earlier >> _CUT))


def _of_hash(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _bucket(before: np.ndarray, token: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    own = (before >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)
    spread = ((token >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    return np.where(kernel.found_in(hot, before), spread, own).astype(np.int64)


def _pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return kernel.mix(before * np.uint64(0x9E3779B97F4A7C15) + (token >> _CUT))


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, an index of each, and the sums of the values over it."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    return ordered[head], order[head], [np.add.reduceat(v[order], head) if len(head) else v[:0] for v in values]


def _wide(count: np.ndarray) -> bytes:
    """Counts in a byte each, followed by the large ones."""
    return np.minimum(count, 255).astype(np.uint8).tobytes() + count[count >= 255].astype("<u8").tobytes()


def _read_wide(payload: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """Counts that `_wide` wrote at this place, and where they end."""
    count = np.frombuffer(payload, np.uint8, n, at).astype(np.int64)
    large = count == 255
    count[large] = np.frombuffer(payload, "<u8", int(large.sum()), at + n)
    return count, at + n + 8 * int(large.sum())


def _six(values: np.ndarray) -> bytes:
    return (values >> _CUT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _read_six(payload: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(payload, np.uint8, 6 * n, at).reshape(n, 6)
    return wide.view("<u8").ravel() << _CUT, at + 6 * n


def _pack_triples(earlier: np.ndarray, before: np.ndarray, token: np.ndarray, count: np.ndarray) -> bytes:
    """Triples sorted by middle and first token: each middle once, each context once, 48 bits of first and last tokens."""
    new = np.concatenate([[True], before[1:] != before[:-1]])
    pair = np.flatnonzero(new | np.concatenate([[True], earlier[1:] != earlier[:-1]]))
    head = np.flatnonzero(new)
    sizes = np.array([len(head), len(pair), len(token)], "<u8").tobytes()
    runs = [_wide(np.diff(np.append(first, len(token)))) for first in (head, pair)]
    return b"".join([sizes, before[head].tobytes(), runs[0], _six(earlier[pair]), runs[1], _six(token), _wide(count)])


def _unpack_triples(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    heads, pairs, n = (int(x) for x in np.frombuffer(payload, "<u8", 3))
    before = np.frombuffer(payload, "<u8", heads, 24)
    head_runs, at = _read_wide(payload, heads, 24 + 8 * heads)
    earlier, at = _read_six(payload, pairs, at)
    pair_runs, at = _read_wide(payload, pairs, at)
    token, at = _read_six(payload, n, at)
    return np.repeat(earlier, pair_runs), np.repeat(before, head_runs), token, _read_wide(payload, n, at)[0]


def _pack(before: np.ndarray, token: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs sorted by context: contexts once, with the number of pairs of each; 48 bits of a token."""
    head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    runs = np.diff(np.append(head, len(before)))
    cut = (token >> _CUT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return b"".join([np.array([len(head), len(token)], "<u8").tobytes(), before[head].tobytes(), runs.astype("<u4").tobytes(), cut.tobytes(), _wide(count)])


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, n = (int(x) for x in np.frombuffer(payload, "<u8", 2))
    at = 16
    before = np.frombuffer(payload, "<u8", heads, at)
    runs = np.frombuffer(payload, "<u4", heads, at := at + 8 * heads)
    cut = np.zeros((n, 8), dtype=np.uint8)
    cut[:, :6] = np.frombuffer(payload, np.uint8, 6 * n, at := at + 4 * heads).reshape(n, 6)
    count = np.frombuffer(payload, np.uint8, n, at := at + 6 * n).astype(np.int64)
    count[count == 255] = np.frombuffer(payload, "<u8", -1, at + n)
    return np.repeat(before, runs), cut.view("<u8").ravel() << _CUT, count


def hot_contexts(texts: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes of the tokens with more than ``share`` of all tokens: at most 1 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text", 4 * kernel.SLICE_BYTES):
            token, before, _ = _tokens(batch)
            key, _, (count,) = _sum_by(before, np.ones(len(before), dtype=np.int64))
            # A token with more than the share over all has it in one slice at least; its slices below half are not missed.
            often = count >= max(1.0, 0.5 * share * len(before))
            total = kernel.record_batch(token=pa.array([0], pa.int64()), n=pa.array([len(token)], pa.int64()), whole=pa.array([True]))
            yield total
            yield kernel.record_batch(token=pa.array(key[often].view(np.int64)), n=pa.array(count[often]), whole=pa.array([False] * int(often.sum()), pa.bool_()))

    sums = texts.mapInArrow(run, "token long, n long, whole boolean").groupBy("whole", "token").agg(F.sum("n").alias("n"))
    sums = cut_lineage(sums, "kn-hot")
    total = sums.filter("whole").agg(F.sum("n")).first()[0] or 0
    rows = sums.filter(~F.col("whole") & (F.col("n") > F.lit(share / 2 * total))).select("token").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))


def gram_counts(texts: DataFrame, hot: np.ndarray, buckets: int, order: int) -> DataFrame:
    """(bucket, payload): packed counts of the tasks, of pairs or triples."""

    def flush_triples(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        token, before, earlier = (np.concatenate(p) for p in zip(*parts, strict=True))
        _, index, (count,) = _sum_by(_pair_key(_context(earlier, before), token), np.ones(len(token), dtype=np.int64))
        token, before, earlier = token[index], before[index], earlier[index]
        bucket = _bucket(before, token, hot, buckets)
        by = np.lexsort((earlier, before, bucket))
        token, before, earlier, count, bucket = token[by], before[by], earlier[by], count[by], bucket[by]
        kinds, first = np.unique(bucket, return_index=True)
        for b, i, j in zip(kinds, first, np.append(first[1:], len(bucket)), strict=True):
            payload = _pack_triples(earlier[i:j], before[i:j], token[i:j], count[i:j])
            yield kernel.record_batch(bucket=pa.array([b], pa.int32()), payload=pa.array([payload], pa.binary()))

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        token, before = (np.concatenate(p) for p in zip(*parts, strict=True))
        _, index, (count,) = _sum_by(_pair_key(before, token), np.ones(len(token), dtype=np.int64))
        token, before = token[index], before[index]
        bucket = _bucket(before, token, hot, buckets)
        order = np.lexsort((before, bucket))
        token, before, count, bucket = token[order], before[order], count[order], bucket[order]
        kinds, first = np.unique(bucket, return_index=True)
        edges = np.append(first, len(bucket))
        for b, i, j in zip(kinds, edges[:-1], edges[1:], strict=True):
            yield kernel.record_batch(bucket=pa.array([b], pa.int32()), payload=pa.array([_pack(before[i:j], token[i:j], count[i:j])], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in kernel.slices(batches, "text"):
            token, before, at = _tokens(batch)
            parts.append((token, before, _earlier(before, at)) if order == 3 else (token, before))
            held += len(token)
            if held >= BLOCK_TOKENS:
                yield from (flush_triples if order == 3 else flush)(parts)
                parts, held = [], 0
        if held:
            yield from (flush_triples if order == 3 else flush)(parts)

    return texts.mapInArrow(run, _PACKED)


def _of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _pair_bucket(folder: str, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        before, token, count = (np.concatenate(p) for p in zip(*map(_unpack, table.column("payload").to_pylist()), strict=True))
        key, index, (count,) = _sum_by(_pair_key(before, token), count)
        before, token = before[index], token[index]
        shards.write_array(f"{folder}/pairs-{bucket}", key)
        shards.write_array(f"{folder}/counts-{bucket}", np.frombuffer(_wide(count), np.uint8))
        kinds = [(count == 1), (count == 2), (count >= 3)]
        context, _, sums = _sum_by(before, count, *(k.astype(np.int64) for k in kinds))
        ended = int(count[token == END >> _CUT << _CUT].sum())
        if ended:
            context, sums = np.append(context, END), [np.append(s, ended if k == 0 else 0) for k, s in enumerate(sums)]
        follower, _, (distinct,) = _sum_by(token, np.ones(len(token), dtype=np.int64))
        return _sums_table(((0, context, sums), (1, follower, [distinct])), ((2, count),), buckets)

    return run


def _sums_table(sums, counted, buckets: int) -> pa.Table:
    """Rows of (kind, keys, values) for the buckets of the keys, and of (kind, counts) with how often each count occurs."""
    rows = [(-1, kind, b"", *_of_counts(count)) for kind, count in counted]
    for kind, keys, values in sums:
        if not len(keys):
            continue
        target = _of_hash(keys, buckets)
        order = np.argsort(target, kind="stable")
        kinds, first = np.unique(target[order], return_index=True)
        for t, part in zip(kinds, np.split(order, first[1:]), strict=True):
            rows.append((int(t), kind, np.array([len(part)], "<u8").tobytes() + keys[part].tobytes() + b"".join(_wide(v[part]) for v in values), 0, 0, 0, 0))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])


def _levels(count: np.ndarray) -> list[np.ndarray]:
    return [k.astype(np.int64) for k in (count == 1, count == 2, count >= 3)]


def _triple_bucket(folder: str, hot: np.ndarray, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        earlier, before, token, count = (np.concatenate(p) for p in zip(*map(_unpack_triples, table.column("payload").to_pylist()), strict=True))
        context = _context(earlier, before)
        del earlier
        key, index, (count,) = _sum_by(_pair_key(context, token), count)
        context, before, token = context[index], before[index], token[index]
        shards.write_array(f"{folder}/triples-{bucket}", key)
        shards.write_array(f"{folder}/triple-counts-{bucket}", np.frombuffer(_wide(count), np.uint8))
        ended = int(count[token == END >> _CUT << _CUT].sum())
        contexts, first, sums = _sum_by(context, count, *_levels(count))
        spread = kernel.found_in(hot, before[first])
        _write_contexts(folder, f"contexts-{bucket}", contexts[~spread], [v[~spread] for v in sums])
        pair, first, (preceded,) = _sum_by(_pair_key(before, token), np.ones(len(token), dtype=np.int64))
        shards.write_array(f"{folder}/pairs-{bucket}", pair)
        shards.write_array(f"{folder}/counts-{bucket}", np.frombuffer(_wide(preceded), np.uint8))
        _, _, (total,) = _sum_by(before, count)
        single, _, of_single = _sum_by(before[first], *_levels(preceded), preceded)
        of_single = [total, *of_single]
        if ended:
            single, of_single = np.append(single, END), [np.append(v, ended if k == 0 else 0) for k, v in enumerate(of_single)]
        follower, _, (distinct,) = _sum_by(token[first], np.ones(len(first), dtype=np.int64))
        return _sums_table(((0, single, of_single), (1, follower, [distinct]), (3, contexts[spread], [v[spread] for v in sums])), ((2, preceded), (4, count)), buckets)

    return run


def _write_contexts(folder: str, name: str, keys: np.ndarray, sums: list[np.ndarray]) -> None:
    shards.write_array(f"{folder}/{name}", keys)
    for column, value in zip(CONTEXT_COLUMNS, sums, strict=True):
        shards.write_array(f"{folder}/{column}-{name}", np.frombuffer(_wide(value), np.uint8))


def _read_sums(payload: bytes, width: int) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, "<u8", 1)[0])
    out, at = [np.frombuffer(payload, "<u8", n, 8)], 8 + 8 * n
    for _ in range(width):
        value, at = _read_wide(payload, n, at)
        out.append(value)
    return out


_TOTALS = "vocabulary long, tokens long, predecessors long, n1 long, n2 long, n3 long, n4 long"
# How often a context occurs, and how many tokens follow it once, twice and more often.
CONTEXT_COLUMNS = ("total", "once", "twice", "more")
# The same of a token; with order three its pairs count by their predecessors, "continued" in all.
TOKEN_COLUMNS = {2: (*CONTEXT_COLUMNS, "predecessors"), 3: (*CONTEXT_COLUMNS, "continued", "predecessors")}


def _token_bucket(folder: str, order: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        kinds = np.asarray(table.column("kind"))
        payloads = table.column("payload").to_pylist()
        spread = [_read_sums(p, 4) for p, k in zip(payloads, kinds, strict=True) if k == 3]
        if spread:
            keys, _, values = _sum_by(*(np.concatenate(c) for c in zip(*spread, strict=True)))
            _write_contexts(folder, f"spread-{bucket}", keys, values)
        width = len(TOKEN_COLUMNS[order]) - 1
        contexts = [_read_sums(p, width) for p, k in zip(payloads, kinds, strict=True) if k == 0]
        followers = [_read_sums(p, 1) for p, k in zip(payloads, kinds, strict=True) if k == 1]
        empty = np.zeros(0, np.int64)
        token, _, sums = _sum_by(*(np.concatenate(c) for c in zip(*contexts, strict=True))) if contexts else (np.zeros(0, np.uint64), None, [empty] * width)
        cut, _, (distinct,) = _sum_by(*(np.concatenate(c) for c in zip(*followers, strict=True))) if followers else (np.zeros(0, np.uint64), None, [empty])
        predecessors = np.zeros(len(token), dtype=np.int64)
        here = kernel.found_in(cut, token >> _CUT << _CUT) & (token != BEGIN)
        predecessors[here] = distinct[np.searchsorted(cut, token[here] >> _CUT << _CUT)]
        shards.write_array(f"{folder}/tokens-{bucket}", token)
        for name, value in zip(TOKEN_COLUMNS[order], [*sums, predecessors], strict=True):
            shards.write_array(f"{folder}/{name}-{bucket}", value)
        real = token != BEGIN
        row = [int(real.sum()), int(sums[0][real].sum()), int(predecessors.sum()), *_of_counts(predecessors[real])]
        return pa.table({c.split()[0]: pa.array([v], pa.int64()) for c, v in zip(_TOTALS.split(", "), row, strict=True)})

    return run


def _discounts(n: list[int]) -> np.ndarray:
    """Discount of counts 0, 1, 2 and 3 or more; where counts are too few to tell, half a count."""
    if min(n) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0, *(min(max(x, 0.0), k) for k, x in enumerate(d, 1))])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that all scores share."""

    folder: str
    buckets: int
    hot: np.ndarray
    vocabulary: int
    tokens: int
    predecessors: int
    pair_discounts: np.ndarray
    token_discounts: np.ndarray
    single_counts: tuple[int, int, int]
    order: int
    triple_discounts: np.ndarray


def train(texts: DataFrame, order: int = 2) -> Model:
    """Count (text) rows; the arrays are written to the shared folder."""
    if order not in TOKEN_COLUMNS:
        raise ValueError(f"the order is 2 or 3, not {order}")
    spark = texts.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_path(spark, "kneser-ney")
    hot = hot_contexts(texts)
    write = _triple_bucket(folder, hot, buckets) if order == 3 else _pair_bucket(folder, buckets)
    sums = cut_lineage(gram_counts(texts, hot, buckets, order).groupBy("bucket").applyInArrow(write, _SUMS), "kn-sums")
    totals = sums.filter("bucket >= 0").groupBy("bucket").applyInArrow(_token_bucket(folder, order), _TOTALS)
    count = lambda df, names: [int(x or 0) for x in df.agg(*(F.sum(c) for c in names)).first()]
    levels = ["n1", "n2", "n3", "n4"]
    pair_levels, triple_levels = (count(sums.filter(f"kind = {k}"), levels) for k in (2, 4))
    vocabulary, tokens, predecessors, *token_levels = count(totals, ["vocabulary", "tokens", "predecessors", *levels])
    single = (token_levels[0], token_levels[1], max(0, vocabulary - token_levels[0] - token_levels[1]))
    return Model(folder, buckets, hot, vocabulary, tokens, predecessors, _discounts(pair_levels), _discounts(token_levels), single, order, _discounts(triple_levels))


class _Reader:
    """Look-ups of sorted keys, bucket by bucket."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def _mapped(self, name: str, bucket: int, dtype: str) -> np.ndarray:
        try:
            return shards.map_array(f"{self.model.folder}/{name}-{bucket}", dtype)
        except FileNotFoundError:  # no training token fell into this bucket
            return np.zeros(0, dtype=dtype)

    def _by_bucket(self, bucket: np.ndarray, key: np.ndarray, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, positions of the keys found, their places in the array)."""
        if not len(key):
            return
        order = np.lexsort((key, bucket))
        kinds, first = np.unique(bucket[order], return_index=True)
        for b, part in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
            keys = self._mapped(name, b, "<u8")
            if len(keys):
                at = np.searchsorted(keys, key[part])
                at[at == len(keys)] = 0
                hit = keys[at] == key[part]
                yield b, part[hit], at[hit]

    def _counts(self, name: str, bucket: int, size: int, at: np.ndarray) -> np.ndarray:
        packed = self._mapped(name, bucket, "u1")
        count = packed[at].astype(np.int64)
        if (count == 255).any():
            small = np.asarray(packed[:size])
            large = np.frombuffer(packed[size:].tobytes(), "<u8")
            count[count == 255] = large[np.searchsorted(np.flatnonzero(small == 255), at[count == 255])]
        return count

    def _find(self, bucket: np.ndarray, key: np.ndarray, name: str, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
        out = {column: np.zeros(len(key), dtype=np.int64) for column in columns}
        for b, part, at in self._by_bucket(bucket, key, name):
            size = len(self._mapped(name, b, "<u8"))
            for column in columns:
                out[column][part] = self._counts(column, b, size, at)
        return out

    def pairs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        return self._find(_bucket(before, token, self.model.hot, self.model.buckets), _pair_key(before, token), "pairs", ("counts",))["counts"]

    def triples(self, context: np.ndarray, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        return self._find(_bucket(before, token, self.model.hot, self.model.buckets), _pair_key(context, token), "triples", ("triple-counts",))["triple-counts"]

    def contexts(self, context: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
        spread = kernel.found_in(self.model.hot, before)
        out = {column: np.zeros(len(context), dtype=np.int64) for column in CONTEXT_COLUMNS}
        for name, here, bucket in (("spread", spread, _of_hash(context, self.model.buckets)), ("contexts", ~spread, _of_hash(before, self.model.buckets))):
            found = self._find(bucket[here], context[here], name, tuple(f"{column}-{name}" for column in CONTEXT_COLUMNS))
            for column in CONTEXT_COLUMNS:
                out[column][here] = found[f"{column}-{name}"]
        return out

    def tokens(self, token: np.ndarray) -> dict[str, np.ndarray]:
        columns = TOKEN_COLUMNS[self.model.order]
        out = {name: np.zeros(len(token), dtype=np.int64) for name in columns}
        bucket = _of_hash(token, self.model.buckets)
        for b, part, at in self._by_bucket(bucket, token, "tokens"):
            for name in columns:
                out[name][part] = self._mapped(name, b, "<i8")[at]
        return out


def _interpolated(count: np.ndarray, total: np.ndarray, once: np.ndarray, twice: np.ndarray, more: np.ndarray, discounts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of a token after a context, from its count there and the lower order; that alone after unknown contexts."""
    seen = np.maximum(total, 1.0)
    gamma = discounts[1] * once + discounts[2] * twice + discounts[3] * more
    return np.where(total > 0, np.maximum(count - discounts[np.minimum(count, 3)], 0) / seen + gamma / seen * lower, lower)


def _log_probabilities(model: Model, reader: _Reader, token: np.ndarray, before: np.ndarray, earlier: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: count in training, base and model log10 probability."""
    kinds, which = np.unique(np.concatenate([token, before]), return_inverse=True)
    known = reader.tokens(kinds)
    of_token, of_before = which[: len(token)], which[len(token) :]
    d1 = model.token_discounts
    mass = sum(d1[k] * n for k, n in enumerate(model.single_counts, 1))
    total = max(model.predecessors, 1)
    single = np.maximum(known["predecessors"] - d1[np.minimum(known["predecessors"], 3)], 0) / total
    left = mass / total if model.predecessors else 1.0
    lower = (single + left / (model.vocabulary + 1))[of_token]
    context = known["continued" if model.order == 3 else "total"][of_before].astype(np.float64)
    context[before == END] = 0
    _, index, inverse = np.unique(_pair_key(before, token), return_index=True, return_inverse=True)
    pair = reader.pairs(before[index], token[index])[inverse]
    upper = _interpolated(pair, context, *(known[c][of_before] for c in CONTEXT_COLUMNS[1:]), model.pair_discounts, lower)
    if model.order == 3:
        context = _context(earlier, before)
        _, index, inverse = np.unique(context, return_index=True, return_inverse=True)
        follows = {c: v[inverse] for c, v in reader.contexts(context[index], before[index]).items()}
        _, index, inverse = np.unique(_pair_key(context, token), return_index=True, return_inverse=True)
        triple = reader.triples(context[index], before[index], token[index])[inverse]
        upper = _interpolated(triple, *(follows[c] for c in CONTEXT_COLUMNS), model.triple_discounts, upper)
    count = known["total"][of_token]
    base = np.log10((count + 1) / (model.tokens + (model.vocabulary + 1)))
    return count, base, np.log10(upper)


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    kinds = dict(documents.dtypes)

    def finish(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(model)
        token, before = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        earlier = np.concatenate([_earlier(h[2], h[3]) for h in held]) if model.order == 3 else None
        count, base, best = _log_probabilities(model, reader, token, before, earlier)
        first = 0
        for batch, tokens, _, at in held:
            here = slice(first, first + len(tokens))
            row = kernel.rows_of(at)
            sums = [np.bincount(row, v[here], minlength=batch.num_rows) for v in (count > 0, base, best)]
            first += len(tokens)
            yield kernel.record_batch(
                **{c: batch.column(c) for c in keep},
                n_tokens=pa.array(np.diff(at)),
                n_known=pa.array(sums[0].astype(np.int64)),
                train_tokens=pa.array(np.full(batch.num_rows, model.tokens, dtype=np.int64)),
                base_score=pa.array(sums[1]),
                score=pa.array(sums[2]),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in kernel.slices(batches, "text"):
            token, before, at = _tokens(batch)
            held.append((batch, token, before, at))
            size += len(token)
            if size >= BLOCK_TOKENS // (model.order - 1):
                yield from finish(held)
                held, size = [], 0
        if held:
            yield from finish(held)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return documents.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


@registered("op6_kneser_ney")
def op6_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    model = train(documents.filter(~remainder_is(7, 2)).select("text"), ORDER)
    found = score(documents, model)
    return found.select("doc_id", remainder_is(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
