"""Exact Jaccard join on word shingles with signature trees.

1. Documents with the same shingle set are one node. A node's shingles are dealt by hash into parts, a few more than two
   linked sets of its size can differ in, so that two linked nodes have a whole part in common. Nodes that share a part
   belong to one family; every other pair is ruled out. Part hashes travel packed, and tasks reduce what they share.
   Shingles of very many documents would bring unrelated nodes together, where such a shingle is alone in its part. They are
   found by counts in a table of fixed size, and parts are made without them; a set whose other shingles fill too few parts
   for that also gets parts with less common ones left out, and in the end parts of all, so that no link is lost.
2. A family of more than BLOCK nodes is first tried against the smallest node of each part; if that links all of it, it
   is done. Otherwise, unless its nodes would meet a few blocks each, it gives way to overlapping families, one about the
   smallest node of each part, so that chains of shared parts do not bring all their nodes together. Families are cut into blocks of BLOCK nodes; every pair of blocks is one task.
3. A task builds a signature tree over each block: a tree node holds the OR (and the AND) of the token bitmaps below it
   and the range of set sizes. Both trees are descended together; a pair of tree nodes is dropped when the largest
   possible overlap is too small, or when all below is one component already. What is left is compared exactly.
4. Components of the links found give each document the smallest doc_id it can reach.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; fewer words than a shingle
make one shingle of the whole sequence; rows that share a doc_id are nodes of their own sets, and component_id is that of
the row; a null doc_id can be linked but is never the smallest; extra columns are ignored; an empty table gives an empty
result. Sets are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import blobs, kernel
from panelworks.llm.catalogue import read, registered
from panelworks.llm.components import components
from panelworks.scale import batch_bytes, cut_lineage

# Linked: PERCENT of the union is shared.
PERCENT = 90
SIZE_STEP = 1.25
# Parts beyond the differences that two linked sets can have, and how far, in standard deviations, the parts that the
# smallest set of a size class fills are to lie above those differences.
SPARE, SURE = 3, 6
# Nodes of a block, fan-out of a tree, bits of a signature.
BLOCK, FAN_OUT, BITS = 256, 8, 2048
# The nodes of a large family may meet so many blocks on average, as a share of BLOCK; beyond that it gives way to overlapping families.
MEETS = 1 / 16
# Counters of shingles, by the leading bits of their hashes, and the pieces in which they are summed.
COUNTER_BITS, PIECES = 22, 64
# A shingle is common from this count on above what a counter holds on average; a grade is four times as many, up to the last.
COMMON, GRADES = 24, 7
# Text bytes whose keys a task reduces before sending them.
BLOCK_BYTES = 8 << 20
# Text bytes of a part of nodes, which one task holds, and pairs of texts that it opens at once.
PART_BYTES, TESTED = 8 << 20, 64
# Text bytes whose shingles are formed at once, which takes about 60 times that.
STEP_BYTES = 1 << 19
# Bytes that a worker gets at once.
BATCH_BYTES = 8 << 20
_KEYS, _REPLIES, _TEXTS = range(3)


@dataclass(frozen=True)
class Rule:
    """How many words make a shingle, and the share of the union, in percent, that links two sets."""

    words: int = 3
    percent: int = PERCENT

    def differences(self, size: np.ndarray) -> np.ndarray:
        """Most shingles in which a set of this size and a linked one, not smaller, can differ."""
        larger = 100 * size // self.percent
        return (size + larger) * (100 - self.percent) // (100 + self.percent)

    def needed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Least overlap of two linked sets."""
        return -(-self.percent * (one + two) // (100 + self.percent))


def shingle_sets(batch: pa.RecordBatch, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and the offset of each text plus the end."""
    data, offsets = kernel.text_bytes(batch.column("text"))
    starts, ends, bounds = kernel.word_spans(data, offsets)
    words = kernel.word_hashes(data, starts, ends)
    row = kernel.rows_of(bounds)
    k, count = rule.words, np.diff(bounds)
    n = max(0, len(words) - k + 1)
    inside = np.flatnonzero(row[:n] == row[len(row) - n :])
    values, owner = [kernel.chain(words, k)[inside]], [row[inside]]
    for short in range(1, k):
        rows = np.flatnonzero(count == short)
        at = bounds[:-1][rows]
        value = words[at].copy()
        for step in range(1, short):
            value = kernel.mix(value) + words[at + step]
        values.append(kernel.mix(value + np.uint64(short)))
        owner.append(rows)
    value, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    return value[new], np.searchsorted(owner[new], np.arange(batch.num_rows + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def nodes_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each set."""
    return kernel.mix(_sums(kernel.mix(values), offsets) ^ kernel.mix(np.diff(offsets).astype(np.uint64)))


def _size_steps(largest: int) -> np.ndarray:
    """Lower ends of the size classes."""
    steps = [1]
    while steps[-1] <= largest:
        steps.append(max(steps[-1] + 1, int(steps[-1] * SIZE_STEP)))
    return np.array(steps, dtype=np.int64)


def _parts_of(steps: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Parts of each size class, and the differences of linked sets whose smaller one lies in it.

    A hash leaves some parts of a set empty. There are so many parts that even the smallest set of the class nearly always
    fills more than can differ; the count of filled parts has about the mean and variance of balls in bins.
    """
    apart = rule.differences(steps[1:] - 1)
    parts = (apart + 1 + SPARE).astype(np.float64)
    for _ in range(64):
        load = np.exp(-steps[:-1] / parts)
        filled, spread = parts * (1 - load), np.sqrt(np.maximum(0, parts * load * (1 - (1 + steps[:-1] / parts) * load)))
        short = (filled - SURE * spread <= apart) & (parts < 2 * steps[:-1])
        if not short.any():
            break
        parts = np.where(short, np.ceil(parts * 1.02 + 1), parts)
    return parts.astype(np.int64), apart


def part_keys(values: np.ndarray, offsets: np.ndarray, rule: Rule, grades: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of all parts of all sets. Two different linked sets share a key at least.

    ``grades``: how common the shingles of each counter are, 0 for those that are not. Sets with the parts of shingles up to a
    grade differ in no more of them than whole ones, so two linked sets share such a part, unless both fill too few of them.
    """
    size = np.diff(offsets)
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    steps = _size_steps(int(size.max()) + 1)
    parts_of, apart = _parts_of(steps, rule)
    own = np.searchsorted(steps, size, side="right") - 1
    least = np.searchsorted(steps, -(-rule.percent * size // 100), side="right") - 1
    row = kernel.rows_of(offsets)
    mixed = kernel.mix(values)
    # Every set takes the same steps, whatever other sets are at hand: one that has no shingle of a grade may meet one that has.
    common, last = (None, 0) if grades is None else (grades[_counter(values)], int(grades.max()))
    sets, keys = [], []
    for back in range(int((own - least).max()) + 1):
        level = own - back
        open_ = (level >= least) & (size > 0) & (rule.differences(size) > 0)
        for grade in range(last + 1):
            take = open_[row] if common is None else open_[row] & (common <= grade)
            r = row[take]
            parts = parts_of[level[r]]
            place = r * int(parts_of.max() + 1) + ((values[take] >> np.uint64(20)) % parts.astype(np.uint64)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, r = place[order], r[order]
            head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            if len(head):
                total = np.add.reduceat(mixed[take][order], head)
                part = (place[head] % int(parts_of.max() + 1)).astype(np.uint64)
                salt = kernel.mix((level[r[head]].astype(np.uint64) << np.uint64(32)) | part)
                sets.append(r[head])
                keys.append(kernel.mix(total ^ salt))
            # Sets with so many empty parts that all common ones may be empty go on to the next grade. The smaller set of a
            # pair lies in this level, so that its differences are bounded by the level's, too.
            filled = np.bincount(r[head], minlength=len(size))
            open_ &= filled <= np.minimum(rule.differences(size), apart[level])
            if not open_.any():
                break
        # After the last grade such sets of a class share one more key.
        lonely = np.flatnonzero(open_)
        sets.append(lonely)
        keys.append(kernel.mix(level[lonely].astype(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(keys)


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def described(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, node) of every row; besides, with a piece, the packed counters of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        for batch in kernel.slices(batches, "text", STEP_BYTES):
            values, offsets = shingle_sets(batch, rule)
            np.add.at(counts, _counter(values), np.uint32(1))
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield kernel.record_batch(
                doc_id=batch.column("doc_id"), n_shingles=pa.array(np.diff(offsets)), node=pa.array(nodes_of(values, offsets).view(np.int64)), piece=none[0], counts=none[1]
            )
        for piece, part in enumerate(np.split(counts, PIECES)):
            if part.any():
                longs = pa.nulls(1, pa.int64())
                yield kernel.record_batch(doc_id=longs, n_shingles=longs, node=longs, piece=pa.array([piece], pa.int32()), counts=pa.array([blobs.pack(part)], pa.binary()))

    return documents.mapInArrow(run, "doc_id long, n_shingles long, node long, piece int, counts binary")


def _common(table: pa.Table) -> pa.Table:
    """The counters of a piece, of all tasks, to those far above their mean and their grades."""
    piece = table.column("piece")[0].as_py()
    total = np.zeros((1 << COUNTER_BITS) // PIECES, dtype=np.int64)
    for payload in table.column("counts"):
        total += blobs.unpack(payload.as_py())[0]
    mean = total.mean()
    above = (total - mean) / max(COMMON, 6 * mean**0.5)
    at = np.flatnonzero(above >= 1)
    grade = np.minimum(1 + np.floor(np.log(above[at]) / np.log(4)), GRADES).astype(np.uint8)
    return pa.table({"packed": pa.array([blobs.pack((piece * len(total) + at).astype(np.uint32), grade)], pa.binary())})


def common_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counters of shingles that very many documents hold, and their grades: as many as there are counters at most."""
    packed = [bytes(r[0]) for r in counts.groupBy("piece").applyInArrow(_common, "packed binary").collect()]
    at, grade = blobs.joined(packed) if packed else (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
    return at, grade


def _grades(common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    grades = np.zeros(1 << COUNTER_BITS, dtype=np.uint8)
    grades[common[0]] = common[1]
    return grades


def _of_node(node: np.ndarray, parts: int) -> np.ndarray:
    return blobs.bucket(kernel.mix(node), parts)


def _replies(node: np.ndarray, leader: np.ndarray, parts: int) -> list[tuple[int, int, bytes]]:
    """Each node with the smallest nodes that hold one of its keys, once each; a smallest node comes with itself."""
    order = np.lexsort((leader, node))
    node, leader = node[order], leader[order]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (leader[1:] != leader[:-1])]) if len(node) else np.zeros(0, bool)
    node, leader = node[new], leader[new]
    return blobs.split(_of_node(node, parts), _REPLIES, node, leader)


def _keys(documents: DataFrame, rule: Rule, common: tuple[np.ndarray, np.ndarray], parts: int, kind: int) -> DataFrame:
    """Kind _KEYS: (key, smallest node, held by several) per task and bucket. Kind _REPLIES: nodes of a task that share keys."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, node = (np.concatenate(h) for h in zip(*held, strict=True))
        key = key & ~np.uint64(0xFFFF)  # 48 bits: a key shared by chance costs a comparison, nothing else
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[new], node[new]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        several = np.concatenate([~head[1:], [False]])
        if kind == _KEYS:
            key, node, several = key[head], node[head], several[head]
            rows = blobs.split(blobs.bucket(key, parts), _KEYS, key, node, several)
        else:
            shared = several | ~head
            leader = node[np.maximum.accumulate(np.where(head, np.arange(len(node)), 0))]
            rows = _replies(node[shared], leader[shared], parts)
        if rows:
            yield blobs.rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, grades = [], 0, _grades(common)
        for batch in kernel.slices(batches, "text", STEP_BYTES):
            values, offsets = shingle_sets(batch, rule)
            which, key = part_keys(values, offsets, rule, grades)
            held.append((key, nodes_of(values, offsets)[which]))
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield from flush(held) if sum(len(h) for h, _ in held) else ()
                held, size = [], 0
        if sum(len(h) for h, _ in held):
            yield from flush(held)

    return documents.mapInArrow(run, blobs.SCHEMA)


def _shared(parts: int):
    """Bucket of keys to replies: keys that several nodes hold."""

    def run(table: pa.Table) -> pa.Table:
        key, node, several = blobs.joined(table.column("payload").to_pylist())
        order = np.lexsort((node, key))
        key, node, several = key[order], node[order], several[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        which = np.cumsum(first) - 1
        head = np.flatnonzero(first)
        low, high = np.minimum.reduceat(node, head), np.maximum.reduceat(node, head)
        more = ((low != high) | np.logical_or.reduceat(several, head))[which]
        return pa.Table.from_batches([blobs.rows(_replies(node[more], low[which][more], parts))])

    return run


def _text_rows(documents: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Kind _TEXTS: compressed texts by node, one of each node per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text", 4 * kernel.SLICE_BYTES):
            node = np.concatenate([nodes_of(*shingle_sets(part, rule)) for part in kernel.slices([batch], "text", STEP_BYTES)])
            data, offsets = kernel.text_bytes(batch.column("text"))
            own = np.unique(node, return_index=True)[1]
            rows = []
            for part, some in blobs.groups(_of_node(node[own], parts)):
                body = [data[offsets[i] : offsets[i + 1]] for i in own[some]]
                rows.append((part, _TEXTS, blobs.pack(node[own[some]], np.array([len(b) for b in body], dtype=np.int64), np.concatenate(body), codec=blobs.DENSE)))
            yield blobs.rows(rows)

    return documents.mapInArrow(run, blobs.SCHEMA)


_INVOLVED = "node long, leaders array<long>, text binary"


def _involved(table: pa.Table) -> pa.Table:
    """Group of nodes with the leaders of their shared keys: the texts of the nodes that share one."""
    replies, texts = blobs.of_kind(table, _REPLIES), blobs.of_kind(table, _TEXTS)
    out: dict[str, list] = {"node": [], "leaders": [], "text": []}
    if replies is not None and texts is not None:
        node, first = np.unique(texts[0], return_index=True)
        end = np.cumsum(texts[1])
        for at, leaders in _leaders_by_node(*replies):
            k = int(np.searchsorted(node, at))
            if k < len(node) and node[k] == at:
                i = first[k]
                out["node"].append(int(np.uint64(at).view(np.int64)))
                out["leaders"].append(leaders.view(np.int64))
                out["text"].append(blobs.pack(texts[2][end[i] - texts[1][i] : end[i]]))
    return pa.table([pa.array(out["node"], pa.int64()), pa.array(out["leaders"], pa.list_(pa.int64())), pa.array(out["text"], pa.binary())], names=list(out))


def _leaders_by_node(node: np.ndarray, leader: np.ndarray) -> Iterator[tuple[np.uint64, np.ndarray]]:
    order = np.argsort(node, kind="stable")
    kinds, first = np.unique(node[order], return_index=True)
    for at, own in zip(kinds, np.split(order, first[1:]), strict=True):
        yield at, np.unique(leader[own])


def _sets_of(payloads: list[bytes], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.array([blobs.unpack(p)[0].tobytes() for p in payloads], pa.binary())
    return shingle_sets(kernel.record_batch(text=texts), rule)


class SignatureTree:
    """Levels from the leaves (single sets) to the root; a node covers FAN_OUT nodes of the level below."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, order: np.ndarray, component: np.ndarray) -> None:
        size, component = np.diff(offsets)[order], component[order]
        words = np.zeros((len(order), BITS // 64), dtype=np.uint64)
        for k, i in enumerate(order):
            bit = (values[offsets[i] : offsets[i + 1]] >> np.uint64(12)) % np.uint64(BITS)
            np.bitwise_or.at(words[k], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.levels = [(words, words, size, size, component, component)]
        ways = (np.bitwise_or, np.bitwise_and, np.minimum, np.maximum, np.minimum, np.maximum)
        while len(self.levels[-1][0]) > 1:
            head = np.arange(0, len(self.levels[-1][0]), FAN_OUT)
            self.levels.append(tuple(way.reduceat(part, head) for way, part in zip(ways, self.levels[-1], strict=True)))

    def raised(self, height: int) -> None:
        """Add copies of the root, so that two trees are of one height."""
        while len(self.levels) < height:
            self.levels.append(self.levels[-1])


def _possible(one: tuple, two: tuple, i: np.ndarray, j: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether the largest possible overlap below two tree nodes reaches the least that a link needs, and whether what is
    below them is not of one component already."""
    without = lambda a, b: np.bitwise_count(a & ~b).sum(axis=1).astype(np.int64)
    most = np.minimum(one[3][i] - without(one[1][i], two[0][j]), two[3][j] - without(two[1][j], one[0][i]))
    apart = (one[4][i] != two[5][j]) | (one[5][i] != two[4][j])
    return apart & (most >= rule.needed(one[2][i], two[2][j]))


def candidates(one: SignatureTree, two: SignatureTree, rule: Rule, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that the descent of both trees does not rule out."""
    height = max(len(one.levels), len(two.levels))
    one.raised(height)
    two.raised(height)
    i = j = np.zeros(1, dtype=np.int64)
    for level in range(height - 1, -1, -1):
        keep = np.zeros(len(i), dtype=bool)
        for first in range(0, len(i), 65_536):
            part = slice(first, first + 65_536)
            keep[part] = _possible(one.levels[level], two.levels[level], i[part], j[part], rule)
        i, j = i[keep], j[keep]
        if level:
            below = [len(t.levels[level - 1][0]) for t in (one, two)]
            step = [1 if len(t.levels[level][0]) == n else FAN_OUT for t, n in zip((one, two), below, strict=True)]
            a = (i[:, None] * step[0] + np.arange(step[0]))[:, :, None]
            b = (j[:, None] * step[1] + np.arange(step[1]))[:, None, :]
            a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
            real = (a < below[0]) & (b < below[1]) & ((a <= b) | (not same))
            i, j = a[real], b[real]
    return (i[i != j], j[i != j]) if same else (i, j)


def _linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * shared >= rule.percent * (len(a) + len(b) - shared)


def _block_pair(rule: Rule):
    """Two blocks of a family (or one with itself) to links, as few as hold its components together."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        node = np.asarray(table.column("node"))
        known = np.asarray(table.column("component"))
        values, offsets = _sets_of(table.column("text").to_pylist(), rule)
        size = np.diff(offsets)
        parent = {int(c): int(c) for c in known}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        sides = [np.flatnonzero(side == s) for s in (0, 1)]
        if not len(sides[0]):
            sides.reverse()
        same = not len(sides[1])
        orders = [s[np.lexsort((size[s], known[s]))] for s in sides]
        one = SignatureTree(values, offsets, orders[0], known)
        left, right = candidates(one, one if same else SignatureTree(values, offsets, orders[1], known), rule, same)
        x, y = orders[0][left], orders[0 if same else 1][right]
        links = []
        # Pairs that differ least in size come first: they link most often, and links spare later comparisons.
        for k in np.argsort(np.abs(size[x] - size[y]), kind="stable"):
            p, q = root(int(known[x[k]])), root(int(known[y[k]]))
            if p != q and _linked(values[offsets[x[k]] : offsets[x[k] + 1]], values[offsets[y[k]] : offsets[y[k] + 1]], rule):
                parent[max(p, q)] = min(p, q)
                links.append((int(node[x[k]]), int(node[y[k]])))
        return pa.table([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], names=["a", "b"])

    return run


def _tested(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TESTED):
                some = batch.slice(first, TESTED)
                sets = [_sets_of(some.column(c).to_pylist(), rule) for c in ("text_a", "text_b")]
                linked = [_linked(*(v[o[k] : o[k + 1]] for v, o in sets), rule) for k in range(some.num_rows)]
                yield kernel.record_batch(a=some.column("a").filter(pa.array(linked, pa.bool_())), b=some.column("b").filter(pa.array(linked, pa.bool_())))

    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _neighbourhoods(nodes: DataFrame, rule: Rule, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, component, family): nodes (node, component, text) in overlapping families, one about each smallest holder of a key.

    All nodes that share a key are in the family of its smallest holder, and a node is in one family per key at most, however
    long the chains of shared keys are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grades = _grades(common)
        for batch in batches:
            for first in range(0, batch.num_rows, TESTED):
                some = batch.slice(first, TESTED)
                which, key = part_keys(*_sets_of(some.column("text").to_pylist(), rule), rule, grades)
                which = pa.array(which)
                yield kernel.record_batch(node=some.column("node").take(which), component=some.column("component").take(which), key=pa.array(key.view(np.int64)))

    held = cut_lineage(nodes.select("node", "component", "text").mapInArrow(run, "node long, component long, key long"), "tree-held")
    # Holders of one component have nothing left to find among themselves.
    ends = [F.min("component").alias("_low"), F.max("component").alias("_high")]
    least = held.groupBy("key").agg(F.min("node").alias("family"), *ends).filter("_low < _high").select("key", "family")
    return held.join(least, "key").select("node", "component", "family").distinct()


def _units(of_component: DataFrame) -> DataFrame:
    """(family, unit, unit_n, parts, cuts) of (family, component, n): nodes, components and blocks; the unit of small ones is null."""
    unit = F.when(F.col("n") > BLOCK, F.col("component"))
    units = of_component.groupBy("family", unit.alias("unit")).agg(F.sum("n").alias("unit_n"), F.count("*").alias("parts"))
    return units.withColumn("cuts", F.ceil(F.col("unit_n") / BLOCK).cast("int"))


def _met(reached: DataFrame) -> DataFrame:
    """(family, whole) of families of several components: whether their nodes meet few blocks on average."""
    spared = F.sum(F.when(F.col("unit").isNull(), 0).otherwise(F.col("unit_n") * F.col("cuts")))
    n = F.sum("unit_n")
    units = _units(reached.groupBy("family", "component").agg(F.count("*").alias("n"))).groupBy("family")
    met = units.agg(F.sum("parts").alias("parts"), (F.sum("cuts") * n - spared <= int(MEETS * BLOCK) * n).alias("whole"))
    return met.filter("parts > 1").drop("parts")


def links_between(documents: DataFrame, rule: Rule, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): links between nodes that hold the components of all links together."""
    spark = documents.sparkSession
    # A task sends a row to each part at most, so rows grow with the square of the parts.
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    keys = _keys(documents, rule, common, parts, _KEYS).groupBy("part").applyInArrow(_shared(parts), blobs.SCHEMA)
    replies = keys.unionByName(_keys(documents, rule, common, parts, _REPLIES))
    gathered = replies.unionByName(_text_rows(documents, rule, parts)).groupBy("part").applyInArrow(_involved, _INVOLVED)
    involved = cut_lineage(gathered, "tree-nodes")
    stars = involved.select(F.col("node").alias("a"), F.explode("leaders").alias("b")).filter("a <> b")
    families = cut_lineage(components(stars).withColumnRenamed("component", "family"), "tree-families")
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    large = cut_lineage(families.join(sizes.filter(F.col("n") > BLOCK), "family").select("node", "family"), "tree-large")
    member = families.withColumn("component", F.col("node"))
    tried = None
    if not large.isEmpty():
        within = cut_lineage(stars.join(large.select(F.col("node").alias("a")), "a", "left_semi"), "tree-stars")
        tried = cut_lineage(_tested(within, involved, rule), "tree-tried")
        reached = large.join(components(tried), "node", "left").select("node", "family", F.coalesce("component", "node").alias("component"))
        reached = cut_lineage(reached, "tree-reached")
        met = cut_lineage(_met(reached), "tree-met")
        undone = reached.join(met.filter("not whole"), "family", "left_semi").select("node", "component").join(involved.select("node", "text"), "node")
        whole = reached.join(met.filter("whole"), "family", "left_semi")
        small = member.join(large.select("node"), "node", "left_anti")
        member = cut_lineage(small.unionByName(whole).unionByName(_neighbourhoods(undone, rule, common)), "tree-groups")
    # A family that is one component is done. In the others a component of more than BLOCK nodes is a unit of its own, whose
    # blocks meet those of other units only; the nodes of all smaller components are one unit, whose blocks meet all.
    of_component = member.groupBy("family", "component").agg(F.count("*").alias("n"))
    units = _units(of_component)
    listed = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: F.struct((~F.col("unit").isNull()).alias("large"), F.coalesce("unit", F.lit(0)).alias("unit"), k.alias("k")))
    open_ = units.groupBy("family").agg(F.flatten(F.collect_list(listed)).alias("others"), F.sum("parts").alias("parts")).filter("parts > 1").drop("parts")
    open_ = cut_lineage(open_, "tree-open")
    block = F.struct(
        (F.col("n") > BLOCK).alias("large"), F.when(F.col("n") > BLOCK, F.col("component")).otherwise(0).alias("unit"),
        F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int").alias("k"),
    )
    placed = (
        member.join(of_component, ["family", "component"])
        .join(open_, "family")
        .withColumn("large", F.col("n") > BLOCK)
        .withColumn("cuts", F.size(F.filter("others", lambda o: (o["large"] == F.col("large")) & (~o["large"] | (o["unit"] == F.col("component"))))))
        .select("node", "family", "component", block.alias("block"), "others")
    )
    meets = F.filter("others", lambda o: ~(o["large"] & (o["unit"] == F.col("block.unit")) & F.col("block.large")))
    spread = placed.select("node", "family", "component", "block", F.explode(meets).alias("other")).select(
        "node", "family", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")
    )
    found = (
        spread.join(involved.select("node", "text"), "node")
        .groupBy("family", "i", "j")
        .applyInArrow(_block_pair(rule), "a long, b long")
    )
    return found if tried is None else tried.unionByName(found)


def join_components(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    table = documents.select(F.col("doc_id").cast("long"), "text")
    with batch_bytes(documents.sparkSession, BATCH_BYTES):
        found = cut_lineage(described(table, rule), "tree-rows")
        common = common_shingles(found.filter("piece is not null").select("piece", "counts"))
        reached = components(links_between(table, rule, common))
    rows = found.filter("piece is null").select("doc_id", "n_shingles", "node")
    full = rows.filter("n_shingles > 0").join(reached, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    least = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = full.join(least, "component").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


@registered("op7_signature_tree")
def op7_signature_tree(spark: SparkSession, folder: str) -> DataFrame:
    return join_components(read(spark, folder, "documents"))


def one_of_each(documents: DataFrame, rule: Rule) -> DataFrame:
    """The documents that are the smallest of their component; rows without a doc_id stay."""
    found = join_components(documents, rule)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    named = documents.filter("doc_id is not null")
    return named.join(stay, named["doc_id"].cast("long") == stay["_stay"], "left_semi").unionByName(documents.filter("doc_id is null"))
