"""Removal of byte strings that occur in an earlier document, by a sparse suffix array in range-partitioned buckets.

A repeated string of LENGTH bytes is found at an anchor: the LEAD-byte piece inside it with the smallest hash (the last
one on a tie). Equal strings have equal anchors at the same place, and neighbouring strings mostly share theirs, so only
the suffixes at anchors are handled, and every string belongs to exactly one of them. No match can be lost by this.

1. Anchor hashes are brought together in buckets to see which of them more than one document holds. Tasks reduce what
   they hold of a hash themselves and send its smallest document.
2. Documents get their shared anchors back. The stretch of text that the strings of such an anchor cover is a record;
   equal records of one group of documents are reduced to the smallest document.
3. Splitters sampled from the suffixes' leading bytes range-partition the records. Splitters are no longer than an
   anchor, so strings that are equal never fall on both sides of a boundary. Each bucket sorts its strings by multikey
   quicksort over eight-byte words, leaving out what is already alone, down to equal strings; all but those of the
   smallest document are removed.
4. The covered bytes of each document are merged and cut out.

Defined cases: a null text is empty; texts shorter than LENGTH are kept whole; rows with equal doc_id are one document
and never remove each other's bytes; rows with a null doc_id are left as they are and remove nothing; very long texts are
looked at in overlapping steps, so that a task needs about ten times the longest text; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import blobs, kernel
from panelworks.llm.catalogue import read, registered

LENGTH = 50
LEAD = 24
# Leading bytes that splitters compare, as one number; no more than LEAD.
PREFIX = 8
# Documents looked at for splitters, and anchors taken from each.
SAMPLE_DOCUMENTS, SAMPLE_ANCHORS = 20_000, 8
# Text bytes of which a task reduces the anchors before sending them.
BLOCK_BYTES = 8 << 20
# Text bytes whose anchors are found at once (which takes about 60 times that), and bytes of records that are sorted at once.
STEP_BYTES = 1 << 18
RANGE_BYTES = 1 << 20
# Text bytes of a group of documents or range of records, which one task holds.
PART_BYTES = 8 << 20

_PLACE = np.uint64((1 << 31) - 1)
ANCHORS, REPLIES, TEXTS, RECORDS, SPANS = range(5)


def _of_document(doc_id: np.ndarray, buckets: int) -> np.ndarray:
    return blobs.bucket(kernel.mix(doc_id.astype(np.int64).view(np.uint64)), buckets)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor, and the first and last start of the strings that belong to it.

    Long data are looked at in steps that overlap by a string less a byte; an anchor met in two steps is one.
    """
    if len(data) < 2 * STEP_BYTES:
        return _anchors(data, offsets)
    found = []
    for a in range(0, len(data) - LENGTH + 1, STEP_BYTES):
        b = min(a + STEP_BYTES + LENGTH - 1, len(data))
        inside = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)] - a
        place, hashes, first, last = _anchors(data[a:b], np.concatenate([[0], inside, [b - a]]))
        found.append((place + a, hashes, first + a, last + a))
    place, hashes, first, last = (np.concatenate(f) for f in zip(*found, strict=True))
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
    return place[head], hashes[head], first[head], last[np.append(head[1:], len(place)) - 1] if len(place) else last


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    sums = kernel.prefix_sums(data)
    starts = np.arange(len(data) - LEAD + 1)
    hashes = kernel.span_hashes(sums, starts, starts + LEAD)
    least = (hashes & ~_PLACE) | (_PLACE - starts.astype(np.uint64))
    width, reach = LENGTH - LEAD + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    whole = np.ones(len(data) + 1, dtype=bool)
    for back in range(1, LENGTH):
        at = offsets[1:] - back
        whole[at[at >= 0]] = False
    start = np.flatnonzero(whole[: len(least)])
    if not len(start):
        return none, none.astype(np.uint64), none, none
    place = (_PLACE - (least[start] & _PLACE)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    tail = np.append(head[1:], len(start)) - 1
    return place[head], hashes[place[head]], start[head], start[tail]


def _small(doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as a base and four-byte differences where they fit."""
    base = doc_id.min() if len(doc_id) else 0
    difference = doc_id - base
    narrow = not len(doc_id) or difference.max() < 1 << 32
    return np.array([base, len(doc_id)], dtype=np.int64), difference.astype("<u4") if narrow else difference.astype("<u8")


def _wide(base: np.ndarray, difference: np.ndarray) -> np.ndarray:
    return difference.astype(np.int64) + base[0]


def _replies(doc: np.ndarray, hashes: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((hashes, doc))
    return blobs.split(_of_document(doc[order], buckets), REPLIES, doc[order], hashes[order])


def _spans(doc: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((start, doc))
    return blobs.split(_of_document(doc[order], buckets), SPANS, doc[order], start[order], length[order].astype(np.uint8))


def _hash_docs(documents: DataFrame, buckets: int, kind: int) -> DataFrame:
    """Kind ANCHORS: (hash, smallest document, held by several) per task and bucket. Kind REPLIES: shared hashes of the
    documents of a task that hold one together."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, doc = (np.concatenate(h) for h in zip(*held, strict=True))
        hashes = hashes & ~np.uint64(0xFFFF)
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
        hashes, doc = hashes[new], doc[new]
        head = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        several = np.concatenate([~head[1:], [False]])
        if kind == ANCHORS:
            hashes, doc, several = hashes[head], doc[head], several[head]
            rows = [(p, ANCHORS, blobs.pack(hashes[own] >> np.uint64(16), *_small(doc[own]), several[own])) for p, own in blobs.groups(blobs.bucket(hashes, buckets))]
        else:
            shared = several | ~head
            rows = _replies(doc[shared], hashes[shared], buckets)
        if rows:
            yield blobs.rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in kernel.slices(batches, "text", STEP_BYTES):
            data, offsets = kernel.text_bytes(batch.column("text"))
            place, hashes, _, _ = anchors(data, offsets)
            doc = np.asarray(batch.column("doc_id"))[np.searchsorted(offsets, place, side="right") - 1]
            held.append((hashes, doc))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held and sum(len(h) for h, _ in held):
            yield from flush(held)

    return documents.mapInArrow(run, blobs.SCHEMA)


def _shared(buckets: int):
    """Bucket of anchor hashes to replies: those that several documents hold."""

    def run(table: pa.Table) -> pa.Table:
        hashes, doc, several = [], [], []
        for payload in table.column("payload").to_pylist():
            cut, base, difference, more = blobs.unpack(payload)
            hashes.append(cut << np.uint64(16))
            doc.append(_wide(base, difference))
            several.append(more)
        hashes, doc, several = np.concatenate(hashes), np.concatenate(doc), np.concatenate(several)
        order = np.argsort(hashes, kind="stable")
        hashes, doc, several = hashes[order], doc[order], several[order]
        same = hashes[1:] == hashes[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | several
        return pa.Table.from_batches([blobs.rows(_replies(doc[twice], hashes[twice], buckets))])

    return run


def _text_blobs(documents: DataFrame, buckets: int) -> DataFrame:
    """Kind TEXTS: compressed texts of a group of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text", 4 * kernel.SLICE_BYTES):
            data, offsets = kernel.text_bytes(batch.column("text"))
            doc = np.asarray(batch.column("doc_id"))
            rows = []
            for p, own in blobs.groups(_of_document(doc, buckets)):
                body = [data[offsets[i] : offsets[i + 1]] for i in own]
                rows.append((p, TEXTS, blobs.pack(doc[own], np.array([len(b) for b in body], dtype=np.int64), np.concatenate(body), codec=blobs.DENSE)))
            yield blobs.rows(rows)

    return documents.mapInArrow(run, blobs.SCHEMA)


def _texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a group in ascending order: ids, bytes, offsets."""
    kinds = np.asarray(table.column("kind"))
    payloads = [p for p, k in zip(table.column("payload").to_pylist(), kinds, strict=True) if k == TEXTS]
    if not payloads:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    doc, size, data = blobs.joined(payloads)
    return doc, data, np.concatenate([[0], np.cumsum(size)])


def _pieces(doc: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The documents of a group in steps of bounded size."""
    first = 0
    while first < len(doc):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, side="right")) - 1)
        yield doc[first:last], data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _overlapping(doc: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The same with long documents in pieces that overlap by a string less a byte, and the place of the first byte in its
    document. An anchor's stretch may be cut so; its strings still meet in the sort."""
    for doc, data, offsets in _pieces(doc, data, offsets):  # noqa: PLR1704, B020
        if len(doc) > 1 or len(data) < 2 * STEP_BYTES:
            yield doc, data, offsets, 0
        else:
            for a in range(0, len(data) - LENGTH + 1, STEP_BYTES):
                part = data[a : a + STEP_BYTES + LENGTH - 1]
                yield doc, part, np.array([0, len(part)]), a


def _reduced(doc: np.ndarray, lead: np.ndarray, size: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each record the first record, in ascending document order, that is equal to it; and where each begins."""
    starts = np.cumsum(size) - size
    key = kernel.span_hashes(kernel.prefix_sums(body), starts, starts + size)
    key = kernel.mix(key ^ (lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((doc, key))
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    first = np.empty(len(doc), dtype=np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    other = np.flatnonzero(first != np.arange(len(doc)))
    # Equal hashes are not taken on trust.
    alike = (size[other] == size[first[other]]) & (lead[other] == lead[first[other]])
    first[other[~alike]] = other[~alike]
    other = other[alike]
    if len(other):
        differs = body[blobs.flat(starts[other], size[other])] != body[blobs.flat(starts[first[other]], size[other])]
        unequal = np.add.reduceat(differs, np.cumsum(size[other]) - size[other]) > 0
        first[other[unequal]] = other[unequal]
    return first, starts


def _prefixes(at: np.ndarray, lead: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Leading bytes of the suffix at the anchor of each record, as numbers of the same order."""
    return body[(at + lead)[:, None] + np.arange(PREFIX)].copy().view(">u8").ravel().astype(np.uint64)


def _ranges(prefix: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Records in ranges of about RANGE_BYTES by their leading bytes; equal ones are never parted."""
    if not len(prefix):
        return
    order = np.argsort(prefix, kind="stable")
    ordered = prefix[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    before = (np.cumsum(size[order]) - size[order])[head] // RANGE_BYTES
    for _, own in blobs.groups(np.repeat(before, np.diff(np.append(head, len(order))))):
        yield order[own]


def _records(buckets: int, splitters: np.ndarray):
    """Group of documents with its shared hashes to records by range, and the spans already known to go."""

    def run(table: pa.Table) -> pa.Table:
        replies = blobs.of_kind(table, REPLIES)
        rows: list[tuple[int, int, bytes]] = []
        if replies is None:
            return pa.Table.from_batches([blobs.rows(rows)])
        shared = np.unique(kernel.mix(replies[1] ^ kernel.mix(replies[0].view(np.uint64))))
        found: list[list[np.ndarray]] = []
        for doc, data, offsets, skipped in _overlapping(*_texts_of(table)):
            place, hashes, first, last = anchors(data, offsets)
            row = np.searchsorted(offsets, place, side="right") - 1
            own = kernel.found_in(shared, kernel.mix((hashes & ~np.uint64(0xFFFF)) ^ kernel.mix(doc[row].view(np.uint64))))
            place, first, last, row = place[own], first[own], last[own], row[own]
            size = last - first + LENGTH
            found.append([doc[row], first - offsets[row] + skipped, place - first, size, data[blobs.flat(first, size)]])
        if not found or not sum(len(f[0]) for f in found):
            return pa.Table.from_batches([blobs.rows(rows)])
        doc, start, lead, size, body = (np.concatenate(f) for f in zip(*found, strict=True))
        at = np.cumsum(size) - size
        for own in _ranges(_prefixes(at, lead, body), size):
            d, b, l, n, text = doc[own], start[own], lead[own], size[own], body[blobs.flat(at[own], size[own])]
            first, begin = _reduced(d, l, n, text)
            gone = d[first] < d
            rows += _spans(d[gone], b[gone], n[gone], buckets)
            # Of equal records the smallest document's stays; rows that share its doc_id stay as well.
            kept = np.flatnonzero(~gone)
            part = np.searchsorted(splitters, _prefixes(begin[kept], l[kept], text), side="right").astype(np.int32)
            for p, some in blobs.groups(part):
                k = kept[some]
                rows.append((p, RECORDS, blobs.pack(d[k], b[k], l[k].astype(np.uint8), n[k].astype(np.uint8), text[blobs.flat(begin[k], n[k])])))
        return pa.Table.from_batches([blobs.rows(rows)])

    return run


def equal_groups(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey sort of the strings of LENGTH bytes at ``starts``: those not alone, in order, and the number of their group."""
    words = np.zeros(len(body) + 8, dtype=np.uint64)
    padded = np.concatenate([body, np.zeros(16, dtype=np.uint8)])
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    active = np.arange(len(starts))
    group = np.zeros(len(starts), dtype=np.int64)
    for depth in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        word = words[starts[active] + depth]
        order = np.lexsort((word, group))
        active, group, word = active[order], group[order], word[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])]) if len(group) else np.zeros(0, bool)
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        active = active[~alone]
    return active, group


def _sorted_bucket(buckets: int):
    """Bucket of records to the spans of strings that a smaller document has, too."""

    def spans_of(doc: np.ndarray, start: np.ndarray, lead: np.ndarray, size: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, at = _reduced(doc, lead, size, body)
        whole = doc[first] < doc
        count = size - LENGTH + 1
        left = np.flatnonzero(~whole)
        string_at = blobs.flat(at[left], count[left])
        owner = np.repeat(left, count[left])
        active, group = equal_groups(body, string_at)
        found = [(doc[whole], start[whole], size[whole])]
        if len(active):
            who = doc[owner[active]]
            new = np.concatenate([[True], group[1:] != group[:-1]])
            least = np.minimum.reduceat(who, np.flatnonzero(new))
            gone = np.sort(active[who > least[np.cumsum(new) - 1]])
            # Neighbouring strings of one record become one span.
            head = np.flatnonzero(np.concatenate([[True], (np.diff(gone) != 1) | (owner[gone][1:] != owner[gone][:-1])])) if len(gone) else gone
            record = owner[gone[head]]
            found.append((doc[record], start[record] + string_at[gone[head]] - at[record], np.diff(np.append(head, len(gone))) - 1 + LENGTH))
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    def run(table: pa.Table) -> pa.Table:
        # Spans already known only pass by.
        kinds = np.asarray(table.column("kind"))
        rows = [(table.column("part")[i].as_py(), SPANS, table.column("payload")[i].as_py()) for i in np.flatnonzero(kinds == SPANS)]
        records = blobs.of_kind(table, RECORDS)
        if records is not None:
            doc, start, lead, size, body = records
            start, lead, size = start.astype(np.int64), lead.astype(np.int64), size.astype(np.int64)
            at = np.cumsum(size) - size
            found = [spans_of(doc[own], start[own], lead[own], size[own], body[blobs.flat(at[own], size[own])]) for own in _ranges(_prefixes(at, lead, body), size)]
            rows += _spans(*(np.concatenate(f) for f in zip(*found, strict=True)), buckets)
        return pa.Table.from_batches([blobs.rows(rows)])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(table: pa.Table) -> pa.Table:
    """Group of documents with its spans to the result rows."""
    spans = blobs.of_kind(table, SPANS) or [np.zeros(0, np.int64)] * 3
    order = np.argsort(spans[0], kind="stable")
    of, starts, lengths = (x[order].astype(np.int64) for x in spans)
    out = []
    for doc, data, offsets in _pieces(*_texts_of(table)):
        # Rows with equal doc_id all get the spans.
        first = np.searchsorted(of, doc, side="left")
        count = np.searchsorted(of, doc, side="right") - first
        span = blobs.flat(first, count)
        row = np.repeat(np.arange(len(doc)), count)
        begin = offsets[row] + starts[span]
        end = np.minimum(begin + lengths[span], offsets[row + 1])
        removed = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(removed, np.minimum(begin, end), 1)
        np.add.at(removed, end, -1)
        gone = np.cumsum(removed[:-1], dtype=np.int32) > 0
        runs = gone.copy()
        runs[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        runs[heads] = gone[heads]
        kept = ~gone
        digest = [hashlib.sha256(data[a:b][kept[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        out.append(pa.table({"doc_id": doc, "n_bytes": np.diff(offsets), "n_removed": kernel.sums_within(gone, offsets), "n_spans": kernel.sums_within(runs, offsets), "kept_sha256": pa.array(digest, pa.string())}))
    empty = pa.table({c: pa.array([], pa.int64() if c != "kept_sha256" else pa.string()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")})
    return pa.concat_tables([empty, *out])


def sample_splitters(documents: DataFrame, parts: int, total: int) -> np.ndarray:
    """Leading bytes of anchored suffixes that cut a bounded sample of ``total`` documents into ``parts`` equal parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text", STEP_BYTES):
            data, offsets = kernel.text_bytes(batch.column("text"))
            place, hashes, _, _ = anchors(data, offsets)
            row = np.searchsorted(offsets, place, side="right") - 1
            order = np.lexsort((hashes, row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            some = place[order[rank < SAMPLE_ANCHORS]]
            yield kernel.record_batch(prefix=pa.array([data[p : p + PREFIX].tobytes() for p in some], pa.binary()))

    # Documents are taken by a hash of their id, so that the sample does not depend on how rows are spread.
    step = max(1, total // SAMPLE_DOCUMENTS)
    some = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    found = np.sort(np.array([int.from_bytes(r[0], "big") for r in some.mapInArrow(run, "prefix binary").collect()], dtype=np.uint64))
    return found[np.linspace(0, len(found), parts + 1)[1:-1].astype(np.int64)] if len(found) else found


def remove_repeats(documents: DataFrame) -> DataFrame:
    """RESULT of every document: what strings of LENGTH bytes that a smaller document has, too, leave of it."""
    spark = documents.sparkSession
    table = documents.select(F.col("doc_id").cast("long"), "text")
    named, unnamed = table.filter("doc_id is not null"), table.filter("doc_id is null")
    # A task sends a row to each part at most, so rows grow with the square of the parts.
    total, size = named.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    hashes = _hash_docs(named, parts, ANCHORS).groupBy("part").applyInArrow(_shared(parts), blobs.SCHEMA)
    replies = hashes.unionByName(_hash_docs(named, parts, REPLIES))
    texts = _text_blobs(named, parts)
    splitters = sample_splitters(named, parts, total)
    found = replies.unionByName(texts).groupBy("part").applyInArrow(_records(parts, splitters), blobs.SCHEMA)
    spans = found.groupBy("part").applyInArrow(_sorted_bucket(parts), blobs.SCHEMA)
    cut = spans.unionByName(texts).groupBy("part").applyInArrow(_cut_out, RESULT)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    whole = unnamed.select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return cut.unionByName(whole)


@registered("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents"))
