"""Benchmark decontamination: a BM25 index of test items, searched with every training passage by block-max WAND.

Items are indexed in segments of at most SEGMENT words. Passages are windows of PASSAGE words, half overlapping, so that
every stretch of SEGMENT words lies within one. The weight of a word in a segment is its BM25 weight as a share of the
segment's whole score, so that one threshold serves all. For each passage the largest weights of its words in any segment
are summed first; passages whose sum reaches the threshold look at the block maxima, and only blocks that reach it are
scored in full. All segments above the threshold are retrieved. Their items are then verified on the whole document: the
share of the five-word shingles of the question, and of the answer (the last sentence or line), that it holds.

No threshold on passages finds all that this accepts: a document may hold question and answer far apart, or a long item in
pieces. What is accepted holds half of the item's shingles at least, so one of any choice of them that leaves out less than
half. Each document is looked up in such a choice, the shingles that the fewest items hold, and items found there are
verified as well. The score is that of the best passage in any case.

The index is cut into shards of bounded size, and all texts are searched with each; statistics are those of all items.

Defined cases: a null text has no passages; an item with no words is never found; with fewer than five words its whole
sequence is one shingle; an item of one sentence is all question; repeated rows are each searched; items or documents
with a null id are left out; extra columns are ignored; an empty table of either kind gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelworks.llm import blobs, kernel
from panelworks.llm.catalogue import read, registered
from panelworks.scale import cut_lineage

K1, B = 1.2, 0.75
SEGMENT, PASSAGE, SHINGLE = 64, 128, 5
THRESHOLD = 0.5
# Verified: both parts at least half there, or nearly all of the item.
PART_OVERLAP, WHOLE_OVERLAP = 0.5, 0.7
# Segments of a block; bytes of item texts in a shard, which bounds what a search carries to the tasks.
BLOCK = 32
SHARD_BYTES = 16 << 20

_ENTRIES = "item_id long, segment int, n_words long, words array<long>, counts array<long>"
_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _answer_start(text: str) -> int:
    """Where the last sentence or line begins; the end of the text where there is but one."""
    body = text.rstrip()
    cut = max(body.rfind("\n", 0, len(body) - 1), *(body.rfind(mark + " ", 0, len(body) - 1) for mark in ".!?"))
    return cut + 1 if cut > 0 else len(body)


def _shingles(words: np.ndarray) -> np.ndarray:
    if len(words) >= SHINGLE:
        return np.unique(kernel.chain(words, SHINGLE))
    return np.unique(kernel.chain(words, len(words))) if len(words) else words


def _entries(items: DataFrame) -> DataFrame:
    """One row per segment: its distinct words and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            data, offsets = kernel.text_bytes(batch.column("text"))
            starts, ends, bounds = kernel.word_spans(data, offsets)
            words = kernel.word_hashes(data, starts, ends)
            out = [[] for _ in range(5)]
            for item, a, b in zip(batch.column("item_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                for number, first in enumerate(range(a, b, SEGMENT)):
                    own = words[first : min(first + SEGMENT, b)]
                    kinds, counts = np.unique(own, return_counts=True)
                    for column, value in zip(out, (item, number, len(own), kinds.view(np.int64), counts), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _ENTRIES.split(", ")])

    return items.mapInArrow(run, _ENTRIES)


class Index:
    """Postings of one shard, with block maxima, and the shingles of its items."""

    def __init__(self, postings: list, items: list) -> None:
        entry_of: dict[tuple[int, int], int] = {}
        for row in sorted(postings, key=lambda r: (r["n_words"], r["item_id"], r["segment"])):
            entry_of.setdefault((row["item_id"], row["segment"]), len(entry_of))
        entry = np.array([entry_of[r["item_id"], r["segment"]] for r in postings], dtype=np.int64)
        word = np.array([r["word"] for r in postings], dtype=np.int64).view(np.uint64)
        weight = np.array([r["weight"] for r in postings], dtype=np.float64)
        self.items = np.array([k[0] for k in entry_of], dtype=np.int64)
        whole = np.bincount(entry, weight, minlength=len(entry_of))
        weight /= whole[entry]
        order = np.lexsort((entry, word))
        entry, word, weight = entry[order], word[order], weight[order]
        self.words, first = np.unique(word, return_index=True)
        self.edges = np.append(first, len(word))
        self.entry, self.weight = entry, weight
        self.most = np.maximum.reduceat(weight, first) if len(first) else weight
        term = np.repeat(np.arange(len(self.words)), np.diff(self.edges))
        place = term * (len(entry_of) // BLOCK + 1) + entry // BLOCK
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        self.block, self.block_most, block_term = entry[head] // BLOCK, np.maximum.reduceat(weight, head) if len(head) else weight, term[head]
        self.block_edges = np.searchsorted(block_term, np.arange(len(self.words) + 1))
        self.block_first, self.block_last = head, np.append(head[1:], len(entry)) if len(head) else head
        self.parts = {r["item_id"]: _item_parts(r["text"]) for r in items}
        self.of_gram, self.grams, self.gram_edges = self._rare_grams()
        self.by_entry: np.ndarray | None = None

    def _rare_grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items by shingle, the shingles in order, and where each begins: of each item the rarer ones, more than half."""
        items = np.array(list(self.parts), dtype=np.int64)
        sides = [side for parts in self.parts.values() for side in parts]
        gram = np.concatenate([np.zeros(0, np.uint64), *sides])
        sizes = np.array([len(q) + len(a) for q, a in self.parts.values()], dtype=np.int64)
        row = np.repeat(np.arange(len(items)), sizes)
        _, which, often = np.unique(gram, return_inverse=True, return_counts=True)
        order = np.lexsort((gram, -often[which], row))
        rank = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        kept = order[2 * (rank + 1) >= sizes[row]]
        kept = kept[np.argsort(gram[kept], kind="stable")]
        grams, first = np.unique(gram[kept], return_index=True)
        return items[row[kept]], grams, np.append(first, len(kept))

    def holding(self, doc: np.ndarray, gram: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of all items that a document may hold half of."""
        known = kernel.found_in(self.grams, gram)
        doc, at = doc[known], np.searchsorted(self.grams, gram[known])
        pair = np.unique(doc * max(len(self.grams), 1) + at)
        doc, at = pair // max(len(self.grams), 1), pair % max(len(self.grams), 1)
        counts = self.gram_edges[at + 1] - self.gram_edges[at]
        items = self.of_gram[blobs.flat(self.gram_edges[at], counts)]
        return set(zip(np.repeat(doc, counts).tolist(), items.tolist(), strict=True))

    def best_score(self, item: int, passage: np.ndarray, words: np.ndarray) -> float:
        """Largest share of a segment of the item in any of the passages."""
        if self.by_entry is None:
            self.by_entry = np.argsort(self.entry, kind="stable")
            self.entry_edges = np.searchsorted(self.entry[self.by_entry], np.arange(len(self.items) + 1))
        best = 0.0
        for entry in np.flatnonzero(self.items == item).tolist():
            posting = self.by_entry[self.entry_edges[entry] : self.entry_edges[entry + 1]]
            own = self.words[np.searchsorted(self.edges, posting, side="right") - 1]
            known = kernel.found_in(own, words)
            pair = np.unique(passage[known] * len(own) + np.searchsorted(own, words[known]))
            if len(pair):
                best = max(best, float(np.bincount(pair // len(own) - pair[0] // len(own), self.weight[posting][pair % len(own)]).max()))
        return best

    def search(self, passage: np.ndarray, words: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, entry, score) of all entries above the threshold."""
        none = np.zeros(0, dtype=np.int64)
        known = kernel.found_in(self.words, words)
        passage, term = passage[known], np.searchsorted(self.words, words[known])
        pair = np.unique(passage * len(self.words) + term)
        passage, term = pair // max(len(self.words), 1), pair % max(len(self.words), 1)
        limit = THRESHOLD - 1e-9
        hopeful = np.bincount(passage, self.most[term], minlength=passages) >= limit
        passage, term = passage[hopeful[passage]], term[hopeful[passage]]
        if not len(passage):
            return none, none, none.astype(float)
        kinds, passage = np.unique(passage, return_inverse=True)
        blocks = len(self.items) // BLOCK + 1
        counts = self.block_edges[term + 1] - self.block_edges[term]
        posting = blobs.flat(self.block_edges[term], counts)
        of = np.repeat(passage, counts)
        place, where = np.unique(of * blocks + self.block[posting], return_inverse=True)
        reached = np.bincount(where, self.block_most[posting]) >= limit
        keep = reached[where]
        posting, of = posting[keep], of[keep]
        counts = self.block_last[posting] - self.block_first[posting]
        exact = blobs.flat(self.block_first[posting], counts)
        place, where = np.unique(np.repeat(of, counts) * len(self.items) + self.entry[exact], return_inverse=True)
        score = np.bincount(where, self.weight[exact], minlength=len(place))
        hit = score >= limit
        return kinds[place[hit] // len(self.items)], place[hit] % len(self.items), score[hit]


def _item_parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the question and of the answer; a part with fewer words than a shingle counts with the other."""
    cut = _answer_start(text)
    parts = []
    for part in (text[:cut], text[cut:]):
        data, offsets = kernel.text_bytes(pa.array([part]))
        starts, ends, _ = kernel.word_spans(data, offsets)
        parts.append(kernel.word_hashes(data, starts, ends))
    if min(map(len, parts)) < SHINGLE:
        parts = [np.concatenate(parts), parts[1][:0]]
    return _shingles(parts[0]), _shingles(parts[1])


def _overlaps(parts: tuple[np.ndarray, np.ndarray], held: np.ndarray) -> tuple[float, float, float]:
    """Shares of the question's, the answer's and all shingles that are among the document's."""
    n = [int(kernel.found_in(held, p).sum()) for p in parts]
    share = [k / len(p) if len(p) else 1.0 for k, p in zip(n, parts, strict=True)]
    return share[0], share[1], sum(n) / max(1, sum(map(len, parts)))


def build_indexes(items: DataFrame) -> list[Index]:
    """The shards of the index."""
    items = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + n_bytes // SHARD_BYTES
    entries = cut_lineage(_entries(items), "bm25-entries")
    total = entries.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean")).first()
    postings = entries.select("item_id", "segment", "n_words", F.explode(F.arrays_zip("words", "counts")).alias("p")).select("item_id", "segment", "n_words", F.col("p.words").alias("word"), F.col("p.counts").alias("tf"))
    frequency = postings.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("n_words") / (total["mean"] or 1.0))
    weighted = postings.join(frequency, "word").withColumn("weight", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    weighted = cut_lineage(weighted.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))), "bm25-postings")
    of_shard = lambda df, k: df.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
    return [Index(weighted.filter(F.col("shard") == k).collect(), of_shard(items, k).collect()) for k in range(shards)]


def _search(documents: DataFrame, index: Index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            data, offsets = kernel.text_bytes(batch.column("text"))
            starts, ends, bounds = kernel.word_spans(data, offsets)
            words = kernel.word_hashes(data, starts, ends)
            row = kernel.rows_of(bounds)
            # Half passages, numbered over all rows; a passage is a half and the next one of the same row.
            half = PASSAGE // 2
            halves = -(-np.diff(bounds) // half)
            first_half = np.cumsum(halves) - halves
            of = first_half[row] + (np.arange(len(words)) - bounds[:-1][row]) // half
            owner = np.repeat(np.arange(batch.num_rows), halves)
            inner = of > first_half[row]
            in_passage, passage_words = np.concatenate([of, of[inner] - 1]), np.concatenate([words, words[inner]])
            passage, entry, score = index.search(in_passage, passage_words, int(halves.sum()))
            doc, place = owner[passage], index.items[entry]
            best: dict[tuple[int, int], float] = {}
            for d, i, s in zip(doc.tolist(), place.tolist(), score.tolist(), strict=True):
                best[d, i] = max(best.get((d, i), 0.0), s)
            within = np.flatnonzero(row[: max(0, len(words) - SHINGLE + 1)] == row[SHINGLE - 1 :])
            short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHINGLE))
            grams = [kernel.chain(words, SHINGLE)[within], *(_shingles(words[bounds[d] : bounds[d + 1]]) for d in short)]
            for pair in index.holding(np.concatenate([row[within], short]), np.concatenate(grams)):
                best.setdefault(pair, -1.0)
            held: dict[int, np.ndarray] = {}
            rows = []
            for (d, i), s in best.items():
                if d not in held:
                    held[d] = _shingles(words[bounds[d] : bounds[d + 1]])
                question, answer, whole = _overlaps(index.parts[i], held[d])
                if min(question, answer) >= PART_OVERLAP or whole >= WHOLE_OVERLAP:
                    if s < 0:
                        here = owner[in_passage] == d
                        s = index.best_score(i, in_passage[here], passage_words[here])
                    rows.append((batch.column("doc_id")[d].as_py(), i, s, question, answer))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))],
                names=[c.split()[0] for c in _FOUND.split(", ")],
            )

    return documents.mapInArrow(run, _FOUND)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair."""
    table = documents.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    found = [_search(table, index) for index in build_indexes(items)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no test item.

    The leaking ids are written first: Spark then knows their size before it plans, and shuffles whole texts only if they are many.
    """
    leaks = cut_lineage(find_leaks(documents, items).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return documents.join(leaks, documents["doc_id"].cast("long") == leaks["_leak"], "left_anti")


_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
SQL = rf"""
with items as (
    select item_id, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) as body from (select item_id, {_FOLD} as text from benchmark where item_id is not null and text is not null)
), cut as (
    select item_id, text, coalesce(nullif(length(regexp_extract(body, '^(?s:(.*(?:\n|[.!?] )).)', 1)), 0), length(body) + 1) as head from items
), parts as (
    select item_id, {_WORDS.format("left(text, head)")} as question, {_WORDS.format("substr(text, head + 1)")} as answer from cut
), sides as (
    select item_id, case when least(len(question), len(answer)) < 5 then list_concat(question, answer) else question end as question,
           case when least(len(question), len(answer)) < 5 then [] else answer end as answer from parts
), grams as (
    select distinct item_id, side, gram from (
        select item_id, side, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as gram
        from (select item_id, 'q' as side, question as w from sides union all select item_id, 'a', answer from sides))
), sizes as (
    select item_id, count(*) filter (side = 'q') as q, count(*) filter (side = 'a') as a from grams group by item_id
), words as (
    select doc_id, {_WORDS.format(_FOLD)} as w from documents where doc_id is not null
), held as (
    select distinct doc_id, unnest(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as gram from words
), shared as (
    select doc_id, item_id, count(*) filter (side = 'q') as q, count(*) filter (side = 'a') as a from held join grams using (gram) group by doc_id, item_id
)
select doc_id, item_id, s.q / n.q as question_overlap, case when n.a = 0 then 1.0 else s.a / n.a end as answer_overlap
from shared s join sizes n using (item_id)
where (s.q / n.q >= 0.5 and (n.a = 0 or s.a / n.a >= 0.5)) or (s.q + s.a) / (n.q + n.a) >= 0.7
"""


@registered("op5_decontamination", SQL)
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark")).select("doc_id", "item_id", "question_overlap", "answer_overlap")
