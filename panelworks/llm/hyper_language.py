"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. A letter triple is bound to the product of
its letters' vectors, permuted (rotated) by their place; the vector of a text is the bundle (sum) of its triples. The
prototype of a language is the bundle of all its training texts, counted in Spark per language and triple, so that only
one vector per language reaches the driver. A text gets the language whose prototype has the largest cosine with it.
All components are whole numbers, so results do not depend on how rows are spread.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no training row every text is
``und``; rows with a null lang are predicted but not learned from; a tie goes to the smaller language name; repeated
rows are predicted each for itself; a null doc_id counts as not held out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelworks.llm import kernel
from panelworks.llm.catalogue import read, registered

DIMENSIONS = 1024
UNKNOWN = "und"
# Texts of this many characters that are less like their language than this are not taken for text in it: a cosine of
# vectors that have nothing in common is about 0.03, and a few letters can't tell.
LEAST_SCORE, LEAST_LENGTH = 0.05, 50
# Texts and triples of one matrix product.
TEXT_BLOCK, TRIPLE_BLOCK = 256, 4096
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters; all code points are listed once per worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=4096)
def _letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng(code).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1


def triple_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vector of each packed letter triple, as whole numbers in float32."""
    parts = [(codes >> (_BITS * place)) & ((1 << _BITS) - 1) for place in (2, 1, 0)]
    out = np.ones((len(codes), DIMENSIONS), dtype=np.int8)
    for shift, part in zip((2, 1, 0), parts, strict=True):
        kinds, which = np.unique(part, return_inverse=True)
        out *= np.stack([np.roll(_letter_vector(int(c)), shift) for c in kinds])[which] if len(kinds) else 1
    return out.astype(np.float32)


def _triples(texts: list[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, packed triple, count) over the texts; a triple has a letter in its middle, and 0 stands for all but letters."""
    lowered = [t.lower() + " " for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = np.where(_letters()[code], code, 0)
    kinds = np.unique(code)
    # Neighbours by their rank among the letters at hand keeps the key short; blanks between texts separate them.
    rank = np.searchsorted(kinds, code) if len(kinds) > 1 else np.zeros(len(code), dtype=np.int64)
    middle = np.flatnonzero(code)
    before = np.where(middle > 0, rank[middle - 1], np.searchsorted(kinds, 0))
    base = len(kinds)
    key = (before * base + rank[middle]) * base + rank[middle + 1]
    key += np.repeat(groups, sizes)[middle] * base**3
    key, count = np.unique(key, return_counts=True)
    group, rest = np.divmod(key, base**3)
    a, rest = np.divmod(rest, base**2)
    b, c = np.divmod(rest, base)
    at = kinds.astype(np.int64)
    return group, (at[a] << (2 * _BITS)) | (at[b] << _BITS) | at[c], count


def _texts(batch: pa.RecordBatch) -> list[str]:
    return pc.fill_null(batch.column("text"), "").to_pylist()


def triple_counts(labelled: DataFrame) -> DataFrame:
    """(lang, triple, n) over all rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], int] = {}
        for batch in kernel.slices(batches, "text"):
            names = batch.column("lang").dictionary_encode()
            groups = np.asarray(names.indices, dtype=np.int64)
            kinds = names.dictionary.to_pylist()
            group, triple, count = _triples(_texts(batch), groups)
            for g, t, n in zip(group.tolist(), triple.tolist(), count.tolist(), strict=True):
                sums[kinds[g], t] = sums.get((kinds[g], t), 0) + n
            if len(sums) > 500_000:
                yield _count_rows(sums)
                sums = {}
        yield _count_rows(sums)

    partial = labelled.select("lang", "text").mapInArrow(run, "lang string, triple long, n long")
    return partial.groupBy("lang", "triple").agg(F.sum("n").alias("n"))


def _count_rows(sums: dict[tuple[str, int], int]) -> pa.RecordBatch:
    return kernel.record_batch(lang=pa.array([k[0] for k in sums], pa.string()), triple=pa.array([k[1] for k in sums], pa.int64()), n=pa.array(list(sums.values()), pa.int64()))


def prototypes(counts: DataFrame) -> dict[str, np.ndarray]:
    """One bundled vector per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            triple, n = np.asarray(batch.column("triple")), np.asarray(batch.column("n"))
            for name in set(lang):
                own = np.flatnonzero(lang == name)
                total = bundles.setdefault(name, np.zeros(DIMENSIONS, dtype=np.int64))
                for first in range(0, len(own), TRIPLE_BLOCK):
                    part = own[first : first + TRIPLE_BLOCK]
                    total += (n[part].astype(np.float64) @ triple_vectors(triple[part]).astype(np.float64)).astype(np.int64)
        for name, total in bundles.items():
            yield kernel.record_batch(lang=pa.array([name] * DIMENSIONS, pa.string()), dimension=pa.array(np.arange(DIMENSIONS, dtype=np.int32)), value=pa.array(total))

    rows = counts.mapInArrow(run, "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value")).collect()
    found: dict[str, np.ndarray] = {}
    for row in rows:
        found.setdefault(row["lang"], np.zeros(DIMENSIONS, dtype=np.int64))[row["dimension"]] = row["value"]
    return dict(sorted(found.items()))


def text_vectors(texts: list[str]) -> np.ndarray:
    """The bundle of every text."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for first in range(0, len(texts), TEXT_BLOCK):
        some = texts[first : first + TEXT_BLOCK]
        row, triple, count = _triples(some, np.arange(len(some)))
        kinds, which = np.unique(triple, return_inverse=True)
        for a in range(0, len(kinds), TRIPLE_BLOCK):
            here = (which >= a) & (which < a + TRIPLE_BLOCK)
            dense = np.zeros((len(some), min(TRIPLE_BLOCK, len(kinds) - a)), dtype=np.float32)
            dense[row[here], which[here] - a] = count[here]
            out[first : first + len(some)] += dense @ triple_vectors(kinds[a : a + TRIPLE_BLOCK])
    return out


def _predictor(model: dict[str, np.ndarray]) -> Callable[[list[str]], tuple[list[str], np.ndarray]]:
    names = [*model, UNKNOWN]
    matrix = np.stack([v / max(np.linalg.norm(v), 1e-300) for v in model.values()]) if model else np.zeros((0, DIMENSIONS))

    def predict(texts: list[str]) -> tuple[list[str], np.ndarray]:
        vectors = text_vectors(texts).astype(np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        if not len(matrix):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = vectors @ matrix.T / np.maximum(norms, 1e-300)[:, None]
        best = np.where(norms > 0, cosine.argmax(axis=1), len(matrix))
        score = np.where(norms > 0, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0)
        return [names[b] for b in best], score

    return predict


def predict(
    documents: DataFrame, model: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """The columns ``keep`` of every row with the predicted language and its score, under ``names``."""
    guess = _predictor(model)
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            found, score = guess(_texts(batch))
            columns = {c: batch.column(c) for c in keep} | dict(zip(names, (pa.array(found, pa.string()), pa.array(score)), strict=True))
            yield kernel.record_batch(**columns)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{names[0]} string, {names[1]} double"])
    return documents.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)


def remainder_is(divisor: int, value: int) -> Column:
    """Whether crc32(doc_id as text) leaves ``value``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor == value, F.lit(False))


def learn(documents: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from all labelled rows that are not held out."""
    return prototypes(triple_counts(documents.filter(~remainder_is(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())))


@registered("op3_hyper_language")
def op3_hyper_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    found = predict(documents, learn(documents))
    return found.select("doc_id", remainder_is(4, 2).alias("held_out"), "lang_pred", "score")


def in_known_language(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents whose text is recognised; a missing lang is filled in."""
    found = predict(documents, learn(documents), tuple(documents.columns), ("_lang_pred", "_lang_score"))
    foreign = (F.col("_lang_score") < least_score) & (F.length("text") >= LEAST_LENGTH)
    known = found.filter((F.col("_lang_pred") != UNKNOWN) & ~foreign)
    return known.withColumn("lang", F.coalesce("lang", "_lang_pred")).select(*documents.columns)
