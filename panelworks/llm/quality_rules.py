"""Quality rules whose limits come from the corpus itself.

Every document gets a few counts of its whole text. Ratios of these counts are summarised per language and source by
mergeable logarithmic histograms (quantile sketches of bounded relative error): a sketch is a set of (bin, count) rows,
and merging is a sum, so a hot source is summed before the shuffle and the result does not depend on the order of rows.
Each limit is a fence beyond the upper quartile of the document's own group, drawn towards that of its language, and this
towards that of all, the more the fewer documents there are: of n documents the own fence counts n / (n + PRIOR). Documents
are then joined with the limits of their group.

Defined cases: a null or empty text has no words and fails the base rule; null language or source is a group of its own;
repeated rows are judged each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelworks.llm import kernel
from panelworks.llm.catalogue import read, registered
from panelworks.scale import cut_lineage

WINDOW = 5
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

# Share of one bin's width; a quantile is off by half of that at most.
BIN_WIDTH = 0.05
# Ratios below this count as zero.
SMALLEST = 1e-4
# Documents with which a group's own fence counts as much as the coarser one.
PRIOR = 200
# Quartile distances above the upper quartile, and the least distance per ratio.
FENCE = 4.0
LEAST_DISTANCE = {"symbol_ratio": 0.05, "duplicate_line_ratio": 0.1, "repeat_ratio": 0.04, "word_length": 1.0}
RATIOS = tuple(LEAST_DISTANCE)

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, offsets = kernel.text_bytes(batch.column("text"))
    starts, ends, bounds = kernel.word_spans(data, offsets)
    owner = kernel.rows_of(bounds)
    n_words = np.diff(bounds)
    visible = kernel.SOLID[data] & ((data & 0xC0) != 0x80)

    # Lines: a row has one more than it has line feeds.
    feeds = np.flatnonzero(data == 10)
    line_ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    line_bounds = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    line_owner = kernel.rows_of(line_bounds)
    line_starts = np.empty_like(line_ends)
    line_starts[1:] = line_ends[:-1] + 1
    heads = line_bounds[:-1]
    line_starts[heads] = offsets[:-1]
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    sums = kernel.prefix_sums(data)
    lines = kernel.span_hashes(sums, line_starts[filled], line_ends[filled])
    line_owner = line_owner[filled]
    n_lines = np.bincount(line_owner, minlength=len(n_words))
    lines = lines ^ kernel.mix(line_owner.astype(np.uint64) + np.uint64(1))
    distinct = line_owner[np.unique(lines, return_index=True)[1]]
    n_dup = n_lines - np.bincount(distinct, minlength=len(n_words))

    words = kernel.span_hashes(sums, starts, ends)
    windows = kernel.chain(words, WINDOW)
    if len(windows):
        inside = owner[: len(windows)] == owner[WINDOW - 1 :]
        windows = windows ^ kernel.mix(owner[: len(windows)].astype(np.uint64) + np.uint64(1))
        hit = np.flatnonzero(inside)[kernel.repeated(windows[inside])]
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edges, hit, 1)
        np.add.at(edges, hit + WINDOW, -1)
        n_repeat = kernel.sums_within(np.cumsum(edges[:-1]) > 0, bounds)
    else:
        n_repeat = np.zeros(len(n_words), dtype=np.int64)
    return {
        "n_words": n_words,
        "word_chars": kernel.sums_within(visible, offsets),
        "n_symbols": kernel.sums_within(SYMBOLS[data], offsets),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
    }


def text_counts(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every whole text, with the columns ``keep`` of its row."""
    kinds = dict(documents.dtypes)
    schema = ", ".join([COUNTS, *(f"{c} {kinds[c]}" for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches, "text"):
            counts = {k: pa.array(v, pa.int64()) for k, v in _counts(batch).items()}
            yield kernel.record_batch(doc_id=batch.column("doc_id"), **counts, **{c: batch.column(c) for c in keep})

    return documents.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, schema)


def _ratio(name: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "duplicate_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }[name]


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bin, n): one mergeable quantile sketch per group and ratio."""
    value = F.col("item.value")
    bins = F.when(value < SMALLEST, F.lit(None)).otherwise(F.floor(F.log(value) / BIN_WIDTH)).cast("int")
    items = F.array(*(F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("value")) for r in RATIOS))
    return (
        counts.filter("n_words > 0")
        .select(*groups, F.explode(items).alias("item"))
        .groupBy(*groups, F.col("item.ratio").alias("ratio"), bins.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*groups, "ratio", "bin").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Upper fence per group: (groups, n_documents, one column per ratio). A sketch has few bins, so a group is short."""

    def quantile(share: float) -> Column:
        # The first bin, in ascending order, at which the running count reaches the share.
        state = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value")),
            lambda s, b: F.struct(
                (s["seen"] + b["n"]).alias("seen"),
                F.when(s["value"].isNotNull(), s["value"])
                .when(s["seen"] + b["n"] >= F.col("total") * share, F.coalesce(F.exp((b["bin"] + 0.5) * BIN_WIDTH), F.lit(0.0)))
                .alias("value"),
            ),
        )
        return state["value"]

    least = F.create_map(*(F.lit(x) for pair in LEAST_DISTANCE.items() for x in pair))
    fence = F.col("upper") + FENCE * F.greatest(F.col("upper") - F.col("lower"), least[F.col("ratio")])
    return (
        sketch.groupBy(*groups, "ratio")
        .agg(F.array_sort(F.collect_list(F.struct("bin", "n")), lambda a, b: F.coalesce(a["bin"], F.lit(-(10**6))) - F.coalesce(b["bin"], F.lit(-(10**6)))).alias("bins"), F.sum("n").alias("total"))
        .select(*groups, "ratio", "total", quantile(0.25).alias("lower"), quantile(0.75).alias("upper"))
        .groupBy(*groups)
        .agg(F.max("total").alias("n_documents"), *(F.max(F.when(F.col("ratio") == r, fence)).alias(r) for r in RATIOS))
    )


def adaptive_limits(counts: DataFrame) -> DataFrame:
    """Limits of every (lang, source): its own fences and those of its language and of all, weighed by their documents."""
    fine = cut_lineage(sketches(counts, ["lang", "source"]), "quality-sketch")
    own = limits(fine, ["lang", "source"])
    of_lang = limits(merged(fine, ["lang"]), ["lang"])
    of_all = limits(merged(fine, []), []).first()  # a handful of numbers
    rename = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in df.columns])
    joined = own.join(rename(of_lang, "l"), F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    blend = lambda n, own, coarser: (n * own + PRIOR * coarser) / (n + PRIOR)
    pick = lambda r: blend(F.col("n_documents"), F.col(r), blend(F.col("l_n_documents"), F.col(f"l_{r}"), F.lit(of_all[r]).cast("double")))
    return joined.select("lang", "source", *(pick(r).alias(f"{r}_limit") for r in RATIOS))


def judge(documents: DataFrame) -> DataFrame:
    """Counts and verdict of every document; columns: those of COUNTS, base_failed, kept, and the limits."""
    counts = cut_lineage(text_counts(documents, ("lang", "source")), "quality-counts")
    bounds = adaptive_limits(counts).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *(f"{r}_limit" for r in RATIOS))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = [_ratio(r) <= F.col(f"{r}_limit") for r in RATIOS]
    verdict = within[0]
    for other in within[1:]:
        verdict = verdict & other
    return (
        counts.join(bounds, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & F.coalesce(verdict, F.lit(True)))
        .drop("of_lang", "of_source")
    )


@registered("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"{r}_limit" for r in RATIOS)
    )
