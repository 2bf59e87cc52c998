"""Smallest set of entities to remove so that the daily peak series becomes even, for every key at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelworks.operators.summaries import peak_holders
from panelworks.scale import attach, cut_lineage

# Bits of a set that one number holds.
BITS = 60


def frequent_holders(daily: DataFrame, top: int = 12, keys: Sequence[str] = (), entity="building_id", value="meter_reading") -> DataFrame:
    """Per key the entities that hold the daily peak most often; ties in id order."""
    held = peak_holders(daily, [*keys, "date"], entity, value).groupBy(*keys, entity).agg(F.count("*").alias("_days"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_days"), entity))
    return held.withColumn("_place", place).filter(F.col("_place") <= top).select(*keys, entity)


def candidate_set(
    daily: DataFrame,
    peak_limit: float | None = None,
    top_holders: int = 12,
    keys: Sequence[str] = (),
    entity="building_id",
    value="meter_reading",
    peak_share: float | None = None,
) -> DataFrame:
    """Per key the entities that ever exceed a limit, united with those that hold the daily peak most often.

    The limit is ``peak_limit``, or ``peak_share`` times the median of the key's daily peaks.
    """
    keys = list(keys)
    chosen = frequent_holders(daily, top_holders, keys, entity, value)
    if peak_limit is not None:
        chosen = chosen.union(daily.filter(F.col(value) > peak_limit).select(*keys, entity))
    if peak_share is not None:
        peaks = daily.groupBy(*keys, "date").agg(F.max(value).alias("_peak")).groupBy(*keys).agg((peak_share * F.median("_peak")).alias("_limit"))
        limited = attach(daily, peaks, keys, "inner") if keys else daily.withColumn("_limit", peaks.scalar())
        chosen = chosen.union(limited.filter(F.col(value) > F.col("_limit")).select(*keys, entity))
    return chosen.distinct()


def _same(keys: Sequence[str]) -> list[str]:
    """Keys to join on; without any, all rows are of one."""
    return list(keys) or ["_all"]


def _numbered(candidates: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Candidates with their position in id order, per key."""
    return candidates.withColumn("_position", F.row_number().over(Window.partitionBy(*keys).orderBy(entity)) - 1)


def ranked_days(daily: DataFrame, numbered: DataFrame, keys: Sequence[str], entity="building_id", value="meter_reading") -> DataFrame:
    """Per key and day the best value that stays, and the removable ones above it: the ranked list as far as it can matter."""
    placed = attach(daily, numbered, [*keys, entity])
    best = placed.groupBy(*keys, "date").agg(
        F.max(F.when(F.col("_position").isNull(), F.col(value))).alias("rest"),
        F.collect_list(F.when(F.col("_position").isNotNull(), F.struct(F.col(value).alias("value"), F.col("_position").alias("position")))).alias("_held"),
    )
    return best.select(*keys, "date", "rest", F.filter("_held", lambda e: F.col("rest").isNull() | (e["value"] > F.col("rest"))).alias("removable"))


def _holds(words: Column, position: Column) -> Column:
    """Whether a set, BITS positions to a number, holds a position."""
    word = F.get(words, F.floor(position / BITS).cast("int"))
    return F.call_function("shiftright", word, (position % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1


def _with(words: Column, position: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % BITS).cast("int"))
    return F.transform(words, lambda w, i: F.when(i == F.floor(position / BITS), w.bitwiseOR(bit)).otherwise(w))


def evaluate_removals(sets: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Max, mean, median and max / median of the daily peaks that each set of positions leaves.

    ``days`` as ``ranked_days`` gives them. Sets meet the days of their key in a join and are summed up per set; days on
    which nothing is left do not count.
    """
    left = F.filter("removable", lambda e: ~_holds(F.col("words"), e["position"]))
    peak = F.greatest("rest", F.array_max(F.transform(left, lambda e: e["value"])))
    each = attach(sets, days, keys, "inner").select(*keys, "words", "last", peak.alias("_peak"))
    return (
        each.groupBy(*keys, "words", "last")
        .agg(F.max("_peak").alias("max"), F.avg("_peak").alias("mean"), F.median("_peak").alias("median"))
        .withColumn("ratio", F.try_divide("max", "median"))
    )


def minimal_removal(
    daily: DataFrame,
    candidates: DataFrame,
    ratio_limit: float = 2.0,
    keys: Sequence[str] = (),
    entity: str = "building_id",
    value: str = "meter_reading",
) -> tuple[DataFrame, DataFrame]:
    """Per key, all smallest removals that bring max / median to the limit, and the log of the search.

    ``candidates`` has one row per key and entity. Sizes are tried upwards, all keys together; a key ends at its first size
    with a solution, the whole search when no key is open. Sets are bit sets that grow by later positions only. Removing more
    never lowers the peak below the best value that always stays, nor raises the median, so a set for which that value over
    its median exceeds the limit is not extended (unless some day has nothing that stays).

    Solutions: keys, ``removed`` (sorted), max, mean, median, ratio. Log: keys, remove_count, combinations (all of that size),
    scored (those not ruled out), solutions.
    """
    plain, keys = list(keys), _same(keys)
    if not plain:
        daily, candidates = daily.withColumn("_all", F.lit(0)), candidates.withColumn("_all", F.lit(0))
    numbered = cut_lineage(_numbered(candidates, keys, entity), "removal-candidates")
    names = numbered.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_position", entity))), lambda c: c[entity]).alias("_names"))
    days = cut_lineage(ranked_days(daily, numbered, keys, entity, value), "removal-days")
    facts = days.groupBy(*keys).agg(F.when(F.count("rest") == F.count("*"), F.max("rest")).alias("_floor"))
    facts = cut_lineage(facts.join(names, keys, "left").select(*keys, "_floor", F.coalesce("_names", F.array().cast(names.schema["_names"].dataType)).alias("_names")), "removal-facts")
    size = F.size("_names")
    level = facts.select(*keys, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.ceil(size / BITS).cast("int"), F.lit(1))).alias("words"), F.lit(-1).alias("last"))
    scored_levels, logs = [], []
    count = 0
    while True:
        scored = cut_lineage(evaluate_removals(level, days, keys), "removal-level")
        solved = scored.filter(F.col("ratio") <= ratio_limit)
        scored_levels.append(solved)
        # The factors of n over k, in an order that keeps every step whole.
        combinations = F.aggregate(F.sequence(F.lit(1), F.lit(count)), F.lit(1).cast("decimal(38,0)"), lambda c, i: F.call_function("div", c * (size - i + 1), i).cast("decimal(38,0)")) if count else F.lit(1).cast("decimal(38,0)")
        logs.append(
            scored.groupBy(*keys).agg(F.count("*").alias("scored"), F.count_if(F.col("ratio") <= ratio_limit).alias("solutions")).join(facts, keys)
            .select(*plain, F.lit(count).cast("bigint").alias("remove_count"), combinations.cast("bigint").alias("combinations"), "scored", "solutions")
        )
        hopeful = F.col("_floor").isNull() | F.coalesce(F.col("_floor") / F.col("median") <= ratio_limit, F.lit(True))
        open_ = scored.join(solved.select(*keys).distinct(), keys, "left_anti").join(facts, keys).filter(hopeful & (F.col("last") + 1 < size))
        if open_.isEmpty():
            break
        grown = open_.select(*keys, "words", F.explode(F.sequence(F.col("last") + 1, size - 1)).alias("last"))
        level = grown.select(*keys, _with(F.col("words"), F.col("last")).alias("words"), "last")
        count += 1
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    held = F.filter("_names", lambda _, i: _holds(F.col("words"), i))
    solutions = union(scored_levels).join(facts, keys).select(*plain, held.alias("removed"), "max", "mean", "median", "ratio")
    return solutions, union(logs)


def best_removal(solutions: DataFrame, keys: Sequence[str] = (), entity: str = "building_id") -> DataFrame:
    """Per key the entities of the best solution, by ratio, max, mean and then ids."""
    best = F.min_by("removed", F.struct("ratio", "max", "mean", "removed"))
    return solutions.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.explode("_best").alias(entity))


def removal_impact(df: DataFrame, removed: DataFrame, keys: Sequence[str] = (), entity: str = "building_id") -> DataFrame:
    """Rows that removing each entity of ``removed`` (keys, entity) deletes."""
    return attach(df, removed, [*keys, entity], "left_semi").groupBy(*keys, entity).agg(F.count("*").alias("rows_to_delete"))


def compare_removals(
    df: DataFrame, schemes: dict[str, Sequence], entity="building_id", ts="timestamp", value="meter_reading", keys: Sequence[str] = ()
) -> DataFrame:
    """Daily-peak summary and rows removed per key and scheme, all from one scan of the readings."""
    daily = df.groupBy(*keys, F.to_date(ts).alias("date"), entity).agg(
        F.max(value).alias(value), F.count("*").alias("_rows")
    )
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("scheme"), F.array(*[F.lit(i) for i in ids]).cast("array<bigint>").alias("ids"))
            for name, ids in schemes.items()
        ]
    )
    # the readings were reduced to one row per day and entity before they are repeated per scheme
    each = daily.select("*", F.inline(entries)).withColumn("_gone", F.array_contains("ids", F.col(entity)))
    by_day = each.groupBy(*keys, "scheme", "date").agg(
        F.max(F.when(~F.col("_gone"), F.col(value))).alias("_peak"),
        F.sum(F.when(F.col("_gone"), F.col("_rows")).otherwise(0)).alias("_removed"),
    )
    return (
        by_day.groupBy(*keys, "scheme")
        .agg(
            F.sum("_removed").alias("removed_rows"),
            F.max("_peak").alias("max"),
            F.avg("_peak").alias("mean"),
            F.median("_peak").alias("median"),
        )
        .withColumn("ratio", F.try_divide("max", "median"))
    )
