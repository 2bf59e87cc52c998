"""Table profiles, daily peaks, distributions and other grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelworks.functions.bins import equal_width_bin
from panelworks.functions.calendar import floor_day
from panelworks.functions.scaling import percent, to_number
from panelworks.scale import attach, cut_lineage


def daily_totals(df: DataFrame, keys: Sequence[str], ts="timestamp", value="meter_reading") -> DataFrame:
    """Sum per day and key."""
    return df.groupBy(F.to_date(ts).alias("date"), *keys).agg(F.sum(value).alias(value))


def daily_maxima(df: DataFrame, keys: Sequence[str] = ("building_id",), ts="timestamp", value="meter_reading") -> DataFrame:
    """Largest reading per day and key."""
    return df.groupBy(floor_day(F.col(ts)).alias("date"), *keys).agg(F.max(value).alias(value))


def peak_holders(daily: DataFrame, groups: Sequence[str], entity="building_id", value="meter_reading") -> DataFrame:
    """The entity with the largest value per group; the smallest id wins a tie."""
    best = F.max_by(F.struct(entity, value), F.struct(F.col(value), -F.col(entity)))
    return daily.groupBy(*groups).agg(best.alias("_best")).select(*groups, "_best.*")


def daily_overview(
    daily: DataFrame, groups: Sequence[str] = ("date", "meter"), entity="building_id", value="meter_reading"
) -> DataFrame:
    """Sum, mean, largest value and its holder per day and meter."""
    top = F.max(F.struct(F.col(value), (-F.col(entity)).alias("minus_id")))
    return (
        daily.groupBy(*groups)
        .agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), top.alias("_top"))
        .select(
            *groups, "total", "mean",
            (-F.col("_top.minus_id")).alias("peak_holder"), F.col(f"_top.{value}").alias("peak"),
        )
    )


def peak_holder_days(overview: DataFrame, groups: Sequence[str] = ("meter",)) -> DataFrame:
    """On how many days each entity held the peak."""
    return overview.groupBy(*groups, "peak_holder").agg(F.count("*").alias("days"))


def series_summary(series: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Maximum, mean, exact median and their ratio, for series of one row per day."""
    return (
        series.groupBy(*groups)
        .agg(F.max(value).alias("max"), F.avg(value).alias("mean"), F.median(value).alias("median"))
        .withColumn("ratio", F.try_divide("max", "median"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values per column, exact unless asked otherwise."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(c) for c in columns])


def missing_summary(df: DataFrame, top: int | None = None) -> DataFrame:
    """Missing values per column with their share, largest first."""
    names = df.columns
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    long = counts.unpivot(["_rows"], names, "column", "missing_count")
    summary = long.select(
        "column", "missing_count", percent(F.col("missing_count"), F.col("_rows"), 4).alias("missing_percent")
    ).orderBy(F.desc("missing_count"), "column")
    return summary.limit(top) if top else summary


def table_profile(
    df: DataFrame, groups: Sequence[str] = (), entity="building_id", ts="timestamp", value="meter_reading"
) -> DataFrame:
    """Rows, entities, time range and reading statistics in one pass."""
    reading = to_number(F.col(value))
    return df.groupBy(*groups).agg(
        F.count("*").alias("row_count"),
        F.count_distinct(entity).alias("building_count"),
        F.min(ts).alias("start_timestamp"),
        F.max(ts).alias("end_timestamp"),
        F.min(reading).alias("reading_min"),
        F.max(reading).alias("reading_max"),
        (F.sum(reading) / F.count("*")).alias("reading_mean"),
    )


def value_distribution(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """Most frequent values with their share of all rows; ties in value order."""
    total = df.agg(F.count("*")).scalar()
    counted = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("row_count"))
        .withColumn("percent", percent(F.col("row_count"), total))
        .orderBy(F.desc("row_count"), column)
    )
    return counted.limit(top) if top else counted


def row_flow(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count after each stage."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(i).alias("step"), F.lit(label).alias("stage"), "row_count")
        for i, (label, df) in enumerate(stages.items())
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def zero_rates(df: DataFrame, groups: Sequence[str], target="meter_reading") -> DataFrame:
    """Share of readings at or below zero."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("row_count"), F.avg((F.col(target) <= 0).cast("double")).alias("zero_rate")
    )


def correlations_with(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with the target, skipping pairs with a null."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column", "correlation").orderBy("correlation", "column")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair of columns, from one aggregation."""
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    entries = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.corr(a, b).alias("correlation"))
        for a, b in pairs
    ]
    half = df.agg(F.array(*entries).alias("_pairs")).select(F.inline("_pairs"))
    mirrored = half.filter("column_a <> column_b").select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation"
    )
    return half.unionByName(mirrored)


def histogram(df: DataFrame, column: str, bins: int = 25, groups: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the range of the whole table; the last bin is closed."""
    value = df.select(*groups, F.col(column).alias("_value")).filter("_value IS NOT NULL")
    span = value.agg(F.struct(F.min("_value").alias("low"), F.max("_value").alias("high"))).scalar()
    return (
        value.withColumn("bin", equal_width_bin(F.col("_value"), span["low"], span["high"], bins))
        .groupBy(*groups, "bin")
        .agg(F.count("*").alias("row_count"))
    )


def totals_by_timestamp(df: DataFrame, ts="timestamp", value="meter_reading", groups: Sequence[str] = ()) -> DataFrame:
    """Sum and mean over all series per timestamp."""
    return df.groupBy(*groups, ts).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))


def string_cardinality(df: DataFrame) -> DataFrame:
    """Distinct values per text column."""
    names = [c for c, t in df.dtypes if t == "string"]
    return df.agg(*[F.count_distinct(c).alias(c) for c in names]).unpivot([], names, "column", "distinct_count")


def rank_importance(importances: DataFrame, top: int | None = 12) -> DataFrame:
    """Mean importance per feature, largest first, with its width in percent of the largest."""
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    largest = mean.agg(F.max("importance")).scalar()
    ranked = mean.withColumn("width_percent", percent(F.col("importance"), largest)).orderBy(
        F.desc("importance"), "feature"
    )
    return ranked.limit(top) if top else ranked


def top_rows(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """The first n rows in the given total order."""
    return df.orderBy(*order).limit(n)


def exact_median(df: DataFrame, column: str, groups: Sequence[str] = (), most: int = 10_000, ranges: int = 4096) -> DataFrame:
    """Exact interpolated median of finite numbers per group, by selection: no group is ever ordered as a whole.

    A group is cut into ``ranges`` ranges of equal width; their counts, summed before the shuffle, tell the range that holds the
    middle, and only that is cut again, until it has at most ``most`` rows or one value. Those rows alone are ranked. Each
    step reads the table once; 10^9 rows need two steps, and no table of doubles more than six.
    """
    groups = list(groups)
    keys = groups or ["_all"]
    value = df.select(*groups, F.col(column).alias("_v")).filter("_v IS NOT NULL")
    value = value if groups else value.withColumn("_all", F.lit(0))
    whole = value.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    bounds = cut_lineage(whole.withColumns({"_below": F.lit(0).cast("bigint"), "_inside": F.col("_n")}), "median-bounds")
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    is_open = (F.col("_inside") > most) & (F.col("_low") < F.col("_high"))
    while not bounds.filter(is_open).isEmpty():
        inside = attach(value, bounds.filter(is_open), keys, "inner").filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        # Halves, so that the width of no range overflows.
        share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        counted = inside.groupBy(*keys, "_n", "_below", F.least(F.floor(share * ranges), F.lit(ranges - 1)).alias("_range")).agg(
            F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last")
        )
        in_order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counted.withColumn("_upto", F.sum("_c").over(in_order) + F.col("_below"))
        holding = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.struct("_range", "_upto", "_c", "_first", "_last")))
        found = ranked.groupBy(*keys, "_n").agg(holding(lower).alias("_a"), holding(upper).alias("_b"))
        # In two ranges the middle is the last value of one and the first of the other.
        apart = F.col("_a._range") < F.col("_b._range")
        narrowed = found.select(
            *keys, "_n",
            F.when(apart, F.col("_a._last")).otherwise(F.col("_a._first")).alias("_low"),
            F.when(apart, F.col("_b._first")).otherwise(F.col("_a._last")).alias("_high"),
            (F.col("_a._upto") - F.col("_a._c")).alias("_below"), F.when(apart, 0).otherwise(F.col("_a._c")).cast("bigint").alias("_inside"),
        )
        bounds = cut_lineage(bounds.filter(~is_open).unionByName(narrowed), "median-bounds")
    # Known already: both middle values, or the only one.
    known = bounds.filter((F.col("_inside") == 0) | (F.col("_low") == F.col("_high"))).select(*groups, ((F.col("_low") + F.col("_high")) / 2).cast("double").alias("median"))
    rest = bounds.filter((F.col("_inside") > 0) & (F.col("_low") < F.col("_high")))
    few = attach(value, rest, keys, "inner").filter(F.col("_v").between(F.col("_low"), F.col("_high"))).groupBy(*keys, "_n", "_below", "_v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = few.withColumn("_upto", F.sum("_c").over(upto) + F.col("_below"))
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    middle = placed.groupBy(*keys, "_n").agg(((at(lower) + at(upper)) / 2).cast("double").alias("median"))
    return known.unionByName(middle.select(*groups, "median"))


def fill_with_median(df: DataFrame, columns: Sequence[str], default: float) -> DataFrame:
    """Replace nulls by the column's median, or by a default when no value is known; one search for all columns."""
    columns = list(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    middles = exact_median(numbers.unpivot([], columns, "_column", "_number"), "_number", ["_column"])
    known = {row["_column"]: row["median"] for row in middles.collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(float(known.get(c, default)))) for c in columns}
    )


def labelled_union(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Stack tables of the same columns, each marked with its name."""
    marked = [df.select(F.lit(name).alias(label), *df.columns) for name, df in parts.items()]
    result = marked[0]
    for more in marked[1:]:
        result = result.unionByName(more)
    return result
