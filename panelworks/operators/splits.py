"""Leak-free time splits, and parameters fitted on training rows only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.functions import scaling
from panelworks.operators.ordering import SLICE_DAYS, row_positions
from panelworks.scale import attach, fetch_if_small

SPLITS = ("train", "valid", "test")


def time_positions(df: DataFrame, ts: str, keys: Sequence[str] = (), slice_days: int = SLICE_DAYS) -> DataFrame:
    """Distinct timestamps per key with their 0-based position and the number of them."""
    times = df.select(*keys, ts).filter(F.col(ts).isNotNull()).distinct()
    placed = row_positions(times, keys, ts, "_place", slice_days=slice_days)
    if not keys:
        return placed.withColumn("_times", times.agg(F.count("*")).scalar())
    return placed.join(times.groupBy(*keys).agg(F.count("*").alias("_times")), list(keys))


def split_bounds(
    df: DataFrame,
    ts: str,
    keys: Sequence[str] = (),
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """First valid and first test timestamp per key, cutting the sorted distinct timestamps.

    The cut positions are rounded half to even.
    """
    if not math.isclose(sum(ratios), 1.0):
        raise ValueError("split ratios must sum to 1")
    placed = time_positions(df, ts, keys, slice_days)
    first_valid = F.rint(F.col("_times") * F.lit(ratios[0])).cast("long")
    first_test = F.rint(F.col("_times") * F.lit(ratios[0] + ratios[1])).cast("long")
    return placed.groupBy(*keys).agg(
        F.max(F.when(F.col("_place") == first_valid, F.col(ts))).alias("valid_start"),
        F.max(F.when(F.col("_place") == first_test, F.col(ts))).alias("test_start"),
        F.max(first_valid).alias("_train_times"),
        F.max(first_test - first_valid).alias("_valid_times"),
        F.max(F.col("_times") - first_test).alias("_test_times"),
    )


def check_split_bounds(bounds: DataFrame) -> None:
    """Raise when any key has an empty train, valid or test range."""
    empty = bounds.filter("least(_train_times, _valid_times, _test_times) <= 0").limit(1).collect()
    if empty:
        raise ValueError("the time split leaves an empty train, valid or test range")


def time_split(
    df: DataFrame,
    ts: str,
    keys: Sequence[str] = (),
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    check: bool = True,
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Add ``split``: train, valid or test by the cut times of the row's key.

    The bounds hold one row per key, so they are fetched once, checked, and compared as a range
    filter; the fact table is not shuffled.
    """
    bounds = split_bounds(df, ts, keys, ratios, slice_days)
    small = fetch_if_small(bounds)
    if check:
        check_split_bounds(bounds if small is None else small)
    split = (
        F.when(F.col(ts) < F.col("valid_start"), "train")
        .when(F.col(ts) < F.col("test_start"), "valid")
        .when(F.col(ts) >= F.col("test_start"), "test")
    )
    if keys:
        side = bounds if small is None else F.broadcast(small)
        bounded = df.join(side.select(*keys, "valid_start", "test_start"), list(keys), "left")
    else:
        cut = small.first()
        bounded = df.withColumns({n: F.lit(cut[n]).cast(df.schema[ts].dataType) for n in ("valid_start", "test_start")})
    return bounded.withColumn("split", split).drop("valid_start", "test_start")


def time_blocks(
    df: DataFrame, ts: str, keys: Sequence[str] = (), blocks: int = 10, slice_days: int = SLICE_DAYS
) -> DataFrame:
    """Distinct timestamps with their block: cuts at the half-even rounded multiples of n / blocks."""
    placed = time_positions(df, ts, keys, slice_days)
    few = placed.filter(F.col("_times") < blocks).limit(1).collect()
    if few:
        raise ValueError(f"at least {blocks} distinct timestamps are needed")
    passed = [
        F.when(F.col("_place") >= F.rint(F.col("_times") * F.lit(float(b)) / F.lit(float(blocks))), 1).otherwise(0)
        for b in range(1, blocks)
    ]
    block = passed[0]
    for more in passed[1:]:
        block = block + more
    return placed.withColumn("block", block).drop("_place", "_times")


def block_split(block: Column, train_blocks: int = 8, valid_blocks: int = 1) -> Column:
    """Split name of a time block: the first blocks train, the next valid, the rest test."""
    return (
        F.when(block < train_blocks, "train").when(block < train_blocks + valid_blocks, "valid").otherwise("test")
    )


def split_summary(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last timestamp and row count per split."""
    return df.groupBy(*keys, "split").agg(
        F.min(ts).alias("start_timestamp"), F.max(ts).alias("end_timestamp"), F.count("*").alias("row_count")
    )


def check_target(df: DataFrame, target: str) -> None:
    """Raise when the target has missing or negative values."""
    value = scaling.to_number(F.col(target))
    row = df.agg(F.count_if(value.isNull()).alias("missing"), F.count_if(value < 0).alias("negative")).first()
    if row["missing"]:
        raise ValueError(f"{target} has {row['missing']} missing values")
    if row["negative"]:
        raise ValueError(f"{target} has {row['negative']} negative values and cannot be log-transformed")


def fit_target_range(df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum and maximum of log1p(target) over the training rows."""
    logged = F.log1p(F.col(target))
    return (
        df.filter("split = 'train'")
        .groupBy(*keys)
        .agg(F.min(logged).alias("target_min"), F.max(logged).alias("target_max"))
    )


def scale_target(df: DataFrame, target: str, keys: Sequence[str] = (), output: str = "scaled") -> DataFrame:
    """Add the log1p target scaled by the training range, with the range itself."""
    fitted = fit_target_range(df, target, keys)
    if keys:
        ranged = attach(df, fitted, keys)
    else:
        row = fitted.first()
        ranged = df.withColumns({n: F.lit(row[n]) for n in ("target_min", "target_max")})
    return ranged.withColumn(
        output, scaling.minmax(F.log1p(F.col(target)), F.col("target_min"), F.col("target_max"))
    )


def fit_scaler(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column over training rows, in long form.

    A mean that is not finite becomes 0, a deviation that is not finite or not positive becomes 1.
    """
    stats = []
    for name in columns:
        value = scaling.to_number(F.col(name))
        stats += [F.avg(value).alias(f"_mean_{name}"), F.stddev_pop(value).alias(f"_std_{name}")]
    wide = df.filter("split = 'train'").groupBy(*keys).agg(*stats)
    mean = [F.coalesce(scaling.finite(F.col(f"_mean_{n}")), F.lit(0.0)) for n in columns]
    std = [scaling.finite(F.col(f"_std_{n}")) for n in columns]
    entries = [
        F.struct(F.lit(n).alias("column"), m.alias("mean"), F.when(s > 0, s).otherwise(1.0).alias("std"))
        for n, m, s in zip(columns, mean, std)
    ]
    return wide.select(*keys, F.inline(F.array(*entries)))


def scaler_values(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted mean and deviation of each column: one row per column, read by the driver."""
    return {row["column"]: (row["mean"], row["std"]) for row in scaler.collect()}


def standardise(df: DataFrame, values: dict[str, tuple[float, float]], impute_first: bool = False) -> DataFrame:
    """Standardise columns with fitted values.

    By default missing values become 0 after scaling. With ``impute_first`` they take the mean before
    scaling, which leaves the same zeros but needs the deviation of the imputed column
    (see ``fit_imputed_scaler``).
    """
    scaled = {}
    for name, (mean, std) in values.items():
        value = scaling.to_number(F.col(name))
        if impute_first:
            value = F.coalesce(value, F.lit(mean))
        scaled[name] = scaling.zscore(value, F.lit(mean), F.lit(std))
    return df.withColumns(scaled)


def fit_imputed_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of the present values, and population deviation after filling the gaps with that mean."""
    entries = []
    for name in columns:
        value = scaling.to_number(F.col(name))
        # filling with the mean adds no squared deviation, it only spreads the sum over all rows
        spread = F.sqrt(F.var_pop(value) * F.count(value) / F.count("*"))
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
                F.when(spread > 0, spread).otherwise(1.0).alias("std"),
                F.coalesce(spread, F.lit(0.0)).alias("spread"),
                F.count("*").alias("row_count"),
            )
        )
    train = df.filter("split = 'train'")
    return train.agg(F.array(*entries).alias("_columns")).select(F.inline("_columns"))
