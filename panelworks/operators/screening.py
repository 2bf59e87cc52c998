"""Row screening, tolerant casts, column selection and type narrowing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.functions.scaling import percent, to_number

# Entities screened out as abnormal.
EXCLUDED_BUILDING_IDS = (803, 801, 799, 1088, 993, 794, 881, 904, 921, 927, 954, 955, 983, 1168)


def is_listed(entity: Column, ids: Iterable) -> Column:
    """Membership in a fixed list; a null id is not listed."""
    return F.coalesce(entity.isin(list(ids)), F.lit(False))


def keep_entities(df: DataFrame, meter_value, excluded: Iterable, entity="building_id", meter="meter") -> DataFrame:
    """Rows of one meter without the excluded entities; a null entity stays, a null meter goes."""
    return df.filter((F.col(meter) == F.lit(meter_value)) & ~is_listed(F.col(entity), excluded))


def excluded_rows(df: DataFrame, meter_value, excluded: Iterable, entity="building_id", meter="meter") -> DataFrame:
    """The complement: rows of one meter that belong to the excluded entities."""
    return df.filter((F.col(meter) == F.lit(meter_value)) & is_listed(F.col(entity), excluded))


def screening_report(df: DataFrame, meter_value, excluded: Iterable, entity="building_id", meter="meter") -> DataFrame:
    """Total, kept and removed rows with the kept share, in one pass."""
    kept = F.coalesce((F.col(meter) == F.lit(meter_value)) & ~is_listed(F.col(entity), excluded), F.lit(False))
    counts = df.agg(F.count("*").alias("total_rows"), F.count_if(kept).alias("kept_rows"))
    return counts.withColumn("removed_rows", F.col("total_rows") - F.col("kept_rows")).withColumn(
        "kept_percent", percent(F.col("kept_rows"), F.col("total_rows"))
    )


def tolerant_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast columns to double, with null for what is no number."""
    return df.withColumns({c: to_number(F.col(c)) for c in columns})


def year_rows(df: DataFrame, meter_value, year: int, ts="timestamp", meter="meter") -> DataFrame:
    """Rows of one meter in one calendar year, as a timestamp range so that it reaches the scan."""
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast(df.schema[ts].dataType) for y in (year, year + 1))
    return df.filter((F.col(meter) == F.lit(meter_value)) & (F.col(ts) >= start) & (F.col(ts) < end))


def feature_columns(df: DataFrame, ts="timestamp", target="meter_reading", target_first: bool = False) -> list[str]:
    """All columns but timestamp and target; sequence models take the target as first feature."""
    features = [c for c in df.columns if c not in (ts, target)]
    return [target, *features] if target_first else features


INTEGER_RANGES = (("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1))
FLOAT_LIMIT = 3.4028234663852886e38


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast whole-number columns to the smallest type that holds them and doubles to float.

    One aggregation finds every column's range.
    """
    whole = [c for c, t in df.dtypes if t in ("smallint", "int", "bigint")]
    real = [c for c, t in df.dtypes if t == "double"]
    if not whole + real:
        return df
    ranges = df.agg(
        *[f(c).alias(f"_{n}_{c}") for c in whole + real for n, f in (("min", F.min), ("max", F.max))]
    ).first()
    casts = {}
    for name in whole:
        low, high = ranges[f"_min_{name}"], ranges[f"_max_{name}"]
        if low is None:
            continue
        fitting = next((t for t, lo, hi in INTEGER_RANGES if lo <= low and high <= hi), "bigint")
        casts[name] = F.col(name).cast(fitting)
    for name in real:
        low, high = ranges[f"_min_{name}"], ranges[f"_max_{name}"]
        if low is not None and -FLOAT_LIMIT <= low and high <= FLOAT_LIMIT:
            casts[name] = F.col(name).cast("float")
    return df.withColumns(casts) if casts else df
