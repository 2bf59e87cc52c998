"""From raw tables to scaled split tables: one lazy plan for all meters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from panelworks.operators.enrich import encode_labels, engineered_features, join_buildings, join_weather, missing_flags
from panelworks.operators.screening import is_listed
from panelworks.operators.splits import check_target, scale_target, split_summary, time_split
from panelworks.scale import cut_lineage


def build_features(
    readings: DataFrame,
    buildings: DataFrame,
    weather: DataFrame,
    flag_gaps: bool = True,
    reference_year: int = 2016,
    flagged: Sequence[str] = (),
) -> DataFrame:
    """Join buildings and weather, encode the use, add engineered columns and missing-value flags.

    Columns without gaps get a flag when ``flagged`` names them, so that it is there whatever the data holds.
    The joined table is written once: finding the columns with gaps, the split bounds and the target
    range then scan a few of its columns instead of joining again.
    """
    coded = encode_labels(buildings, "primary_use")
    wide = join_weather(join_buildings(readings, coded), weather)
    featured = cut_lineage(engineered_features(wide, reference_year=reference_year), "features")
    return missing_flags(featured, always=flagged) if flag_gaps else featured


def prepare_splits(
    features: DataFrame,
    excluded: Iterable = (),
    keys: Sequence[str] = ("meter",),
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    ts: str = "timestamp",
    target: str = "meter_reading",
) -> DataFrame:
    """Screen, split by time per meter, and scale the log target by the training range of the meter.

    The scaled target replaces the reading; its range stays in ``target_min`` and ``target_max``.
    """
    kept = features.filter(F.col(keys[0]).isNotNull() & ~is_listed(F.col("building_id"), excluded))
    check_target(kept, target)
    split = time_split(kept, ts, keys, ratios)
    return scale_target(split, target, keys, output=target)


def preparation_report(prepared: DataFrame, keys: Sequence[str] = ("meter",)) -> DataFrame:
    """Rows and time range per meter and split."""
    return split_summary(prepared, "timestamp", keys)
