"""Historical profile: grouped means of the training rows with an ordered fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from panelworks.scale import attach, cut_lineage

LEVELS = ("building_meter_weekday_hour", "building_meter_hour", "meter_weekday_hour", "global_mean")


@dataclass
class HistoricalProfile:
    """Fitted means. ``by_hour`` has one row per entity, meter and hour: its mean and a map of weekday means."""

    by_hour: DataFrame
    by_weekday_hour: DataFrame
    overall: DataFrame


def fit_profile(
    train: DataFrame,
    target: str = "meter_reading",
    entity: str = "building_id",
    meter: str = "meter",
    weekday: str = "day_week",
    hour: str = "hour_datetime",
) -> HistoricalProfile:
    """One aggregation of the training rows; the coarser levels roll its sums up.

    The sums feed three tables, so they are written once instead of being recomputed.
    """
    sums = train.groupBy(entity, meter, weekday, hour).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    finest = cut_lineage(sums, "profile")
    mean = F.sum("_sum") / F.sum("_n")
    weekday_means = F.map_from_entries(F.collect_list(F.struct(F.col(weekday), F.col("_sum") / F.col("_n"))))
    return HistoricalProfile(
        by_hour=finest.groupBy(entity, meter, hour).agg(
            mean.alias("_hour_mean"), weekday_means.alias("_weekday_means")
        ),
        by_weekday_hour=finest.groupBy(meter, weekday, hour).agg(mean.alias("_shared_mean")),
        overall=finest.agg(mean.alias("_mean")),
    )


def predict_profile(
    profile: HistoricalProfile,
    rows: DataFrame,
    entity: str = "building_id",
    meter: str = "meter",
    weekday: str = "day_week",
    hour: str = "hour_datetime",
) -> DataFrame:
    """Add ``prediction`` and ``level``: the first of the four levels that knows the row."""
    known = rows.join(profile.by_hour, [entity, meter, hour], "left")
    known = attach(known, profile.by_weekday_hour, [meter, weekday, hour])
    exact = F.try_element_at("_weekday_means", F.col(weekday))
    means = [exact, F.col("_hour_mean"), F.col("_shared_mean")]
    level = F.when(means[0].isNotNull(), LEVELS[0])
    for name, value in zip(LEVELS[1:], means[1:]):
        level = level.when(value.isNotNull(), name)
    return (
        known.withColumn("prediction", F.coalesce(*means, profile.overall.scalar()))
        .withColumn("level", level.otherwise(LEVELS[3]))
        .drop("_weekday_means", "_hour_mean", "_shared_mean")
    )
