"""Dimension joins, dictionary codes, missing-value flags and panel completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelworks.functions.bins import beaufort_number, compass_sector
from panelworks.functions.calendar import calendar_columns
from panelworks.operators.ordering import SLICE_DAYS, row_positions
from panelworks.scale import BROADCAST_ROW_LIMIT, attach, cut_lineage

# Numbers of timestamps that are ordered together when gaps are looked for.
GAP_POSITIONS = 4096


def join_buildings(readings: DataFrame, buildings: DataFrame, entity: str = "building_id") -> DataFrame:
    """Left join of the building attributes.

    No hint is given: Spark broadcasts the dimension when the size of its files allows it, else it
    shuffles and splits skewed partitions of the readings.
    """
    return readings.join(buildings, entity, "left")


def join_weather(readings: DataFrame, weather: DataFrame, site: str = "site_id", ts: str = "timestamp") -> DataFrame:
    """Left join of the site weather of the same hour."""
    return readings.join(weather, [site, ts], "left")


def value_codes(df: DataFrame, column: str, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Distinct non-null values with their 0-based place in sort order.

    A short list is ranked in one task. A long one is range-partitioned by the sort, written once,
    and numbered by partition offset, so no task sees the whole list.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if len(values.limit(row_limit + 1).collect()) <= row_limit:
        return values.withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)
    ordered = cut_lineage(values.orderBy(column).withColumn("_seq", F.monotonically_increasing_id()), "codes")
    part, local = F.shiftright("_seq", 33), F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.select(column, part.alias("_part"), local.alias("_local"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    return attach(placed, offsets, ["_part"]).select(column, (F.col("_local") + F.col("_before")).alias("code"))


def encode_labels(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Replace a text column by its place among the sorted distinct values; null stays null."""
    output = output or column
    codes = value_codes(df, column)
    coded = attach(df, codes, [column])
    kept = [F.col("code").alias(output) if c == output else F.col(c) for c in df.columns]
    return coded.select(*kept, *([] if output in df.columns else [F.col("code").alias(output)]))


def engineered_features(df: DataFrame, ts: str = "timestamp", reference_year: int = 2016) -> DataFrame:
    """Age, Beaufort number, compass sector and the calendar columns, in one projection."""
    columns = dict(calendar_columns(F.col(ts)))
    if "year_built" in df.columns:
        columns["age"] = F.lit(reference_year) - F.col("year_built")
    if "wind_speed" in df.columns:
        columns["beaufort_scale"] = beaufort_number(F.col("wind_speed"))
    if "wind_direction" in df.columns:
        columns["wind_direction"] = compass_sector(F.col("wind_direction"))
    return df.withColumns(columns)


def age_from_newest(df: DataFrame, year: str = "year_built", output: str = "age") -> DataFrame:
    """Years since construction, counted from the newest building of the table, which gets 1."""
    newest = df.agg(F.max(year)).scalar()
    return df.withColumn(output, newest - F.col(year) + 1)


def columns_with_gaps(df: DataFrame, exclude: Sequence[str] = ("timestamp", "meter_reading")) -> list[str]:
    """Sorted names of the columns that contain a null: one pass over the table."""
    names = sorted(set(df.columns) - set(exclude))
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    return [c for c in names if counts[c]]


def missing_flags(
    df: DataFrame, exclude: Sequence[str] = ("timestamp", "meter_reading"), always: Sequence[str] = ()
) -> DataFrame:
    """Add ``<column>_missing`` (0 or 1) for every column that contains a null, and for those of ``always`` in any case."""
    gaps = sorted({*columns_with_gaps(df, exclude), *always})
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in gaps}) if gaps else df


def reindex(nodes: DataFrame, attributes: DataFrame, entity: str = "building_id") -> DataFrame:
    """Attributes for exactly these nodes; nulls for unseen ones."""
    return nodes.join(attributes, entity, "left")


def first_row_per_entity(
    df: DataFrame, columns: Sequence[str], entity: str = "building_id", order: Sequence[str] = ("timestamp", "meter")
) -> DataFrame:
    """The first row of each entity in the given order, by a partial aggregate instead of a sort."""
    first = df.groupBy(entity).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return first.select(entity, *[F.col(f"_row.{c}").alias(c) for c in columns])


def node_positions(nodes: DataFrame, entity: str = "building_id", output: str = "node") -> DataFrame:
    """Nodes numbered in id order."""
    return value_codes(nodes, entity).withColumnRenamed("code", output)


def locate_nodes(readings: DataFrame, nodes: DataFrame, entity: str = "building_id", output: str = "node") -> DataFrame:
    """Position of each row's node, -1 where the node is unknown."""
    found = readings.join(node_positions(nodes, entity, output), entity, "left")
    return found.withColumn(output, F.coalesce(F.col(output), F.lit(-1)))


def unknown_node_counts(located: DataFrame, groups: Sequence[str] = (), node: str = "node") -> DataFrame:
    """Rows in all, of known nodes and of unknown nodes."""
    return located.groupBy(*groups).agg(
        F.count("*").alias("raw_row_count"),
        F.count_if(F.col(node) >= 0).alias("included_row_count"),
        F.count_if(F.col(node) < 0).alias("unknown_node_row_count"),
    )


def unseen_entities(later: DataFrame, earlier: DataFrame, entity: str = "building_id") -> DataFrame:
    """Distinct entities of one table that the other has not."""
    return later.select(entity).distinct().join(earlier.select(entity).distinct(), entity, "left_anti")


def _gaps(readings: DataFrame, nodes: DataFrame, keys: list[str], entity: str, ts: str, slice_days: int) -> tuple[DataFrame, DataFrame]:
    """Stretches of missing cells per node as first and last position, and the positions of the timestamps per key.

    Timestamps that occur are numbered; what lies between one observed number of a node and its next one is a gap. Only
    observed rows are ordered, in parts of GAP_POSITIONS numbers; the first number of each part is ordered over the series.
    """
    times = cut_lineage(row_positions(readings.select(*keys, ts).distinct(), keys, ts, "_position", slice_days=slice_days), "panel-times")
    totals = times.groupBy(*keys).agg(F.count("*").alias("_total"))
    observed = readings.select(*keys, entity, ts).distinct().join(nodes, [*keys, entity], "left_semi").join(times, [*keys, ts]).select(*keys, entity, "_position")
    start = nodes.withColumn("_position", F.lit(-1).cast(dict(times.dtypes)["_position"]))
    rows = observed.unionByName(start).withColumn("_part", F.floor((F.col("_position") + 1) / GAP_POSITIONS))
    inside = Window.partitionBy(*keys, entity, "_part").orderBy("_position")
    parts = Window.partitionBy(*keys, entity).orderBy("_part")
    later = rows.groupBy(*keys, entity, "_part").agg(F.min("_position").alias("_first")).select(*keys, entity, "_part", F.lead("_first").over(parts).alias("_later"))
    ended = rows.withColumn("_next", F.lead("_position").over(inside)).join(later, [*keys, entity, "_part"])
    ended = ended.join(totals, keys) if keys else ended.withColumn("_total", totals.scalar())
    following = F.coalesce("_next", "_later", "_total")
    gaps = ended.select(*keys, entity, (F.col("_position") + 1).alias("_from"), (following - 1).alias("_to")).filter("_from <= _to")
    return gaps, times


def gap_intervals(
    readings: DataFrame,
    nodes: DataFrame,
    entity: str = "building_id",
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Missing cells of the panel as stretches: node, first and last missing timestamp, and their number.

    The panel is every node of ``nodes`` (keys and entity) at every timestamp that occurs for its keys. No cell is made.
    """
    keys = list(keys)
    gaps, times = _gaps(readings, nodes.select(*keys, entity).distinct(), keys, entity, ts, slice_days)
    at = lambda place, name: times.select(*keys, F.col("_position").alias(place), F.col(ts).alias(name))
    return gaps.join(at("_from", "first_missing"), [*keys, "_from"]).join(at("_to", "last_missing"), [*keys, "_to"]).select(
        *keys, entity, "first_missing", "last_missing", (F.col("_to") - F.col("_from") + 1).alias("cells")
    )


def complete_panel(
    readings: DataFrame,
    nodes: DataFrame,
    entity: str = "building_id",
    ts: str = "timestamp",
    keys: Sequence[str] = (),
    slice_days: int = SLICE_DAYS,
) -> DataFrame:
    """Every node at every timestamp that occurs, with ``observed`` marking the rows that exist.

    ``nodes`` has the columns ``keys`` and ``entity``; rows of other nodes are left out. Existing rows
    pass through unshuffled. Missing cells are stretches between observed rows, made into rows here.
    """
    keys = list(keys)
    nodes = nodes.select(*keys, entity).distinct()
    gaps, times = _gaps(readings, nodes, keys, entity, ts, slice_days)
    cells = gaps.select(*keys, entity, F.explode(F.sequence("_from", "_to")).alias("_position"))
    missing = cells.join(times, [*keys, "_position"]).select(*keys, entity, ts).withColumn("observed", F.lit(False))
    known = readings.join(nodes, [*keys, entity], "left_semi").withColumn("observed", F.lit(True))
    return known.unionByName(missing, allowMissingColumns=True)


def presence_counts(
    readings: DataFrame, value: str, keys: Sequence[str] = (), entity: str = "building_id", ts: str = "timestamp"
) -> DataFrame:
    """Cells of the entity x timestamp grid per state: absent, zero or reading.

    Absent cells are what is left of the full grid, so the grid itself is never built.
    """
    keys = list(keys)
    if not keys:
        return presence_counts(readings.withColumn("_all", F.lit(0)), value, ["_all"], entity, ts).drop("_all")
    present = readings.groupBy(*keys).agg(
        F.count_if(F.col(value) == 0).alias("zero"),
        F.count_if(F.col(value) != 0).alias("reading"),
    )
    entities = readings.select(*keys, entity).distinct().groupBy(*keys).agg(F.count("*").alias("_entities"))
    times = readings.select(*keys, ts).distinct().groupBy(*keys).agg(F.count("*").alias("_times"))
    counted = (
        present.join(entities, keys)
        .join(times, keys)
        .withColumn("absent", F.col("_entities") * F.col("_times") - F.col("zero") - F.col("reading"))
    )
    return counted.unpivot(keys, ["zero", "reading", "absent"], "state", "cells").filter("cells > 0")
