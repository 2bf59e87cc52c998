"""Binning and relabelling expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Lower wind speed of Beaufort numbers 1 to 12, in metres per second.
BEAUFORT_EDGES = (0.3, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 33.0)

# Meter codes and their names.
METER_LABELS = {0: "electricity", 1: "chilled_water", 2: "steam", 3: "hot_water"}


def compass_sector(degrees: Column) -> Column:
    """One of 16 sectors of 22.5 degrees; null stays null."""
    return F.pmod((degrees / F.lit(22.5)).cast("int"), F.lit(16))


def beaufort_number(speed: Column) -> Column:
    """Beaufort number 0 to 12; an edge belongs to the bin above it, null stays null."""
    reached = [F.when(speed >= edge, 1).otherwise(0) for edge in BEAUFORT_EDGES]
    return F.when(speed.isNotNull(), reduce(lambda total, step: total + step, reached))


def relabel(code: Column, labels: dict) -> Column:
    """Replace a code with its label; an unknown code becomes its own text."""
    mapping = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    return F.coalesce(F.try_element_at(mapping, code), code.cast("string"))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number 1 to ``bins`` between ``low`` and ``high``; the maximum falls in the last bin."""
    position = F.floor((value - low) / (high - low) * bins) + 1
    return F.when(high <= low, F.lit(1)).otherwise(F.least(position, F.lit(bins)))
