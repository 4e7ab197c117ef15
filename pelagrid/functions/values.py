"""Value expressions: missing data, clipping, bands and typed literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)


def clean(value: Column, dtype: T.DataType) -> Column:
    """NaN becomes NULL, the one marker of a missing cell; means skip NULL."""
    if isinstance(dtype, FRACTIONAL):
        return F.when(~F.isnan(value), value)
    return value


def clip(value: Column, low: float, high: float) -> Column:
    """Value held inside [low, high]; a missing value stays missing, which
    `least(greatest(..))` alone would turn into `low`."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def band_of(value: Column, low: float, step: float) -> Column:
    """Number of the band of width `step`, counted from `low`, holding the value."""
    return F.floor((value - F.lit(float(low))) / F.lit(float(step))).cast("bigint")


def level_band(value: Column, levels: Sequence[float]) -> Column:
    """Position of the value between explicit levels: 0..n-2 inside, -1 below the
    first and n-1 from the last on. The last level itself belongs to the last band."""
    edges = [float(x) for x in levels]
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("levels must be at least two increasing numbers")
    passed = sum(((value >= F.lit(e)).cast("int") for e in edges), F.lit(-1))
    return F.when(value == F.lit(edges[-1]), F.lit(len(edges) - 2)).otherwise(passed)


# The multiples of a power of ten that count as round steps.
ROUND_STEPS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)


def round_levels(low: float, high: float, bands: int = 6) -> list[float]:
    """Evenly spaced round levels covering [low, high] in about `bands` bands."""
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ValueError(f"need finite limits in increasing order, got {low}, {high}")
    wanted = (high - low) / bands
    power = 10.0 ** math.floor(math.log10(wanted))
    step = next(m * power for m in ROUND_STEPS if m * power >= wanted * (1 - 1e-12))
    first, last = math.floor(low / step), math.ceil(high / step)
    return [i * step for i in range(first, last + 1)]


def carried(value: Column, dtype: T.DataType) -> Column:
    """A coordinate value as it travels through the driver. An instant with a time
    zone goes as a number: as a datetime it would take on the driver's zone."""
    return F.unix_micros(value) if isinstance(dtype, T.TimestampType) else value


def typed_literal(value: Any, dtype: T.DataType) -> Column:
    """Coordinate value as a literal that compares with a column of `dtype`
    without casting the column, so the comparison reaches the file scan.

    A number meant for a FLOAT axis is narrowed to FLOAT; one meant for an
    integer axis keeps its fraction, or 0.5 would pass for 0. An instant that
    came through `carried` is a count of microseconds.
    """
    if isinstance(dtype, T.TimestampType) and isinstance(value, int):
        return F.timestamp_micros(F.lit(value))
    if isinstance(value, (datetime, date)):
        value = value.isoformat()
    if isinstance(dtype, (*FRACTIONAL, *TEMPORAL)):
        return F.lit(value).cast(dtype)
    return F.lit(value)
