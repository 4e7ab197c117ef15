"""Means along dimensions and over calendar groups.

Each is one hash aggregation: Spark averages inside every input split before it
shuffles, so a key that holds a large share of the rows still reaches the final
stage as one small partial row per split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from ..functions.timeparts import TIME_PARTS
from .select import require_dims

if TYPE_CHECKING:
    from ..cube import Cube


def mean(cube: Cube, dims: Sequence[str]) -> Cube:
    """Along all dimensions if none is named."""
    require_dims(cube, *dims)
    dims = dims or cube.dims
    rest = tuple(d for d in cube.dims if d not in dims)
    frame = cube.frame.groupBy(*rest).agg(*[F.avg(v).alias(v) for v in cube.data_vars])
    return replace(cube, frame=frame, dims=rest, axes={d: cube.axes[d] for d in rest}, year=None)


def group_mean(cube: Cube, part: str) -> Cube:
    """Every day counts once: a mean over all days of the group, in all years. A
    cell without a time belongs to no group."""
    require_dims(cube, "time")
    if part not in TIME_PARTS:
        raise KeyError(f"no calendar part {part!r}; there are {sorted(TIME_PARTS)}")
    key = TIME_PARTS[part](F.col("time")).alias(part)
    rest = tuple(d for d in cube.dims if d != "time")
    frame = cube.frame.where(F.col("time").isNotNull()).groupBy(key, *rest).agg(*[F.avg(v).alias(v) for v in cube.data_vars])
    axes = {part: cube.axes["time"].derived(key), **{d: cube.axes[d] for d in rest}}
    return replace(cube, frame=frame, dims=(part, *rest), axes=axes, year=None)


def seasonality(cube: Cube) -> Cube:
    """Monthly climatology of every variable."""
    return group_mean(cube, "month")


def season_mean(cube: Cube) -> Cube:
    """Seasonal climatology of every variable."""
    return group_mean(cube, "season")
