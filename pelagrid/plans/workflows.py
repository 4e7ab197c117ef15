"""The analyses end to end: climatology maps of a river plume, velocity profiles.

Each returns cubes or DataFrames ready to draw. Nothing here loops over facets,
years or levels in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions.values import round_levels
from ..operators import combine, limits, plotdata
from ..operators.reduce import season_mean, seasonality
from ..session import written

# The salinity that bounds the plume, the colour percentiles of
# robust limits, and the chlorophyll range of the fixed-limit section.
PLUME_LEVEL = 30.0
ROBUST = (0.02, 0.98)
CHLOROPHYLL_RANGE = (0.0, 4.0)
# Column names of the profile table.
DEPTH, EAST, NORTH, UP = "depth [m]", "u [m/s]", "v [m/s]", "w[m/s]"


@dataclass(frozen=True)
class PlumeMaps:
    """Seasonal maps with the plume edge, for one field over another."""

    salinity: Cube
    chlorophyll: Cube
    edge: DataFrame
    layers: DataFrame


def plume_maps(salinity: Cube, chlorophyll: Cube, so: str = "so", chl: str = "CHL",
               level: float = PLUME_LEVEL) -> PlumeMaps:
    """Seasonal means of both fields, the salinity isoline of each season at the
    top level, and both stacked for drawing on the chlorophyll facets."""
    surface = season_mean(salinity.pick(so).isel(depth=0) if "depth" in salinity.dims else salinity.pick(so))
    green = season_mean(chlorophyll.pick(chl))
    edge = plotdata.labelled(plotdata.isoline(surface, so, level, by=["season"]), level)
    layers = combine.overlay(green, "field", {"edge": edge}, on="season")
    return PlumeMaps(surface, green, edge, layers)


def month_section(cube: Cube, var: str, along: str = "longitude") -> DataFrame:
    """Month by latitude section of the monthly climatology."""
    return plotdata.hovmoller(seasonality(cube.pick(var)), var, x="month", along=along)


def robust_bands(cube: Cube, var: str, bands: int = 6) -> DataFrame:
    """Cells in filled bands between round levels that cover the robust limits; in
    one band, number 0, if both limits are the same, and in none without a value.
    The cube is computed once, for the limits and for the bands."""
    kept = replace(cube, frame=written(cube.frame))
    found = limits.robust_limits(kept, var, *ROBUST).first()
    low, high = found["vmin"], found["vmax"]
    if low is None or low == high:
        one = F.when(F.col(var).isNotNull(), F.lit(0))
        return kept.frame.select(*kept.dims, var, one.alias("band"))
    return plotdata.filled(kept, var, round_levels(low, high, bands))


def velocity_profile(flow: Cube, vertical: Cube, time: int | None, patch: tuple[slice, slice], point: tuple[int, int],
                     names: tuple[str, str, str] = ("uo", "vo", "w")) -> DataFrame:
    """Profile table of both horizontal components and the vertical one in one
    water column: a point counted within a patch of latitudes and longitudes.
    Without a `time` position the horizontal components are means over time."""

    def column(cube: Cube) -> Cube:
        return cube.isel(latitude=patch[0], longitude=patch[1]).isel(latitude=point[0], longitude=point[1])

    here = column(flow)
    here = here.mean("time") if time is None else here.isel(time=time)
    there = column(vertical)
    u, v, w = names
    return combine.profile_table({EAST: (here, u), NORTH: (here, v), UP: (there, w)}, DEPTH)
