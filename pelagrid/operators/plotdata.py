"""The data behind maps and sections: facets, isolines, bands and rasters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeparts import TIME_PARTS
from ..functions.values import band_of, clip, level_band
from .select import require_dims

if TYPE_CHECKING:
    from ..cube import Cube


def facet(cube: Cube, var: str, by: str, labels: Sequence) -> DataFrame:
    """One column per facet label, one row per remaining cell.

    On a cube that still has time the calendar mean is taken on the way, in the
    same single aggregation; on a climatology each cell is its own mean.
    """
    if by in cube.dims:
        key, grouped = F.col(by), by
    else:
        require_dims(cube, "time")
        key, grouped = TIME_PARTS[by](F.col("time")), "time"
    rest = [d for d in cube.dims if d != grouped]
    keyed = cube.frame.select(*rest, key.alias("facet_key"), F.col(var).alias("facet_value"))
    value = F.col("facet_value")
    per_label = [F.avg(F.when(F.col("facet_key") == F.lit(x), value)).alias(str(x)) for x in labels]
    return keyed.groupBy(*rest).agg(*per_label)


def facet_labels(cube: Cube, by: str) -> DataFrame:
    """The labels of a facet dimension, in plotting order, with their panel number."""
    return cube.positions(by).select(F.col("position").alias("panel"), by)


def isoline(
    cube: Cube,
    var: str,
    level: float,
    by: Sequence[str] = (),
    x: str = "longitude",
    y: str = "latitude",
) -> DataFrame:
    """Points where the level crosses the grid lines of each facet's raster.

    Two neighbouring cells are crossed when one is below the level and the other
    is not; the point lies between them by linear interpolation. Neighbours are
    neighbours on the axis: next to a missing cell nothing is crossed. Rows are
    (*by, edge, y, x), with `edge` the axis walked along.

    Both directions run in one pass over the raster, one window each. A window
    group is a single grid line, so it is never longer than an axis.
    """
    require_dims(cube, x, y, *by)
    if set(cube.dims) != {x, y, *by}:
        raise ValueError(f"isoline needs exactly the dimensions {[*by, y, x]}, got {list(cube.dims)}")
    cells = cube.frame.select(
        *by, F.col(y).alias("ky"), F.col(x).alias("kx"), F.col(var).cast("double").alias("v")
    ).where(F.col("v").isNotNull())
    for dim, key in ((x, "kx"), (y, "ky")):
        axis = cube.positions(dim).select(F.col(dim).alias(key), F.col("position").alias(f"{key}_at"))
        cells = cells.join(axis, key)

    def ahead(along: str, across: str) -> list:
        line = Window.partitionBy(*by, across).orderBy(f"{along}_at")
        return [F.lead(c).over(line).alias(f"{c}_next_{along}") for c in (f"{along}_at", along, "v")]

    def crossed(along: str):
        adjacent = F.col(f"{along}_at_next_{along}") == F.col(f"{along}_at") + 1
        return F.coalesce(adjacent & ((F.col("v") < level) != (F.col(f"v_next_{along}") < level)), F.lit(False))

    def between(along: str):
        here, there = F.col(along).cast("double"), F.col(f"{along}_next_{along}").cast("double")
        part = (F.lit(float(level)) - F.col("v")) / (F.col(f"v_next_{along}") - F.col("v"))
        return here + part * (there - here)

    def point(name: str, lat, lon):
        return F.struct(F.lit(name).alias("edge"), lat.alias(y), lon.alias(x))

    # Few cells are crossed: the rest is gone before anything is built per edge.
    cells = cells.select("*", *ahead("kx", "ky")).withColumn("cross_x", crossed("kx"))
    cells = cells.select("*", *ahead("ky", "kx")).withColumn("cross_y", crossed("ky"))
    lat, lon = F.col("ky").cast("double"), F.col("kx").cast("double")
    points = F.array(
        F.when(F.col("cross_x"), point(x, lat, between("kx"))),
        F.when(F.col("cross_y"), point(y, between("ky"), lon)))
    return cells.where("cross_x or cross_y").select(*by, F.inline(F.array_compact(points)))


def isoline_segments(
    cube: Cube,
    var: str,
    level: float,
    by: Sequence[str] = (),
    x: str = "longitude",
    y: str = "latitude",
) -> DataFrame:
    """The pieces of the isoline inside the grid cells of each facet's raster, each with both ends.

    A grid cell lies between four neighbours on the axes. Where two of its sides are crossed, as
    `isoline` says, one piece joins the crossings. Where all four are, the corners below the level lie
    across from each other: they belong together if the mean of the corners is below the level too, and
    are cut off one by one if not. A cell with a missing corner has no piece; any other crossing is an
    end of the pieces on both sides of its grid line, so that pieces join at equal ends.

    Rows are (*by, y_from, x_from, y_to, x_to), named after the dimensions. Sides count
    from the lower y over the lower x and the higher y to the higher x; `from` is on the earlier one. Two
    windows, along and across, as for the points.
    """
    require_dims(cube, x, y, *by)
    if set(cube.dims) != {x, y, *by}:
        raise ValueError(f"isoline needs exactly the dimensions {[*by, y, x]}, got {list(cube.dims)}")
    cells = cube.frame.select(
        *by, F.col(y).alias("ky"), F.col(x).alias("kx"), F.col(var).cast("double").alias("v")
    ).where(F.col("v").isNotNull())
    for dim, key in ((x, "kx"), (y, "ky")):
        axis = cube.positions(dim).select(F.col(dim).alias(key), F.col("position").alias(f"{key}_at"))
        cells = cells.join(axis, key)

    along = Window.partitionBy(*by, "ky").orderBy("kx_at")
    east = F.lead("kx_at").over(along) == F.col("kx_at") + 1
    cells = cells.select(
        "*", F.when(east, F.lead("v").over(along)).alias("v_e"), F.when(east, F.lead("kx").over(along)).alias("kx_e"))
    across = Window.partitionBy(*by, "kx").orderBy("ky_at")
    north = F.lead("ky_at").over(across) == F.col("ky_at") + 1
    cells = cells.select("*", *[
        F.when(north, F.lead(c).over(across)).alias(n) for c, n in (("v", "v_n"), ("v_e", "v_ne"), ("ky", "ky_n"))])
    below = {c: F.col(c) < level for c in ("v", "v_e", "v_n", "v_ne")}
    # Few cells are crossed: the rest is gone before anything is built per side.
    some = (below["v"] != below["v_e"]) | (below["v"] != below["v_n"]) | (below["v"] != below["v_ne"])
    cells = cells.where(F.col("v_e").isNotNull() & F.col("v_n").isNotNull() & F.col("v_ne").isNotNull()).where(some)

    def at(here: str, there: str, a: str, b: str):
        part = (F.lit(float(level)) - F.col(a)) / (F.col(b) - F.col(a))
        low, high = F.col(here).cast("double"), F.col(there).cast("double")
        return low + part * (high - low)

    def side(a: str, b: str, lat, lon):
        return F.when(below[a] != below[b], F.struct(lat.alias("lat"), lon.alias("lon")))

    low_y, high_y, low_x, high_x = (F.col(c).cast("double") for c in ("ky", "ky_n", "kx", "kx_e"))
    s = side("v", "v_e", low_y, at("kx", "kx_e", "v", "v_e"))
    w = side("v", "v_n", at("ky", "ky_n", "v", "v_n"), low_x)
    n = side("v_n", "v_ne", high_y, at("kx", "kx_e", "v_n", "v_ne"))
    e = side("v_e", "v_ne", at("ky", "ky_n", "v_e", "v_ne"), high_x)
    middle = (F.col("v") + F.col("v_e") + F.col("v_n") + F.col("v_ne")) / 4 < level
    crossed = F.array_compact(F.array(s, w, n, e))
    piece = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    cut_off = F.when(below["v"] != middle, F.array(piece(s, w), piece(n, e))).otherwise(F.array(piece(s, e), piece(w, n)))
    pieces = F.when(F.size(crossed) == 4, cut_off).otherwise(F.array(piece(crossed[0], crossed[1])))
    return cells.select(*by, F.explode(pieces).alias("p")).select(
        *by, F.col("p.a.lat").alias(f"{y}_from"), F.col("p.a.lon").alias(f"{x}_from"),
        F.col("p.b.lat").alias(f"{y}_to"), F.col("p.b.lon").alias(f"{x}_to"))


def labelled(points: DataFrame, level: float) -> DataFrame:
    """Isoline points with the level as its contour label, without decimals."""
    return points.withColumn("label", F.format_string("%.0f", F.lit(float(level))))


def bands(cube: Cube, var: str, low: float, step: float) -> DataFrame:
    """Cells with the number of the filled band their value falls in."""
    return cube.frame.select(*cube.dims, var, band_of(F.col(var), low, step).alias("band"))


def filled(cube: Cube, var: str, levels: Sequence[float]) -> DataFrame:
    """Cells with their band between explicit levels; see `level_band`."""
    return cube.frame.select(*cube.dims, var, level_band(F.col(var), levels).alias("band"))


def hovmoller(cube: Cube, var: str, x: str = "time", y: str = "latitude", along: str = "longitude") -> DataFrame:
    """Section (x, y, value): the mean along one dimension, of whatever is left."""
    require_dims(cube, x, y, along)
    section = cube.pick(var).mean(along)
    others = [d for d in section.dims if d not in (x, y)]
    return section.frame.select(x, y, *others, var)


def clipped(cube: Cube, var: str, low: float, high: float) -> DataFrame:
    """Cells with the value held inside fixed limits, missing ones left missing."""
    return cube.frame.select(*cube.dims, clip(F.col(var), low, high).alias(var))


def profile_line(cube: Cube, var: str, y: str = "depth", window: tuple[float, float] | None = None,
                 downward: bool = False) -> DataFrame:
    """A vertical profile in drawing order, inside a depth window if one is given.
    `downward` starts at the greatest depth, as an inverted axis does."""
    if window is not None:
        cube = cube.sel_range(**{y: (min(window), max(window))})
    order = F.col(y).desc() if downward else F.col(y)
    return cube.frame.select(y, var).orderBy(order)
