"""Selection by position, label, range and nearest value.

A position is first turned into a coordinate value by a small job on the axis;
the cells are then filtered on that literal, which the file scan can push down.
Joining the cells with an axis table would push nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce as fold
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import carried, typed_literal

if TYPE_CHECKING:
    from ..axis import Axis
    from ..cube import Cube


def require_dims(cube: Cube, *dims: str) -> None:
    unknown = [d for d in dims if d not in cube.dims]
    if unknown:
        raise KeyError(f"no dimension {unknown}; there are {list(cube.dims)}")


def restrict(cube: Cube, dim: str, low: Any, high: Any, known: tuple[int, int] | None = None) -> Cube:
    """Cells and axis inside the closed interval, an open end being None; `known` are the
    positions of the source axis it has, where they are known. On the
    time of a cube stored by year the year partitions are named as well: Spark
    derives no partition filter from a range of timestamps."""
    tests, years = [], []
    for bound, inside in ((low, "__ge__"), (high, "__le__")):
        if bound is None:
            continue
        value = typed_literal(bound, cube.dtype(dim))
        tests.append(getattr(F.col(dim), inside)(value))
        if cube.year and dim == "time":
            years.append(getattr(F.col(cube.year), inside)(F.year(value)))
    if low is not None and low == high:
        tests = [F.col(dim) == typed_literal(low, cube.dtype(dim))]
    frame, axis = cube.frame, cube.axes[dim]
    for test in (*tests, *years):
        frame = frame.where(test)
    if tests:
        axis = axis.where(*tests, known=known)
    return replace(cube, frame=frame, axes={**cube.axes, dim: axis})


def without(cube: Cube, dims: Sequence[str]) -> Cube:
    """Drop dimensions already narrowed to one value."""
    rest = tuple(d for d in cube.dims if d not in dims)
    year = None if "time" in dims else cube.year
    frame = cube.frame.select(*rest, *cube.data_vars, *([year] if year else []))
    return replace(cube, frame=frame, dims=rest, axes={d: cube.axes[d] for d in rest}, year=year)


def sel_range(cube: Cube, bounds: Mapping[str, tuple[Any, Any]]) -> Cube:
    require_dims(cube, *bounds)
    for dim, (low, high) in bounds.items():
        cube = restrict(cube, dim, low, high)
    return cube


def positions(cube: Cube, dim: str) -> DataFrame:
    require_dims(cube, dim)
    return cube.axes[dim].positions


def one_row_each(frames: Mapping[str, DataFrame]) -> dict[str, Any]:
    """Collect one row per axis, all axes in one job."""
    tagged = [f.select(F.lit(d).alias("axis_name"), F.struct("*").alias(f"of_{d}")) for d, f in frames.items()]
    rows = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).collect()
    return {r["axis_name"]: r[f"of_{r['axis_name']}"] for r in rows}


def _bounds(where: int | slice, axis: Axis) -> tuple[int, int | None]:
    """Positions start <= p < stop of an index counted from either end; None is
    the end of the axis. Its length is only looked up for a negative number."""

    def at(position: int) -> int:
        return position if position >= 0 else position + axis.length

    if not isinstance(where, slice):
        if at(where) < 0:
            raise IndexError(f"position {where} is outside axis {axis.name}")
        return at(where), at(where) + 1
    if where.step not in (None, 1):
        raise ValueError("a slice of positions takes no step")
    stop = None if where.stop is None else max(at(where.stop), 0)
    return max(at(where.start or 0), 0), stop


def _ends(wanted: DataFrame, axis: Axis, stop: int | None) -> DataFrame:
    """Least and greatest coordinate of the looked up rows, as a one-row frame; with an
    open end the one at the start."""
    dtype = axis.source.schema[axis.name].dataType
    low, high = carried(F.min(axis.name), dtype), carried(F.max(axis.name), dtype)
    nothing = F.lit(None).cast(dtype)
    if stop is None:
        low, high = (nothing, high) if axis.descending else (low, nothing)
    return wanted.agg(F.count(axis.name).alias("n"), low.alias("low"), high.alias("high"))


@dataclass(frozen=True)
class Found:
    """The coordinates at both ends of some positions, None for an open end, and their source positions if known."""

    low: Any
    high: Any
    known: tuple[int, int] | None


def settle(axes: Mapping[str, Axis]) -> None:
    """Find out what selections by label have left of the axes, all in one job."""
    with ThreadPoolExecutor() as pool:  # ranking a source axis runs jobs of its own
        list(pool.map(lambda a: a.ranks.length, axes.values()))
    if open_ := {d: a for d, a in axes.items() if not a.settled}:
        for d, found in one_row_each({d: a.reach() for d, a in open_.items()}).items():
            open_[d].settle(found["first"], found["last"], found["n"])


def located(axes: Mapping[str, Axis], where: Mapping[str, int | slice]) -> dict[str, Found | None]:
    """Where positions lie on their axes; None for an empty slice. One job for all axes."""
    settle(axes)
    bounds = {d: _bounds(w, axes[d]) for d, w in where.items()}
    lookups = {d: axes[d].lookup(*bounds[d]) for d in where}
    asked = {d: _ends(rows, axes[d], bounds[d][1]) for d, (rows, _) in lookups.items() if rows is not None}
    ends = one_row_each(asked) if asked else {}
    out = {}
    for dim, w in where.items():
        there = dim in ends and ends[dim]["n"]
        if not there and not isinstance(w, slice):
            raise IndexError(f"position {w} is outside axis {dim}")
        out[dim] = Found(ends[dim]["low"], ends[dim]["high"], lookups[dim][1]) if there else None
    return out


def placed(cube: Cube, where: Mapping[str, int | slice], found: Mapping[str, Found | None]) -> Cube:
    """The cells at positions that were located; an int drops the dimension."""
    for dim in where:
        if at := found[dim]:
            cube = restrict(cube, dim, at.low, at.high, at.known)
        else:
            nothing = F.lit(False)
            axis = cube.axes[dim].where(nothing, known=(0, 0))
            cube = replace(cube, frame=cube.frame.where(nothing), axes={**cube.axes, dim: axis})
    return without(cube, [d for d, w in where.items() if not isinstance(w, slice)])


def isel(cube: Cube, where: Mapping[str, int | slice]) -> Cube:
    require_dims(cube, *where)
    return placed(cube, where, located({d: cube.axes[d] for d in where}, where)) if where else cube


def labelled(cube: Cube, where: Mapping[str, Any]) -> Cube:
    for dim, label in where.items():
        cube = restrict(cube, dim, label, label)
    return cube


def require_labels(axes: Mapping[str, Axis], where: Mapping[str, Any]) -> None:
    """Raise for labels that have left nothing of their axis."""
    found = one_row_each({d: axes[d].size() for d in where}) if where else {}
    absent = {d: where[d] for d in where if not found[d]["n"]}
    if absent:
        raise KeyError(f"not on the axis: {absent}")


def sel(cube: Cube, where: Mapping[str, Any], strict: bool) -> Cube:
    require_dims(cube, *where)
    cube = labelled(cube, where)
    if strict:
        require_labels(cube.axes, where)
    return without(cube, tuple(where))


def nearest(axes: Mapping[str, Axis], where: Mapping[str, float]) -> dict[str, Any]:
    """The axis value nearest to each number; of two equally near the larger one."""
    asked = {}
    for dim, wanted in where.items():
        at = F.col(dim).cast("double")
        rank = F.struct(F.abs(at - F.lit(float(wanted))), -at)
        value = carried(F.min_by(dim, rank), axes[dim].source.schema[dim].dataType)
        asked[dim] = axes[dim].values.agg(value.alias("value"))
    values = {d: row["value"] for d, row in one_row_each(asked).items()}
    if empty := [d for d, v in values.items() if v is None]:
        raise KeyError(f"nothing on the axis of {empty}")
    return values


def sel_nearest(cube: Cube, where: Mapping[str, float], drop: bool) -> Cube:
    require_dims(cube, *where)
    cube = labelled(cube, nearest(cube.axes, where))
    return without(cube, tuple(where)) if drop else cube


def single(axes: Mapping[str, Axis]) -> list[str]:
    """The dimensions whose axis has one value."""
    if not axes:
        return []
    ends = one_row_each({d: a.values.agg(F.min(d).alias("first"), F.max(d).alias("last")) for d, a in axes.items()})
    return [d for d in axes if ends[d]["first"] is not None and ends[d]["first"] == ends[d]["last"]]


def squeeze(cube: Cube) -> Cube:
    dims = single(cube.axes)
    return without(cube, dims) if dims else cube


def drop_dims(cube: Cube, dims: Sequence[str], keep: Sequence[str]) -> Cube:
    """A kept variable holds one value per remaining cell, missing ones aside; the
    table raises where it does not. The repeats merge before they are shuffled."""
    require_dims(cube, *dims)
    unknown = [v for v in keep if v not in cube.data_vars]
    if unknown:
        raise KeyError(f"no variable {unknown}; there are {list(cube.data_vars)}")
    rest = tuple(d for d in cube.dims if d not in dims)
    if keep:
        frame = cube.frame.groupBy(*rest).agg(*[_only(v).alias(v) for v in keep])
    else:
        frame = cube.frame.select(*rest).distinct()
    return replace(cube, frame=frame, dims=rest, data_vars=tuple(keep),
                   axes={d: cube.axes[d] for d in rest}, year=None)


def _only(var: str) -> Column:
    """The one value of a group."""
    varies = F.raise_error(F.lit(f"{var} varies along a dropped dimension"))
    return F.when(F.min(var) == F.max(var), F.max(var)).when(F.count(var) > 0, varies)
