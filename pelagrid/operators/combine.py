"""Putting cubes side by side: profile tables, series and layered facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as fold
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..cube import Cube

# Facet labels up to this many are broadcast.
MOST_FACETS = 10_000


def profile_table(columns: Mapping[str, tuple[Cube, str]], axis_name: str = "depth [m]") -> DataFrame:
    """One row per level from one-dimensional cubes: the axis of the first, then
    one named column per (cube, variable).

    Levels pair by position, not by label, so the axes need not share values but
    must be equally long: otherwise ValueError, after a job on the axes. A cube
    with two cells at one level is no profile; computing the table raises then.
    """
    if not columns:
        raise ValueError("a profile table needs at least one column")
    for name, (cube, var) in columns.items():
        if len(cube.dims) != 1:
            raise ValueError(f"{name!r} has dimensions {cube.dims}; select or reduce to one first")
        if var not in cube.data_vars:
            raise KeyError(f"no variable {var!r} for {name!r}")
    lengths = {name: cube.axes[cube.dims[0]].length for name, (cube, _) in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns of unequal length: {lengths}")
    # Columns of one cube are read together.
    cubes = {id(cube): cube for cube, _ in columns.values()}
    wanted = {i: {n: v for n, (c, v) in columns.items() if c is cube} for i, cube in cubes.items()}
    tables = [_by_position(cube, wanted[i]) for i, cube in cubes.items()]
    first = next(iter(cubes.values()))
    table = first.positions(first.dims[0]).withColumnRenamed(first.dims[0], axis_name)
    joined = fold(lambda left, right: left.join(right, "position"), tables, table)
    return joined.orderBy("position").select(f"`{axis_name}`", *[f"`{name}`" for name in columns])


def _by_position(cube: Cube, names: Mapping[str, str]) -> DataFrame:
    (dim,) = cube.dims
    twice = F.raise_error(F.lit(f"more than one cell per level in {list(names)}"))
    one = [F.when(F.count("*") > 1, twice).otherwise(F.max(v)).alias(n) for n, v in names.items()]
    cells = cube.frame.groupBy(dim).agg(*one)
    return cube.positions(dim).join(cells, dim, "left").select("position", *[f"`{n}`" for n in names])


def profile_series(table: DataFrame, axis_name: str = "depth [m]", series: Sequence[str] | None = None) -> DataFrame:
    """The profile table as (axis, series, value) rows, for lines on shared axes."""
    names = list(series or [c for c in table.columns if c != axis_name])
    return table.unpivot(f"`{axis_name}`", [f"`{n}`" for n in names], "series", "value")


def overlay(base: Cube, name: str, layers: Mapping[str, DataFrame], on: str) -> DataFrame:
    """The cells of `base`, under `name`, with other layers drawn on its facets,
    stacked under a `layer` column.

    Layers pair with facets by label. Their grids may differ, so nothing is
    matched on coordinates; a column a layer lacks is NULL there. A facet the
    base does not have is left out, as there is no panel to draw it on.
    """
    labels = base.axes[on].values
    # Without the hint each layer would be shuffled by its label, into as few tasks as
    # there are facets. More labels than this are no facets; then a shuffle spreads well.
    if labels.limit(MOST_FACETS + 1).count() <= MOST_FACETS:
        labels = F.broadcast(labels)
    drawn = [base.frame.withColumn("layer", F.lit(name))]
    drawn += [f.join(labels, on, "left_semi").withColumn("layer", F.lit(n)) for n, f in layers.items()]
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), drawn)
