"""Cubes in files: open one, open many as one, and keep one by year.

A kept cube is Parquet in long form, one row per cell, one partition directory
per calendar year and in it one per version, sorted inside each file by depth, latitude, longitude and then
time, so that the statistics of row groups and pages prune levels and boxes, and
the days of one cell lie together for the means. Its axes are kept beside it, under `_axes`,
also by year: replacing a year replaces that year's part of every axis. Under `_index` is the
position of every axis value: opening the cube later scans no cells for an axis and ranks nothing.
Which versions are current is in a manifest; see `snapshot`.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, NumericType, StructField, StructType

from ..axis import LENGTH, POSITION, Axis, noted
from ..cube import TIME, Cube
from ..dataset import Dataset
from ..functions.timeparts import TIME_PARTS, month_of, season_of_month
from ..operators.select import one_row_each
from ..ranks import furthest_before, ranked_once
from . import snapshot
from .snapshot import Manifest

log = logging.getLogger(__name__)

YEAR = "year"


def open_cube(
    spark: SparkSession,
    path: str,
    dims: Sequence[str],
    data_vars: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    descending: Sequence[str] = (),
) -> Cube:
    """Cube over one file or directory, lazily.

    `dims` and `data_vars` are the names after `rename`; without `data_vars`
    every other column is a variable. A `year` column next to a time dimension is
    taken as the partition column of a kept cube. Positions start at the largest
    value along `descending` dimensions; a kept cube knows its own.
    """
    kept = snapshot.current(spark, path.rstrip("/")) if fmt == "parquet" else None
    if kept and kept.schema:
        frame = _cells(spark, path, kept, kept.cells)
    else:
        frame = spark.read.format(fmt).options(**dict(options or {})).load(path)
    axes = _kept_axes(spark, path, kept, dims, rename) if kept else {}
    return from_frame(frame, dims, data_vars, rename, axes, descending)


def from_frame(
    frame: DataFrame,
    dims: Sequence[str],
    data_vars: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    axes: Mapping[str, Axis] | None = None,
    descending: Sequence[str] = (),
) -> Cube:
    """Cube over any frame, names aligned."""
    if rename:
        frame = frame.withColumnsRenamed(dict(rename))
    year = YEAR if TIME in dims and YEAR in frame.columns and YEAR not in (*dims, *(data_vars or ())) else None
    names = list(data_vars) if data_vars is not None else [
        c for c in frame.columns if c not in dims and c != year
    ]
    missing = [c for c in (*dims, *names) if c not in frame.columns]
    if missing:
        raise KeyError(f"no column {missing} among {frame.columns}")
    own = {d: Axis.of(frame.select(d), d in descending) for d in dims}
    return Cube.of(frame, dims, names, {**own, **dict(axes or {})}, year)


def _cells(spark: SparkSession, path: str, kept: Manifest, versions: Mapping[str, str]) -> DataFrame:
    """The current cells of a kept cube, of some of its years; the other versions are not listed."""
    path, schema = path.rstrip("/"), StructType.fromJson(json.loads(kept.schema))
    if not versions:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*snapshot.folders(path, versions)).select(*schema.names)


def _kept_axes(spark: SparkSession, root: str, kept: Manifest, dims: Sequence[str], rename: Mapping[str, str] | None,
               years: Sequence[str] | None = None) -> dict[str, Axis]:
    """Kept axes by their new names, of all years with their positions, or of some years."""
    source = {new: old for old, new in (rename or {}).items()}
    versions = kept.axes if years is None else {y: v for y, v in kept.axes.items() if y in years}
    axes = {}
    for dim in dims:
        old = source.get(dim, dim)
        folder = f"{root.rstrip('/')}/_axes/{old}"
        parts = snapshot.existing(spark, folder, versions) if old in kept.dims else []
        if not parts:
            continue
        value = StructField.fromJson(kept.dims[old]["field"])
        values = spark.read.schema(StructType([value])).option("basePath", folder).parquet(*parts).select(F.col(old).alias(dim))
        if years is None:
            at = StructField(POSITION, LongType(), metadata={LENGTH: kept.dims[old]["length"]})
            index = f"{root.rstrip('/')}/_index/{old}/{snapshot.VERSION}={kept.index}"
            positions = spark.read.schema(StructType([value, at])).parquet(index).select(F.col(old).alias(dim), POSITION)
            axes[dim] = Axis.stored(values, positions)
        else:
            axes[dim] = Axis(values)
    return axes


def open_many(
    spark: SparkSession,
    paths: str | Sequence[str],
    dims: Sequence[str],
    data_vars: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    along: str = TIME,
    slab: str = "file",
    check: bool = True,
    descending: Sequence[str] = (),
) -> Cube:
    """Many files, by path or glob, as one cube.

    Files with other coordinates or variables line up by name, with missing cells
    where one has nothing. A glob over the years of one kept cube, such as
    `cube/year=20*`, keeps its year column and its axes. Each slab (a file, or with slab="directory" a
    directory of files) must cover its own stretch of the `along` axis. Overlap
    raises ValueError: the check is one aggregation of that single column.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kept = _years_of_one_cube(spark, paths)
    if kept:
        root, manifest, years = kept
        frame = _cells(spark, root, manifest, {y: manifest.cells[y] for y in years})
        axes = _kept_axes(spark, root, manifest, dims, rename, years)
    else:
        frame, axes = spark.read.option("mergeSchema", "true").parquet(*paths), {}
    if check:
        source = {new: old for old, new in (rename or {}).items()}.get(along, along)
        check_overlap(file_spans(frame, source), along, slab)
    return from_frame(frame, dims, data_vars, rename, axes, descending)


def _years_of_one_cube(spark: SparkSession, paths: Sequence[str]) -> tuple[str, Manifest, list[str]] | None:
    """The root, the manifest and the chosen years if the paths are years of one kept cube."""
    roots, _, patterns = zip(*(p.rstrip("/").partition(f"/{YEAR}=") for p in paths))
    if len(set(roots)) > 1 or not all(patterns) or any("/" in p for p in patterns):
        return None
    manifest = snapshot.current(spark, roots[0])
    if not (manifest and manifest.schema):
        return None
    return roots[0], manifest, [y for y in manifest.cells if any(fnmatch(y, p) for p in patterns)]


def file_spans(frame: DataFrame, along: str) -> DataFrame:
    """First and last `along` value in each file of a file-backed frame."""
    file = F.col("_metadata.file_path").alias("slab")
    return frame.select(file, along).groupBy("slab").agg(F.min(along).alias("first"), F.max(along).alias("last"))


def overlaps(spans: DataFrame, slab: str = "file") -> DataFrame:
    """Slabs that begin before an earlier one has ended, from the spans of files.
    By now there is one row per file, whatever the number of cells."""
    if slab == "directory":
        folder = F.regexp_replace("slab", "/[^/]*$", "").alias("slab")
        spans = spans.groupBy(folder).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    elif slab != "file":
        raise ValueError(f"slab is 'file' or 'directory', not {slab!r}")
    return furthest_before(spans, [F.col(c) for c in ("first", "last", "slab")], F.col("last"), "reached").where("first <= reached")


def check_overlap(spans: DataFrame, along: str, slab: str = "file") -> None:
    clashes = overlaps(spans, slab).limit(3).collect()
    if clashes:
        raise ValueError(f"overlapping {along} in {[c['slab'] for c in clashes]}")


def duplicate_cells(cube: Cube) -> DataFrame:
    """Coordinates held by more than one row, with their count. It groups every
    cell, so it is for data whose slabs may themselves repeat cells."""
    return cube.frame.groupBy(*cube.dims).agg(F.count("*").alias("copies")).where("copies > 1")


def combine(cubes: Sequence[Cube]) -> Cube | Dataset:
    """Cubes as one; variables line up by name. Cubes of unlike dimensions become a
    dataset with a group for each set of dimensions, their common axes shared."""
    first, *rest = cubes
    groups: dict[frozenset[str], list[Cube]] = {}
    for c in cubes:
        groups.setdefault(frozenset(c.dims), []).append(c)
    if len(groups) > 1:
        return Dataset.of([combine(group) for group in groups.values()])
    names = list(dict.fromkeys(v for c in cubes for v in c.data_vars))
    year = YEAR if all(c.year for c in cubes) else None
    frame, axes = None, None
    for c in cubes:
        part = c.frame if year or not c.year else c.frame.drop(c.year)
        frame = part if frame is None else frame.unionByName(part, allowMissingColumns=True)
        axes = dict(c.axes) if axes is None else {d: axes[d].union(c.axes[d]) for d in axes}
    return Cube.of(frame, first.dims, names, axes, year)


def write_cube(cube: Cube, path: str, files: int | None = None, replace_all: bool = False,
               years: Iterable[int] | None = None, request: str | None = None, partials: bool | None = None, layout: str = "place") -> None:
    """Keep a cube by year, with its axes, as the next state of what is kept there.

    Only the years present in the cube and those in `years` are replaced unless `replace_all`; of
    `years` one without cells is empty afterwards. A reader sees the state before until cells,
    axes and positions are all there, and a store that breaks off changes nothing.

    Rows go to
    tasks by year, without a look at the data first; adaptive execution splits a year
    with most of the rows and merges small ones. With `files` they go into that many
    value ranges over (year, place, time), which takes a sample first: each file then
    covers a small box, and a year or a place with most of the rows is split too. Cells, missing values
    and extents are counted on the way; see `store_report`. `request` is noted with what is replaced.

    The cells of a year are sorted by place and then by time, for means along time; with
    layout="interleaved" by the interleaved bits of all their coordinates, so that each stretch of
    a file is small along every dimension: a single day prunes as a box does. Filters on the
    coordinates are the key ranges; statistics do the rest. Ask for as many `files` as the box is to be cut into.

    With `partials` the sum and count of every variable by year, month and cell are kept beside the cells, for
    `open_means`; a store that has them goes on with them. They are made from the cells just
    stored, and those of other years are not read.
    """
    path, spark = path.rstrip("/"), cube.frame.sparkSession
    place = [d for d in ("depth", "latitude", "longitude") if d in cube.dims]
    others = [d for d in cube.dims if d not in (*place, TIME)]
    frame = cube.frame.select(*cube.dims, *cube.data_vars)
    timed = TIME in cube.dims
    if timed:
        frame = frame.withColumn(YEAR, F.year(TIME))
    order = [*([YEAR] if timed else []), *place, *others, *([TIME] if timed else [])]
    names, schema = frame.columns, frame.schema.json()
    if layout == "interleaved":
        # As a column: an expression in the order would be computed again for every two rows compared.
        key = _unused("key", names)
        frame = interleaved(cube, frame, key)
        order = [*([YEAR] if timed else []), key]
    elif layout != "place":
        raise ValueError(f"layout is 'place' or 'interleaved', not {layout!r}")
    # Rows that share even their coordinates still split, by what they hold.
    spread = [*order, *([F.xxhash64(*cube.data_vars)] if cube.data_vars else [])]
    laid_out = frame.repartitionByRange(files, *spread) if files else frame.hint("rebalance", F.col(YEAR) if timed else order[0])
    before = snapshot.current(spark, path) or Manifest()
    version, seen = snapshot.new_version(), Observation()
    _append(laid_out.sortWithinPartitions(*order).select(*names).observe(seen, *_measures(cube)), path, timed, version)
    found = snapshot.written_keys(spark, path, version)
    named = [str(y) for y in years or ()]
    gone = {*before.cells} if replace_all else {*found, *named, snapshot.WHOLE}
    cells = {k: v for k, v in before.cells.items() if k not in gone} | dict.fromkeys(found, version)
    asked = {k: r for k, r in before.requests.items() if k not in gone and not replace_all}
    if request:
        asked |= dict.fromkeys([snapshot.WHOLE] if years is None else named, request)
    measured = {"years": found, "request": request, **_report(cube, seen.get)}
    if partials is None:
        partials = bool(before.partials)
    elif partials and timed and (old := sorted(set(cells) - set(found) - set(before.partials))):
        raise ValueError(f"no partial means are kept of {old}; store these years with them too")
    sums = {k: v for k, v in before.partials.items() if k in cells and k not in found} if partials else {}
    if partials and timed and found:
        stored = _cells(spark, path, replace(before, schema=schema), dict.fromkeys(found, version))
        _append(_partial_sums(stored, cube), f"{path}/_partials", True, version)
        sums |= dict.fromkeys(found, version)
    reports = {v: r for v, r in before.reports.items() if v in cells.values()} | {version: measured}
    log.info("stored %s: %s", path, measured)
    now = replace(before, number=before.number + 1, schema=schema, cells=cells, partials=sums, requests=asked, reports=reports,
                  axes={} if replace_all else {k: v for k, v in before.axes.items() if k not in (*named, snapshot.WHOLE)})
    axes = {d: a.values.select(noted(d, a.descending)) for d, a in cube.axes.items()}
    snapshot.commit(spark, path, _with_axes(spark, path, now, axes, timed, version))


def _partial_sums(cells: DataFrame, cube: Cube) -> DataFrame:
    """Per year, month and place: sum and count of each variable, missing values left out."""
    rest = [d for d in cube.dims if d != TIME]
    sums = [e for i, v in enumerate(cube.data_vars) for e in (
        F.sum(F.col(v).cast("double")).alias(f"sum{i}"), F.count(v).alias(f"count{i}"))]
    timed = cells.where(F.col(TIME).isNotNull())
    return timed.groupBy(YEAR, month_of(F.col(TIME)).alias("month"), *rest).agg(*sums).sortWithinPartitions(YEAR, *rest)


def open_means(spark: SparkSession, path: str, part: str = "month", rename: Mapping[str, str] | None = None) -> Cube:
    """The climatology by month or season of a cube that was kept with `partials`.

    It is what `group_mean` gives, every day counting once, from the kept sums and counts:
    no cell is read, and a year that was replaced has replaced its sums only. Sums are added in another
    order than by the cells, which can show in the last digits of values that are not whole.
    """
    path = path.rstrip("/")
    kept = snapshot.current(spark, path)
    if not kept or not kept.partials:
        raise FileNotFoundError(f"no partial means are kept in {path}")
    if part not in ("month", "season"):
        raise KeyError(f"no kept means by {part!r}; there are month and season")
    schema = StructType.fromJson(json.loads(kept.schema))
    rest = [d for d in kept.dims if d != TIME]
    names = [f.name for f in schema if f.name not in kept.dims and f.name != YEAR]
    parts = spark.read.option("basePath", f"{path}/_partials").parquet(*snapshot.folders(f"{path}/_partials", kept.partials))
    key = F.col("month") if part == "month" else season_of_month(F.col("month"))
    n = [F.sum(f"count{i}") for i, _ in enumerate(names)]
    means = parts.groupBy(key.alias(part), *rest).agg(*[
        F.when(n[i] > 0, F.sum(f"sum{i}") / n[i]).alias(v) for i, v in enumerate(names)])
    axes = _kept_axes(spark, path, kept, [TIME, *rest], None)
    times = axes.pop(TIME)
    cube = Cube.of(means, (part, *rest), names, {part: times.derived(TIME_PARTS[part](F.col(TIME)).alias(part)), **axes})
    return cube.rename({o: n for o, n in (rename or {}).items() if o in (*cube.dims, *names)}) if rename else cube


def write_dataset(data: Dataset, path: str, **options) -> None:
    """Keep the groups of a dataset, each below `path` in a folder named by its dimensions, as
    `write_cube` does with the same options. Groups of equal dimensions are joined."""
    groups: dict[frozenset[str], list[str]] = {}
    for g in data.groups:
        groups.setdefault(frozenset(g.dims), []).extend(g.data_vars)
    for names in groups.values():
        cube = data.cube(*names)
        write_cube(cube, f"{path.rstrip('/')}/{'_'.join(cube.dims) or 'point'}", **options)


def open_groups(spark: SparkSession, path: str) -> Dataset:
    """A dataset that `write_dataset` has kept."""
    found = snapshot.stores(spark, path.rstrip("/"))
    if not found:
        raise FileNotFoundError(f"no kept groups below {path}")
    return Dataset.of([open_cube(spark, folder, tuple(kept.dims)) for folder, kept in sorted(found.items(), key=lambda f: -len(f[1].dims))])


# Bits of a coordinate in an interleaved key.
BITS = 12


def _unused(name: str, names: Sequence[str]) -> str:
    while name in names:
        name += "_"
    return name


def interleaved(cube: Cube, frame: DataFrame, name: str) -> DataFrame:
    """The frame with a key of each cell, a bigint column `name`, whose bits are taken in turn from all its numeric coordinates,
    highest first, time before
    the last dimension and so on to the first: cells near
    in key are near along each dimension. Coordinates count in steps of their axis' extent, time in
    steps of a year; a missing one counts as the least."""
    scaled = []
    axes = {d: cube.axes[d] for d in cube.dims if d != TIME and isinstance(cube.dtype(d), NumericType)}
    ends = one_row_each({d: a.values.agg(
        F.min(d).cast("double").alias("low"), F.max(d).cast("double").alias("high")) for d, a in axes.items()}) if axes else {}
    if TIME in cube.dims:
        at = F.col(TIME)
        scaled.append((F.dayofyear(at) * 24 + F.hour(at)) / (367.0 * 24))
    for d in reversed(axes):
        low, high = ends[d]["low"], ends[d]["high"]
        if low is not None and high > low:
            scaled.append((F.col(d).cast("double") - low) / (high - low))
    if not scaled:
        return frame.withColumn(name, F.lit(0).cast("bigint"))
    bits, names = min(BITS, 62 // len(scaled)), list(frame.columns)
    steps = []
    for s in scaled:
        steps.append(_unused("step", [*names, *steps]))
        frame = frame.withColumn(steps[-1], F.coalesce(F.floor(s * (2**bits - 1)), F.lit(0)).cast("bigint"))
    # Each bit of a step goes to its place in the key.
    placed = [F.shiftleft(F.shiftright(F.col(step), bit).bitwiseAND(F.lit(1)), bit * len(steps) + len(steps) - 1 - k)
              for k, step in enumerate(steps) for bit in range(bits)]
    key = placed[0]
    for part in placed[1:]:
        key = key.bitwiseOR(part)
    return frame.withColumn(name, key).select(*names, name)


def keep_axes(spark: SparkSession, path: str, dims: Sequence[str], descending: Sequence[str] = ()) -> None:
    """Write the axes of a Parquet cube anew from its cells: for one stored by other means."""
    path = path.rstrip("/")
    before = snapshot.current(spark, path) or Manifest()
    stored = _cells(spark, path, before, before.cells) if before.schema else spark.read.parquet(path)
    timed = TIME in dims and YEAR in stored.columns
    axes = {d: stored.select(noted(d, d in descending)).distinct() for d in dims}
    now = replace(before, number=before.number + 1, axes={}, dims={})
    snapshot.commit(spark, path, _with_axes(spark, path, now, axes, timed, snapshot.new_version()))


def store_report(spark: SparkSession, path: str) -> DataFrame:
    """What the stores that are current have counted, as (request, years, kind, name, cells, missing,
    first, last): a row per variable with its missing values, and per dimension with its extent as text."""
    kept = snapshot.current(spark, path.rstrip("/")) or Manifest()
    rows = [(r["request"], r["years"], kind, name, r["cells"], *values)
            for r in kept.reports.values() for kind in ("dim", "var") for name, values in r[kind].items()]
    return spark.createDataFrame(
        rows, "request string, years array<string>, kind string, name string, cells bigint, missing bigint, first string, last string")


def _measures(cube: Cube) -> list[Column]:
    """Counts and extents that are taken while storing, without another pass."""
    out = [F.count(F.lit(1)).alias("cells")]
    for i, v in enumerate(cube.data_vars):
        out.append(F.count_if(F.col(v).isNull()).alias(f"missing{i}"))
    for i, d in enumerate(cube.dims):
        out += [F.min(d).cast("string").alias(f"first{i}"), F.max(d).cast("string").alias(f"last{i}")]
    return out


def _report(cube: Cube, seen: Mapping) -> dict:
    return {
        "cells": seen["cells"],
        "dim": {d: [None, seen[f"first{i}"], seen[f"last{i}"]] for i, d in enumerate(cube.dims)},
        "var": {v: [seen[f"missing{i}"], None, None] for i, v in enumerate(cube.data_vars)},
    }


def _with_axes(spark: SparkSession, path: str, now: Manifest, axes: Mapping[str, DataFrame], timed: bool, version: str) -> Manifest:
    """The state with these axes written, as they are, so that a place without a cell in
    what is stored keeps its position. In a cube by year each year on the time axis has all of every
    other axis, as far as it was written with that year. Positions run along the axes of all
    years and are ranked here, once. All axes at once."""
    years = [r[0] for r in axes[TIME].select(F.year(TIME)).where(F.col(TIME).isNotNull()).distinct().collect()] if timed else []
    versions = {**now.axes, **dict.fromkeys(map(str, years) if timed else [snapshot.WHOLE], version)}

    def keep(dim: str) -> dict:
        axis, folder = axes[dim], f"{path}/_axes/{dim}"
        by_year = axis
        if timed:
            each = F.explode(F.array(*map(F.lit, years)) if years else F.array().cast("array<int>"))
            by_year = axis.withColumn(YEAR, F.year(TIME) if dim == TIME else each)
        _append(by_year, folder, timed, version)
        parts, value = snapshot.existing(spark, folder, versions), axis.schema[dim]
        stored = spark.read.schema(axis.schema).option("basePath", folder).parquet(*parts).select(dim) if parts else axis.limit(0)
        values = stored.where(F.col(dim).isNotNull()).distinct()
        with ranked_once(values, [Axis(values).order], POSITION) as (ranks, n):
            ranks.coalesce(1).sortWithinPartitions(POSITION).write.parquet(f"{path}/_index/{dim}/{snapshot.VERSION}={version}")
        return {"field": value.jsonValue(), "length": n}

    with ThreadPoolExecutor() as pool:
        dims = dict(zip(axes, pool.map(keep, axes)))
    return replace(now, axes=versions, index=version, dims=dims)


def _append(frame: DataFrame, path: str, by_year: bool, version: str) -> None:
    keys = [*([YEAR] if by_year else []), snapshot.VERSION]
    frame.withColumn(snapshot.VERSION, F.lit(version)).write.mode("append").partitionBy(*keys).parquet(path)
