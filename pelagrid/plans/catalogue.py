"""Registered queries over the given tables, each with SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..functions.timeparts import SEASONS, month_of, season_of
from ..operators import combine, plotdata
from ..operators.reduce import season_mean, seasonality
from ..session import shared_folder
from ..sources import store
from ..sources.request import open_dataset, subset, take_years
from . import tables, workflows

Query = Callable[[SparkSession, str], DataFrame]

# An isoline level that crosses the stand-in field, whose means lie around 5e6.
LEVEL = 4_000_000.0


def whole(value: str, name: str | None = None):
    """Column rounded half up to a whole number, so that a second mean over it
    is again a sum of whole numbers."""
    return F.floor(F.col(value) + 0.5).cast("double").alias(name or value)


def rounded_climatology(cube: Cube, var: str) -> Cube:
    clim = seasonality(cube.pick(var))
    return Cube.of(clim.frame.select(*clim.dims, whole(var)), clim.dims, (var,), clim.axes)


# -- acquisition ---------------------------------------------------------------

def subset_box(spark, folder):
    return open_dataset(
        spark, tables.catalog(folder), dataset_id="lines_daily", variables=["so"],
        minimum_longitude=0.02, maximum_longitude=0.06, minimum_latitude=10, maximum_latitude=20,
        start_datetime="1997-01-01T00:00:00", end_datetime="1997-12-31T00:00:00",
    ).frame


def subset_variables(spark, folder):
    return open_dataset(
        spark, tables.catalog(folder), dataset_id="lines_daily", variables=["so", "tx"],
        minimum_latitude=40, maximum_latitude=50,
    ).frame


def depth_nearest(spark, folder):
    return open_dataset(
        spark, tables.catalog(folder), dataset_id="lines_daily", variables=["so"],
        minimum_depth=2.3, maximum_depth=2.3,
    ).frame


def lazy_open(spark, folder):
    return open_dataset(
        spark, tables.catalog(folder), dataset_id="events_track", variables=["value"],
        start_datetime="2024-01-10", end_datetime="2024-01-20",
    ).frame


def year_requests(spark, folder):
    return take_years(tables.field(spark, folder).pick("so"), [1996, 1997, 1999]).frame


def multi_open(spark, folder):
    """Kept by year, opened again by glob, and summed up per year."""
    path = shared_folder(spark)
    store.write_cube(tables.field(spark, folder), path)
    cube = store.open_many(
        spark, f"{path}/year=*", ("time", *tables.PLACE), ("so", "tx"), slab="directory")
    return cube.frame.groupBy(F.year("time").alias("year")).agg(
        F.count("*").alias("cells"), F.avg("so").alias("so"), F.avg("tx").alias("tx"))


def reopened_subset(spark, folder):
    """Kept by year with its axes, then a box, a year and a level of it."""
    path = shared_folder(spark)
    store.write_cube(tables.field(spark, folder), path)
    cube = store.open_cube(spark, path, ("time", *tables.PLACE))
    cube = cube.sel_time("1998-01-01", "1998-12-31").sel_range(latitude=(10, 20))
    return cube.isel(depth=0).frame.drop("year")


def duplicates(spark, folder):
    return store.duplicate_cells(tables.field(spark, folder))


def info(spark, folder):
    return tables.field(spark, folder).info()


def subset_stored(spark, folder):
    """Stored under its default name, and opened again."""
    path = subset(
        spark, tables.catalog(folder), shared_folder(spark), dataset_id="lines_daily", variables=["so"],
        minimum_longitude=0.02, maximum_longitude=0.06, minimum_latitude=10, maximum_latitude=20)
    return store.open_cube(spark, path, ("time", *tables.PLACE)).frame.drop("year")


def subset_years_added(spark, folder):
    """The second request differs: the year that is stored is fetched again with the one that is not."""
    wanted = dict(output_directory=shared_folder(spark), output_filename="lines", dataset_id="lines_daily",
                  variables=["so"], force_download=False)
    subset(spark, tables.catalog(folder), years=[1996], **wanted)
    path = subset(spark, tables.catalog(folder), years=[1996, 1997], minimum_latitude=25, **wanted)
    cells = store.open_cube(spark, path, ("time", *tables.PLACE)).frame
    return cells.groupBy("year").agg(F.count("*").alias("cells"), F.max("so").alias("so"))


def year_replaced(spark, folder):
    """A year stored again for another box: the state opened before, and the one after."""
    wanted = dict(output_directory=shared_folder(spark), output_filename="lines", dataset_id="lines_daily", variables=["so"])
    path = subset(spark, tables.catalog(folder), years=[1996, 1997], **wanted)
    old = store.open_cube(spark, path, ("time", *tables.PLACE)).frame
    subset(spark, tables.catalog(folder), years=[1997], minimum_latitude=25, **wanted)
    new = store.open_cube(spark, path, ("time", *tables.PLACE)).frame
    both = old.withColumn("state", F.lit("old")).unionByName(new.withColumn("state", F.lit("new")))
    return both.groupBy("state", "year").agg(F.count("*").alias("cells"), F.min("latitude").alias("latitude"))


def store_counts(spark, folder):
    """What was counted while the cells were stored."""
    path = shared_folder(spark)
    store.write_cube(tables.holed_field(spark, folder), path)
    return store.store_report(spark, path).drop("request", "years")


def box_day_layout(spark, folder):
    """A box and a day of a store in interleaved order."""
    path = shared_folder(spark)
    whole = tables.field(spark, folder)
    store.write_cube(whole, path, files=32, layout="interleaved")
    back = store.open_cube(spark, path, whole.dims)
    box = back.sel_range(latitude=(10, 14), longitude=(0.02, 0.04)).frame.withColumn("part", F.lit("box"))
    day = back.sel_time("1997-03-05", "1997-03-05").frame.withColumn("part", F.lit("day"))
    return box.unionByName(day).drop("year")


def isel_stored(spark, folder):
    """Positions of a kept cube, from those that were stored with it."""
    path = shared_folder(spark)
    whole = tables.field(spark, folder)
    store.write_cube(whole, path)
    patch = store.open_cube(spark, path, whole.dims).isel(latitude=slice(10, 14), longitude=slice(4, 6))
    return patch.isel(latitude=1, longitude=1).frame.drop("year")


def year_refetched_empty(spark, folder):
    """A year stored again, for which the request now finds nothing."""
    wanted = dict(output_directory=shared_folder(spark), output_filename="lines", dataset_id="lines_daily")
    subset(spark, tables.catalog(folder), years=[1996, 1997], **wanted)
    path = subset(spark, tables.catalog(folder), years=[1997], minimum_latitude=1000, **wanted)
    cells = store.open_cube(spark, path, ("time", *tables.PLACE)).frame
    return cells.groupBy("year").agg(F.count("*").alias("cells"))


def store_descending(spark, folder):
    """Latitudes from north to south, kept under another name, opened by glob and rename."""
    path = shared_folder(spark)
    whole = tables.field(spark, folder).pick("so")
    south = Cube.of(whole.frame.withColumnRenamed("latitude", "y"), ("time", "depth", "y", "longitude"), descending=["y"])
    store.write_cube(south, path)
    cube = store.open_many(
        spark, f"{path}/year=199[67]", ("time", *tables.PLACE), rename={"y": "latitude"}, slab="directory")
    return cube.isel(latitude=1).frame.drop("year")


def store_sparse_axis(spark, folder):
    """Some latitudes have no cell in what is stored; positions stay."""
    path = shared_folder(spark)
    whole = tables.field(spark, folder).pick("so")
    kept = ~F.col("latitude").between(5, 15)
    holed = Cube.of(whole.frame.where(kept), whole.dims, whole.data_vars, whole.axes)
    store.write_cube(holed.sel_time("1998-01-01", None), path)
    return store.open_cube(spark, path, whole.dims).isel(latitude=30).frame.drop("year")


def combine_names(spark, folder):
    whole = tables.field(spark, folder)
    return store.combine([whole.pick("so").sel_range(depth=(None, 3)), whole.pick("tx").sel_range(depth=(4, None))]).frame


def mixed_dims(spark, folder):
    """A mean along depth leaves the variable without depth alone; then both on one grid."""
    return tables.mixed(spark, folder).mean("depth").cube("so", "zos").frame


def mixed_drop(spark, folder):
    """Without depth, and so without the variable that has it."""
    return tables.mixed(spark, folder).drop_dims("depth").cube().frame


def mixed_stored(spark, folder):
    """A surface variable split off the field, both stored as groups and opened again: the season means
    of a box, one level of the one beside the other."""
    whole = tables.field(spark, folder)
    flat = store.from_frame(whole.frame.where("depth = 1").groupBy("time", "latitude", "longitude").agg(
        F.max("tx").alias("tx")), ("time", "latitude", "longitude"))
    path = shared_folder(spark)
    store.write_dataset(store.combine([whole.pick("so"), flat]), path)
    data = store.open_groups(spark, path).isel(depth=1, latitude=slice(5, 9))
    return data.group_mean("season").cube("so", "tx").frame


# -- selection -----------------------------------------------------------------

def isel_point(spark, folder):
    return tables.field(spark, folder).isel(depth=2, latitude=10, longitude=3).frame


def isel_mixed(spark, folder):
    return tables.field(spark, folder).isel(depth=0, latitude=slice(3, 6), longitude=slice(8, 20)).frame


def isel_slice_chain(spark, folder):
    patch = tables.field(spark, folder).isel(latitude=slice(10, 14), longitude=slice(4, 6))
    return patch.isel(latitude=1, longitude=1).frame


def snapshot(spark, folder):
    return tables.field(spark, folder).isel(time=0).frame


def sel_season(spark, folder):
    return season_mean(tables.field(spark, folder).pick("so").isel(depth=0)).sel(season="JJA").frame


def squeezed(spark, folder):
    thin = tables.field(spark, folder).pick("so").isel(depth=slice(0, 1), longitude=slice(2, 3))
    return thin.squeeze().frame


def axis_positions(spark, folder):
    return tables.field(spark, folder).positions("longitude")


def drop_depth(spark, folder):
    return tables.surface(spark, folder).drop_dims("depth", keep=["zos"]).frame


def time_parts(spark, folder):
    time = F.col("time")
    return tables.field(spark, folder).axes["time"].values.select(
        time, month_of(time).alias("month"), season_of(time).alias("season"))


# -- means ---------------------------------------------------------------------

def month_clim(spark, folder):
    return seasonality(tables.field(spark, folder).pick("so")).frame


def month_clim_surface(spark, folder):
    return seasonality(tables.field(spark, folder).isel(depth=0)).frame


def month_clim_chl(spark, folder):
    return seasonality(tables.chl(spark, folder)).frame


def season_means(spark, folder):
    return season_mean(tables.field(spark, folder)).frame


def season_means_chl(spark, folder):
    return season_mean(tables.chl(spark, folder)).frame


def skipna(spark, folder):
    return seasonality(tables.holed_field(spark, folder)).frame


def zonal_of_clim(spark, folder):
    return rounded_climatology(tables.field(spark, folder), "so").mean("longitude").frame


def zonal_daily(spark, folder):
    return plotdata.hovmoller(tables.field(spark, folder), "so")


def time_mean(spark, folder):
    return tables.field(spark, folder).mean("time").frame


def season_null_time(spark, folder):
    """Cells without a time are in no season."""
    whole = tables.field(spark, folder).pick("so")
    frame = whole.frame.withColumn("time", F.when(F.col("depth") < 7, F.col("time")))
    surface = frame.select("time", "latitude", "so")
    return season_mean(store.from_frame(surface, ("time", "latitude"))).frame


def mean_all_dims(spark, folder):
    return tables.field(spark, folder).mean().frame


def robust_hot_value(spark, folder):
    """One value fills over half of the cells."""
    whole = tables.field(spark, folder).pick("so")
    so = F.when(F.col("depth") <= 4, 3_000_000.0).otherwise(F.col("so"))
    return six(store.from_frame(whole.frame.withColumn("so", so), whole.dims).robust_limits("so"))


def robust_facets(spark, folder):
    means = season_mean(tables.field(spark, folder).pick("so"))
    return six(means.robust_limits("so"))


def robust_section(spark, folder):
    daily = tables.field(spark, folder).pick("so").mean("longitude")
    return six(daily.robust_limits("so"))


def six(limits: DataFrame) -> DataFrame:
    """Interpolated values, to six decimals."""
    return limits.select(F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


def extents(spark, folder):
    return season_mean(tables.field(spark, folder).pick("so")).extents("so", "latitude", "longitude")


def clim_incremental(spark, folder):
    """Monthly means from kept sums, after one year was replaced by a smaller box of it."""
    path = shared_folder(spark)
    whole = tables.field(spark, folder)
    store.write_cube(whole, path, partials=True)
    store.write_cube(whole.sel_time("1998-01-01", "1998-12-31").sel_range(latitude=(25, None)), path)
    return store.open_means(spark, path).frame


def clim_seasons_kept(spark, folder):
    """Seasonal means from kept sums, with cells that are missing everywhere."""
    path = shared_folder(spark)
    store.write_cube(tables.holed_field(spark, folder), path, partials=True)
    return store.open_means(spark, path, "season").isel(latitude=slice(0, 4)).frame


# -- profiles and overlays -----------------------------------------------------

def _vertical(spark, folder) -> Cube:
    """Time-mean vertical component: a variable of its own on levels of its own,
    named lat/lon as its source has it."""
    whole = tables.field(spark, folder)
    frame = whole.frame.select(
        "time", (F.col("depth") * 10.0).alias("depth"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), (F.col("so") * 2 + F.col("tx")).alias("w"))
    return store.from_frame(frame, ("time", "depth", "lat", "lon")).mean("time")


def profile_table(spark, folder):
    vertical = _vertical(spark, folder).rename({"lat": "latitude", "lon": "longitude"})
    return workflows.velocity_profile(
        tables.field(spark, folder), vertical, None, (slice(20, 22), slice(4, 6)), (1, 1), ("so", "tx", "w"))


def profile_instant(spark, folder):
    """Horizontal components at one instant beside a time-mean vertical one."""
    vertical = _vertical(spark, folder).rename({"lat": "latitude", "lon": "longitude"})
    return workflows.velocity_profile(
        tables.yearly(spark, folder), vertical, 2, (slice(20, 22), slice(4, 6)), (1, 1), ("so", "tx", "w"))


def profile_series(spark, folder):
    return combine.profile_series(profile_table(spark, folder), workflows.DEPTH)


def profile_window(spark, folder):
    line = _vertical(spark, folder).isel(lat=slice(20, 22), lon=slice(4, 6)).isel(lat=1, lon=1)
    return plotdata.profile_line(line, "w", window=(0, 50), downward=True)


def plume_layers(spark, folder):
    maps = workflows.plume_maps(tables.field(spark, folder), tables.chl(spark, folder), level=LEVEL)
    return maps.layers.select(
        "layer", "season", "latitude", "segment", "CHL", "edge", "longitude", "label"
    ).withColumns({"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6)})


def overlay_seasons(spark, folder):
    green = season_mean(tables.chl(spark, folder))
    salt = season_mean(tables.field(spark, folder).pick("so").isel(depth=0))
    layers = combine.overlay(green, "chl", {"salt": salt.frame}, on="season")
    return layers.withColumn("latitude", F.col("latitude").cast("double"))


# -- what the plots need -------------------------------------------------------

def facet_pivot(spark, folder):
    return plotdata.facet(tables.field(spark, folder).isel(depth=0), "so", "season", sorted(SEASONS))


def facet_labels(spark, folder):
    return plotdata.facet_labels(season_mean(tables.field(spark, folder)), "season")


def isoline(spark, folder):
    surface = season_mean(tables.field(spark, folder).pick("so").isel(depth=0))
    points = plotdata.isoline(surface, "so", LEVEL, by=["season"])
    return points.select("season", "edge", F.round("latitude", 6).alias("latitude"),
                         F.round("longitude", 6).alias("longitude"))


def isoline_segments(spark, folder):
    surface = season_mean(tables.field(spark, folder).pick("so").isel(depth=0))
    pieces = plotdata.isoline_segments(surface, "so", LEVEL, by=["season"])
    ends = [f"{d}_{end}" for d in ("latitude", "longitude") for end in ("from", "to")]
    return pieces.select("season", *[F.round(c, 6).alias(c) for c in ends])


def _month_section(spark, folder) -> Cube:
    """Month by latitude means of the top level."""
    return rounded_climatology(tables.field(spark, folder).isel(depth=0), "so").mean("longitude")


def bands(spark, folder):
    return plotdata.bands(_month_section(spark, folder), "so", low=0, step=500_000)


def robust_bands(spark, folder):
    return workflows.robust_bands(_month_section(spark, folder), "so")


def hovmoller_clip(spark, folder):
    return plotdata.clipped(_month_section(spark, folder), "so", 2_000_000, 6_000_000)


def hovmoller_chl(spark, folder):
    clim = rounded_climatology(tables.chl(spark, folder), "CHL")
    return plotdata.hovmoller(clim, "CHL", x="month", along="segment")


QUERIES: dict[str, Query] = {
    "q_subset_box": subset_box,
    "q_subset_variables": subset_variables,
    "q_depth_nearest": depth_nearest,
    "q_lazy_open": lazy_open,
    "q_year_requests": year_requests,
    "q_multi_open": multi_open,
    "q_reopened_subset": reopened_subset,
    "q_duplicate_cells": duplicates,
    "q_info": info,
    "q_isel_point": isel_point,
    "q_isel_mixed": isel_mixed,
    "q_isel_slice_chain": isel_slice_chain,
    "q_snapshot": snapshot,
    "q_sel_season": sel_season,
    "q_squeeze": squeezed,
    "q_axis_positions": axis_positions,
    "q_drop_dims": drop_depth,
    "q_time_parts": time_parts,
    "q_month_clim": month_clim,
    "q_month_clim_surface": month_clim_surface,
    "q_month_clim_chl": month_clim_chl,
    "q_season_mean": season_means,
    "q_season_mean_chl": season_means_chl,
    "q_skipna": skipna,
    "q_zonal_of_clim": zonal_of_clim,
    "q_zonal_daily": zonal_daily,
    "q_time_mean": time_mean,
    "q_robust_limits": robust_facets,
    "q_robust_section": robust_section,
    "q_extents": extents,
    "q_profile_table": profile_table,
    "q_profile_long": profile_series,
    "q_profile_window": profile_window,
    "q_overlay_season": overlay_seasons,
    "q_plume_layers": plume_layers,
    "q_facet_pivot": facet_pivot,
    "q_facet_labels": facet_labels,
    "q_isoline": isoline,
    "q_bands": bands,
    "q_robust_bands": robust_bands,
    "q_hovmoller_clip": hovmoller_clip,
    "q_hovmoller_chl": hovmoller_chl,
    "q_season_null_time": season_null_time,
    "q_mean_all_dims": mean_all_dims,
    "q_robust_hot_value": robust_hot_value,
    "q_subset_stored": subset_stored,
    "q_subset_years_added": subset_years_added,
    "q_year_refetched_empty": year_refetched_empty,
    "q_store_descending": store_descending,
    "q_store_sparse_axis": store_sparse_axis,
    "q_combine_names": combine_names,
    "q_profile_instant": profile_instant,
    "q_isel_stored": isel_stored,
    "q_box_day_layout": box_day_layout,
    "q_clim_incremental": clim_incremental,
    "q_clim_seasons_kept": clim_seasons_kept,
    "q_isoline_segments": isoline_segments,
    "q_mixed_dims": mixed_dims,
    "q_mixed_drop": mixed_drop,
    "q_mixed_stored": mixed_stored,
    "q_year_replaced": year_replaced,
    "q_store_report": store_counts,
}
