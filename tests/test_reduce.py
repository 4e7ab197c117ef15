import math
import warnings

import numpy as np
import pytest
from grids import cube, day, found

from pelagrid import season_mean, seasonality
from pelagrid.plans import tables

DAILY = "time timestamp_ntz, latitude double, so double"


def test_december_counts_with_january_and_february(spark):
    days = [(day(f"2001-{m:02d}-15"), 0.0, float(m)) for m in range(1, 13)]
    means = season_mean(cube(spark, DAILY, days, ("time", "latitude")))
    assert means.dims == ("season", "latitude")
    assert found(means.frame, "season", "so") == [
        ("DJF", 5.0), ("JJA", 7.0), ("MAM", 4.0), ("SON", 10.0)]


def test_climatology_pools_days_of_all_years(spark):
    days = [(day("2001-01-01"), 0.0, 1.0), (day("2001-01-02"), 0.0, 2.0), (day("2002-01-01"), 0.0, 9.0)]
    assert found(seasonality(cube(spark, DAILY, days, ("time", "latitude"))).frame) == [(1, 0.0, 4.0)]


def test_missing_values_are_skipped_and_an_all_missing_group_stays(spark):
    nan = math.nan
    days = [(day("2001-01-01"), 0.0, 1.0), (day("2001-01-02"), 0.0, nan), (day("2001-01-03"), 0.0, None),
            (day("2001-01-04"), 0.0, 3.0), (day("2001-02-01"), 0.0, nan)]
    assert found(seasonality(cube(spark, DAILY, days, ("time", "latitude"))).frame) == [
        (1, 0.0, 2.0), (2, 0.0, None)]


def test_only_labels_of_the_data_are_on_the_axis(spark):
    days = [(day("2001-07-01"), 0.0, 1.0), (day("2001-03-01"), 0.0, 2.0)]
    means = season_mean(cube(spark, DAILY, days, ("time", "latitude")))
    assert [r.season for r in means.axis("season").collect()] == ["JJA", "MAM"]
    with pytest.raises(KeyError):
        means.sel(season="DJF")


def test_mean_of_means_is_not_the_pooled_mean(spark):
    days = [(day("2001-01-01"), 0.0, 0.0, 10.0), (day("2001-01-02"), 0.0, 0.0, 20.0), (day("2001-01-01"), 0.0, 1.0, 100.0)]
    grid = cube(spark, "time timestamp_ntz, latitude double, longitude double, so double", days,
                ("time", "latitude", "longitude"))
    assert found(seasonality(grid).mean("longitude").frame) == [(1, 0.0, 57.5)]
    assert found(grid.mean("time", "longitude").frame)[0][1] == pytest.approx(130 / 3)


def test_mean_over_all_dimensions_is_one_row(spark):
    grid = cube(spark, "latitude double, so double, tx double", [(0.0, 1.0, 4.0), (1.0, 3.0, 8.0)], ("latitude",))
    assert found(grid.mean("latitude").frame) == [(2.0, 6.0)]


def test_float_variables_average_as_double(spark):
    grid = cube(spark, "latitude float, so float", [(0.0, 0.1), (1.0, 0.2)], ("latitude",))
    assert dict(grid.mean("latitude").frame.dtypes) == {"so": "double"}


def test_unknown_calendar_part_raises(spark):
    grid = cube(spark, DAILY, [(day("2001-01-01"), 0.0, 1.0)], ("time", "latitude"))
    with pytest.raises(KeyError):
        grid.group_mean("week")
    with pytest.raises(KeyError):
        grid.mean("depth")


def test_extents_name_both_ends(spark):
    grid = cube(spark, "latitude double, so double", [(0.0, 1.0), (1.0, 3.0), (2.0, None)], ("latitude",))
    assert grid.extents().first().asDict() == {
        "latitude_min": 0.0, "latitude_max": 2.0, "so_min": 1.0, "so_max": 3.0}


def test_means_against_numpy_on_whole_tables(spark, folder):
    """A second, independent computation: arrays over the whole grid."""
    field = tables.field(spark, folder)
    raw = field.frame.toPandas()
    month = raw["time"].dt.month.to_numpy()
    axes = [np.unique(month), *[np.unique(raw[d]) for d in ("depth", "latitude", "longitude")]]
    where = tuple(np.searchsorted(a, v) for a, v in zip(axes, (month, raw["depth"], raw["latitude"], raw["longitude"])))
    total, count = (np.zeros([len(a) for a in axes]) for _ in range(2))
    np.add.at(total, where, raw["so"].to_numpy())
    np.add.at(count, where, 1)
    with np.errstate(invalid="ignore"):
        clim = total / count
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        zonal = np.nanmean(clim, axis=3)
    got = seasonality(field.pick("so")).mean("longitude").frame.toPandas()
    at = tuple(np.searchsorted(a, got[d]) for a, d in zip(axes, ("month", "depth", "latitude")))
    assert len(got) == np.isfinite(zonal).sum()
    np.testing.assert_allclose(got["so"], zonal[at], rtol=1e-12)


def test_a_cell_without_a_time_is_in_no_group(spark):
    days = [(day("2001-01-01"), 0.0, 1.0), (None, 0.0, 7.0)]
    grid = cube(spark, DAILY, days, ("time", "latitude"))
    assert found(season_mean(grid).frame) == [("DJF", 0.0, 1.0)]
    assert found(seasonality(grid).frame) == [(1, 0.0, 1.0)]


def test_nan_is_missing_in_any_cube(spark):
    from pelagrid import Cube

    frame = spark.createDataFrame([(0.0, math.nan), (1.0, 3.0)], "latitude double, so double")
    assert found(Cube.of(frame, ("latitude",)).mean("latitude").frame) == [(3.0,)]
