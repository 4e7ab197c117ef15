import time

import pytest
from grids import cube, day, found, patch
from plans import plan_text
from pyspark.sql import functions as F

from pelagrid import from_frame


def test_slice_is_half_open_and_position_counts_from_the_last_selection(spark):
    inner = patch(spark).isel(latitude=slice(1, 3), longitude=slice(1, 3))
    assert inner.dims == ("latitude", "longitude")
    assert found(inner.frame, "so") == [(11.0,), (12.0,), (21.0,), (22.0,)]
    point = inner.isel(latitude=1, longitude=1)
    assert point.dims == () and found(point.frame) == [(22.0,)]


def test_int_and_slice_together(spark):
    row = patch(spark).isel(latitude=3, longitude=slice(2, 9))
    assert row.dims == ("longitude",)
    assert found(row.frame) == [(-2.0, 33.0), (-3.0, 32.0)]


def test_positions_from_the_end(spark):
    assert found(patch(spark).isel(latitude=0, longitude=slice(None, -3)).frame, "so") == [(0.0,)]
    assert found(patch(spark).isel(latitude=0, longitude=slice(-9, 1)).frame, "so") == [(0.0,)]
    assert patch(spark).isel(longitude=slice(None)).frame.count() == 16
    assert found(patch(spark).isel(latitude=-1, longitude=-4).frame) == [(30.0,)]
    assert found(patch(spark).isel(latitude=-1, longitude=slice(-2, None)).frame, "so") == [(32.0,), (33.0,)]


@pytest.mark.parametrize("where", [4, -5])
def test_position_outside_the_axis_raises(spark, where):
    with pytest.raises(IndexError):
        patch(spark).isel(latitude=where)


def test_slice_outside_the_axis_is_empty(spark):
    none = patch(spark).isel(latitude=slice(7, 9))
    assert none.frame.count() == 0 and none.axis("latitude").count() == 0
    with pytest.raises(IndexError):
        none.isel(latitude=0)


def test_slice_takes_no_step(spark):
    with pytest.raises(ValueError):
        patch(spark).isel(latitude=slice(0, 4, 2))


def test_a_hole_in_the_data_moves_no_position(spark):
    grid = patch(spark)
    corner = grid.sel_range(longitude=(-5, -5))
    assert corner.axis("longitude").count() == 1
    # The first longitude has data at one latitude only; latitude positions stay.
    holed = cube(spark, "latitude double, longitude double, so double",
                 [(1.0, 0.0, 1.0), (2.0, 1.0, 2.0), (3.0, 0.0, 3.0), (3.0, 1.0, 4.0)], ("latitude", "longitude"))
    assert found(holed.isel(longitude=0).isel(latitude=1).frame) == []
    assert found(holed.isel(longitude=0).isel(latitude=2).frame) == [(3.0,)]


def test_unknown_dimension_raises(spark):
    with pytest.raises(KeyError):
        patch(spark).isel(depth=0)
    with pytest.raises(KeyError):
        patch(spark).pick("thetao")


def test_label_drops_the_dimension_and_a_missing_one_raises(spark):
    grid = patch(spark)
    assert found(grid.sel(latitude=11.0).frame, "so") == [(10.0,), (11.0,), (12.0,), (13.0,)]
    with pytest.raises(KeyError):
        grid.sel(latitude=11.5)
    assert grid.sel(strict=False, latitude=11.5).frame.count() == 0


def test_float_axis_is_found_by_the_printed_number(spark):
    levels = cube(spark, "depth float, so float", [(0.49402499198913574, 1.0), (1.5413750410079956, 2.0)], ("depth",))
    assert found(levels.sel(depth=0.494025).frame) == [(1.0,)]
    assert found(levels.sel(depth=0.49402499198913574).frame) == [(1.0,)]
    assert levels.sel_range(depth=(0.494025, 1.0)).frame.count() == 1


def test_fractional_bounds_on_an_integer_axis(spark):
    levels = cube(spark, "depth int, so double", [(0, 1.0), (1, 2.0), (2, 3.0)], ("depth",))
    assert found(levels.sel_range(depth=(0.5, 1.5)).frame, "so") == [(2.0,)]
    assert levels.sel_range(depth=(None, 1)).frame.count() == 2
    assert levels.sel_range(depth=(1, None)).frame.count() == 2


def test_nearest_level_keeps_the_dimension_and_prefers_the_larger_on_a_tie(spark):
    levels = cube(spark, "depth double, so double", [(0.0, 1.0), (1.0, 2.0), (4.0, 3.0)], ("depth",))
    near = levels.sel_nearest(depth=1.2)
    assert near.dims == ("depth",) and found(near.frame) == [(1.0, 2.0)]
    assert found(levels.sel_nearest(depth=0.5).frame) == [(1.0, 2.0)]
    assert levels.sel_nearest(drop=True, depth=99).dims == ()


def test_time_range_is_closed_and_a_date_means_midnight(spark):
    days = cube(spark, "time timestamp_ntz, so double",
                [(day("2023-01-01"), 1.0), (day("2023-01-31"), 2.0), (day("2023-01-31T12:00"), 3.0)], ("time",))
    assert found(days.sel_time("2023-01-01", "2023-01-31").frame, "so") == [(1.0,), (2.0,)]


def test_squeeze_drops_axes_of_one_value_only(spark):
    thin = patch(spark).isel(latitude=slice(2, 3))
    assert thin.squeeze().dims == ("longitude",)
    assert patch(spark).squeeze().dims == ("latitude", "longitude")


def test_squeeze_looks_at_the_axis_not_at_the_surviving_cells(spark):
    holed = cube(spark, "latitude double, longitude double, so double",
                 [(1.0, 0.0, 1.0), (2.0, 1.0, 2.0)], ("latitude", "longitude"))
    assert holed.sel_range(longitude=(0, 0)).squeeze().dims == ("latitude",)


def test_rename_aligns_naming_schemes(spark):
    w = cube(spark, "lat double, lon double, w double", [(1.0, 2.0, 3.0)], ("latitude", "longitude"),
             rename={"lat": "latitude", "lon": "longitude"})
    assert w.dims == ("latitude", "longitude")
    back = w.rename({"latitude": "lat", "longitude": "lon"})
    assert found(back.isel(lat=0).frame) == [(2.0, 3.0)]
    with pytest.raises(ValueError):
        w.rename({"latitude": "longitude"})


def test_drop_dims_keeps_only_what_does_not_depend_on_them(spark):
    ocean = cube(spark, "depth int, latitude double, so double, zos double",
                 [(0, 1.0, 5.0, 0.1), (1, 1.0, 6.0, 0.1), (0, 2.0, 7.0, None)], ("depth", "latitude"))
    assert found(ocean.drop_dims("depth", keep=["zos"]).frame) == [(1.0, 0.1), (2.0, None)]
    assert ocean.drop_dims("depth").data_vars == ()


def test_time_in_dims_is_plain_membership(spark):
    assert "time" not in patch(spark).dims


def test_info_lists_axes_and_variables(spark):
    assert found(patch(spark).info()) == [
        ("dim", "latitude", "double", 4), ("dim", "longitude", "double", 4), ("var", "so", "double", None)]


def test_a_cube_prints_its_shape(spark):
    assert str(patch(spark)) == "Cube(latitude: double, longitude: double) of so: double"
    assert repr(patch(spark).drop_dims("latitude")) == "Cube(longitude: double) of nothing"


def test_values_come_in_axis_order_and_too_many_raise(spark):
    row = patch(spark).isel(latitude=1)
    assert row.values().column("so").to_pylist() == [10.0, 11.0, 12.0, 13.0]
    with pytest.raises(ValueError):
        patch(spark).values(most=15)


def test_positions_come_from_ranges(spark, monkeypatch):
    monkeypatch.setattr("pelagrid.ranks.RANGE", 2)
    axis = from_frame(spark.sql("select 10.0D + id % 4 as latitude, 1.0D as so from range(43)"), ("latitude",)).axes["latitude"]
    assert found(axis.positions) == [(10.0 + i, i) for i in range(4)]
    assert dict(axis.positions.dtypes)["position"] == "bigint"
    plan = plan_text(axis.positions)
    assert "SinglePartition" not in plan and "Python" not in plan


def test_chained_selections_scan_the_axis_once(spark):
    grid = patch(spark)
    grid.isel(latitude=slice(1, 3))
    assert grid.axes["latitude"].source.distinct().storageLevel.useMemory
    assert grid.isel(latitude=slice(1, 3)).axes["latitude"].source is grid.axes["latitude"].source


def test_positions_follow_a_descending_axis(spark):
    cells = [(float(lat), 10.0 * lat) for lat in range(4)]
    frame = spark.createDataFrame(cells, "lat double, so double")
    north = from_frame(frame, ("latitude",), rename={"lat": "latitude"}, descending=["latitude"])
    assert found(north.isel(latitude=0).frame) == [(30.0,)]
    assert found(north.isel(latitude=-1).frame) == [(0.0,)]
    assert found(north.isel(latitude=slice(1, 3)).isel(latitude=0).frame) == [(20.0,)]
    assert found(north.isel(latitude=slice(2, None)).frame, "so") == [(0.0,), (10.0,)]
    assert found(north.isel(latitude=slice(-1, None)).frame, "so") == [(0.0,)]
    assert [r.latitude for r in north.rename({"latitude": "y"}).rename({"y": "latitude"}).table().collect()] == [3, 2, 1, 0]
    axis = north.axes["latitude"]
    assert found(axis.positions) == [(0.0, 3), (1.0, 2), (2.0, 1), (3.0, 0)]


def test_positions_far_along_an_axis(spark):
    assert found(patch(spark).isel(latitude=2, longitude=slice(1, 3)).frame, "so") == [(21.0,), (22.0,)]
    assert found(patch(spark).isel(latitude=2, longitude=slice(3, None)).frame, "so") == [(23.0,)]


@pytest.fixture
def elsewhere(monkeypatch):
    """A driver in another time zone than the session."""
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    yield
    monkeypatch.undo()
    time.tzset()


def test_instants_with_a_zone_do_not_take_the_drivers_zone(spark, elsewhere):
    frame = spark.sql("""select timestamp'2001-01-01 00:00:00' + make_dt_interval(0, 6 * id) as time, double(id) as so
                         from range(4)""")
    track = from_frame(frame, ("time",))
    assert frame.schema["time"].dataType.simpleString() == "timestamp"
    assert found(track.isel(time=1).frame) == [(1.0,)]
    assert found(track.isel(time=slice(1, 3)).frame, "so") == [(1.0,), (2.0,)]
    assert found(track.isel(time=slice(3, None)).frame, "so") == [(3.0,)]
    assert found(track.sel_time("2001-01-01T06:00", "2001-01-01T12:00").frame, "so") == [(1.0,), (2.0,)]
    seconds = spark.sql("select double(timestamp'2001-01-01 11:00:00') as s").first().s
    assert found(track.sel_nearest(time=seconds).frame, "so") == [(2.0,)]


def test_a_variable_that_varies_is_not_kept_without_its_dimension(spark):
    grid = patch(spark)
    with pytest.raises(Exception, match="so varies along a dropped dimension"):
        grid.drop_dims("latitude", keep=["so"]).frame.collect()


def test_mean_without_names_is_over_all_dimensions(spark):
    assert found(patch(spark).mean().frame) == found(patch(spark).mean("latitude", "longitude").frame)
    assert patch(spark).mean().dims == ()


def test_chained_positions_are_offsets_of_one_ranking(spark, tmp_path, monkeypatch):
    """No selection ranks again or writes a table; an interval by label counts from its first position."""
    from pelagrid import axis as axes

    grid = patch(spark, 6)
    grid.positions("latitude")
    monkeypatch.setattr(axes, "ranked_in_memory", None)
    monkeypatch.setattr(axes, "ranked", None)
    inner = grid.isel(latitude=slice(1, 5)).isel(latitude=slice(1, None))
    assert inner.axes["latitude"].known == (2, 5) and inner.axes["latitude"].ranks is grid.axes["latitude"].ranks
    assert found(inner.positions("latitude")) == [(12.0, 0), (13.0, 1), (14.0, 2)]
    assert {r.so for r in inner.isel(latitude=-1).frame.collect()} == {40.0 + j for j in range(6)}
    labels = grid.sel_range(latitude=(11.5, 14))
    assert labels.axes["latitude"].span == (2, 5)
    assert {r.so for r in labels.isel(latitude=1).frame.collect()} == {30.0 + j for j in range(6)}
    with pytest.raises(IndexError):
        labels.isel(latitude=3)


def test_an_axis_with_gaps_is_ranked_anew(spark):
    grid = patch(spark)
    axis = grid.axes["latitude"].where(F.col("latitude") != 11.0)
    assert axis.span is None and axis.length == 3
    assert found(axis.positions) == [(10.0, 0), (12.0, 1), (13.0, 2)]
