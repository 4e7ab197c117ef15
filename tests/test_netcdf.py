import sys
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from classic import write
from grids import found

from pelagrid import season_mean, write_cube, open_cube
from pelagrid.sources.netcdf import Classic, cut, instants, open_file, open_netcdf

# The smallest example in the format's public description: short vx(dim), values 3 1 4 1 5.
TINY = bytes.fromhex(
    "43444601 00000000 0000000A 00000001 00000003 64696D00 00000005 00000000 00000000 0000000B 00000001"
    "00000002 76780000 00000001 00000000 00000000 00000000 00000003 0000000C 00000050"
    "0003 0001 0004 0001 0005 8001")


def test_published_example():
    (vx,) = Classic(np.frombuffer(TINY, np.uint8), 1).variables().values()
    assert vx.dims == ("dim",) and vx.data.tolist() == [3, 1, 4, 1, 5]


def ocean(path, first_day=0, days=3, version=1, records=None):
    """so(time, depth, latitude, longitude), packed zos(time, latitude, longitude)."""
    rng = np.random.default_rng(first_day)
    so = rng.integers(300, 370, (days, 2, 3, 4)).astype("f4") / 10
    so[0, 0, 0, 0] = np.float32(1e20)
    so[0, 0, 0, 1] = np.nan
    tiny = rng.integers(0, 100, (days, 3, 4)).astype("i2")
    tiny[0, 0, 0] = -1
    write(path, {"time": None, "depth": 2, "latitude": 3, "longitude": 4}, {
        "depth": (("depth",), {}, np.array([0.49402499, 1.541375], "f4")),
        "latitude": (("latitude",), {"units": "degrees_north"}, np.array([-10, 0, 10], "f4")),
        "longitude": (("longitude",), {}, np.array([-75, -65, -55, -45], "f4")),
        "time": (("time",), {"units": "hours since 1950-01-01", "calendar": "gregorian"},
                 (np.arange(days, dtype="i4") + 18262 + first_day) * np.int32(24)),
        "so": (("time", "depth", "latitude", "longitude"), {"_FillValue": np.float32(1e20)}, so),
        "zos": (("time", "latitude", "longitude"),
                {"_FillValue": np.int16(-1), "scale_factor": np.float64(0.5), "add_offset": np.float64(10)}, tiny),
    }, version=version, records=records)
    return so, tiny


@pytest.mark.parametrize("version, records", [(1, None), (2, None), (5, None), (1, -1)])
def test_every_cell_arrives(spark, tmp_path, version, records):
    so, _ = ocean(f"{tmp_path}/a.nc", version=version, records=records)
    cube = open_netcdf(spark, f"{tmp_path}/a.nc", ["so"])
    assert cube.dims == ("time", "depth", "latitude", "longitude")
    assert cube.frame.dtypes == [("time", "timestamp_ntz"), ("depth", "float"), ("latitude", "float"),
                                 ("longitude", "float"), ("so", "float")]
    got = np.array([np.nan if v is None else v for v in cube.values().column("so").to_pylist()])
    expected = so.ravel().astype(float)
    expected[:2] = np.nan
    np.testing.assert_allclose(got, expected)
    assert cube.axis("time").first().time == datetime(2000, 1, 1)


def test_packed_values_are_unpacked_and_holes_missing(spark, tmp_path):
    _, tiny = ocean(f"{tmp_path}/a.nc")
    got = open_netcdf(spark, f"{tmp_path}/a.nc", ["zos"]).values().column("zos").to_pylist()
    assert got[0] is None and got[1:] == (tiny.ravel()[1:] * 0.5 + 10).tolist()


def test_variables_default_to_the_widest(spark, tmp_path):
    ocean(f"{tmp_path}/a.nc")
    assert open_netcdf(spark, f"{tmp_path}/a.nc").data_vars == ("so",)
    with pytest.raises(Exception, match="share one set"):
        open_netcdf(spark, f"{tmp_path}/a.nc", ["so", "zos"])


def test_slabs_and_selection_change_nothing(spark, tmp_path):
    ocean(f"{tmp_path}/a.nc")
    cube = open_netcdf(spark, f"{tmp_path}/a.nc", ["so"])
    slabs = spark.read.format("netcdf").options(variables="so", slab_cells="5").load(f"{tmp_path}/a.nc")
    assert slabs.rdd.getNumPartitions() > 10
    assert found(slabs.selectExpr("time", "depth", "latitude", "longitude", "nanvl(so, null) so")) == found(cube.frame)
    box = cube.sel_range(latitude=(-5, 10), longitude=(-70, -50)).sel_time("2000-01-02", "2000-01-03").isel(depth=1)
    whole = [r for r in cube.frame.collect() if r.latitude >= -5 and -70 <= r.longitude <= -50 and r.depth > 1
             and r.time >= datetime(2000, 1, 2)]
    assert len(whole) == 8
    assert found(box.frame, "time", "so") == sorted(((r.time, r.so) for r in whole), key=str)


def test_bounds_narrow_what_is_read(spark, tmp_path):
    ocean(f"{tmp_path}/a.nc")
    bounds = {"time": ("2000-01-02", "2000-01-02"), "longitude": (-60, None), "latitude": (None, 0), "depth": (0.494025, 1)}
    cube = open_netcdf(spark, f"{tmp_path}/a.nc", ["so"], bounds=bounds)
    whole = open_netcdf(spark, f"{tmp_path}/a.nc", ["so"])
    assert cube.frame.count() == 4
    assert found(cube.frame) == found(whole.sel_range(**bounds).frame)
    assert [r.longitude for r in cube.axis("longitude").collect()] == [-55.0, -45.0]
    cells = spark.read.format("netcdf").options(
        variables="so", slab_cells="1", bounds='{"longitude": [-60, null], "latitude": [null, 0]}').load(f"{tmp_path}/a.nc")
    assert cells.rdd.getNumPartitions() == 3 * 2 * 2 * 2
    nothing = open_netcdf(spark, f"{tmp_path}/a.nc", ["so"], bounds={"latitude": (50, 60)})
    assert nothing.frame.count() == 0


def test_one_query_does_not_change_the_next(spark, tmp_path):
    ocean(f"{tmp_path}/a.nc")
    cube = open_netcdf(spark, f"{tmp_path}/a.nc", ["so"])
    assert cube.isel(depth=1).frame.count() == 36
    assert cube.frame.count() == 72


def test_many_files_by_glob(spark, tmp_path):
    for year, first in ((2000, 0), (2001, 366)):
        ocean(f"{tmp_path}/salt_{year}.nc", first)
    cube = open_netcdf(spark, f"{tmp_path}/salt_*.nc", ["so"])
    assert cube.axis("time").count() == 6 and cube.frame.count() == 6 * 24
    assert season_mean(cube).isel(depth=0, latitude=1).sel(season="DJF").frame.count() == 4
    write_cube(cube, f"{tmp_path}/store")
    back = open_cube(spark, f"{tmp_path}/store", cube.dims)
    assert found(back.frame.drop("year")) == found(cube.frame)


def test_overlapping_files_raise(spark, tmp_path):
    ocean(f"{tmp_path}/a.nc", 0)
    ocean(f"{tmp_path}/b.nc", 2)
    with pytest.raises(ValueError, match="overlapping time"):
        open_netcdf(spark, f"{tmp_path}/*.nc", ["so"])


def test_renamed_dimensions(spark, tmp_path):
    write(f"{tmp_path}/w.nc", {"depth": 2, "lat": 2, "lon": 2}, {
        "lat": (("lat",), {}, np.array([1, 2], "f8")), "lon": (("lon",), {}, np.array([3, 4], "f8")),
        "w": (("depth", "lat", "lon"), {}, np.arange(8, dtype="f8").reshape(2, 2, 2))})
    w = open_netcdf(spark, f"{tmp_path}/w.nc", ["w"], {"lat": "latitude", "lon": "longitude"})
    assert found(w.isel(latitude=1, longitude=slice(0, 1)).squeeze().frame) == [(0, 2.0), (1, 6.0)]


def test_other_formats_say_what_they_need(tmp_path):
    (tmp_path / "four.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(RuntimeError, match="netCDF4 package"):
        open_file(f"{tmp_path}/four.nc")


def test_a_netcdf4_variable_is_taken_as_it_is(tmp_path, monkeypatch):
    """The package's own interface, stood in for: it is not installed here."""

    class Stored(np.ndarray):
        dimensions = ("depth",)
        ncattrs = staticmethod(lambda: ["_FillValue", "scale_factor"])
        getncattr = staticmethod({"_FillValue": np.int16(-9), "scale_factor": 0.1}.__getitem__)

    values = np.array([10, -9, 30], "i2").view(Stored)
    dataset = SimpleNamespace(variables={"w": values}, set_auto_maskandscale=lambda on: None)
    monkeypatch.setitem(sys.modules, "netCDF4", SimpleNamespace(Dataset=lambda path: dataset))
    (tmp_path / "four.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    w = open_file(f"{tmp_path}/four.nc")["w"]
    assert w.dims == ("depth",) and w.decoded((slice(0, 3),)).tolist() == [pytest.approx(1), None, pytest.approx(3)]


@pytest.mark.parametrize("units, value, expected", [
    ("days since 1950-1-1", 1, "1950-01-02"), ("seconds since 1970-01-01 00:00:00", 90, "1970-01-01T00:01:30"),
    ("minutes since 2000-01-01T12:00:00Z", 0.5, "2000-01-01T12:00:30"),
    ("hours since 1981-01-01 00:00:00 UTC", 12, "1981-01-01T12:00")])
def test_time_units(units, value, expected):
    assert instants(np.array([value]), {"units": units})[0] == np.datetime64(expected)


def test_unknown_time_reference_raises():
    with pytest.raises(ValueError):
        instants(np.array([1]), {"units": "months since 2000-01-01"})
    with pytest.raises(ValueError):
        instants(np.array([1]), {"units": "days since 2000-01-01", "calendar": "360_day"})


@pytest.mark.parametrize("most", [1, 5, 7, 24, 1000])
def test_boxes_fill_the_whole_once(most):
    seen = np.zeros((3, 4, 5), int)
    for box in cut([(0, 3), (0, 4), (0, 5)], most):
        where = tuple(slice(a, b) for a, b in box)
        assert seen[where].size <= max(most, 1)
        seen[where] += 1
    assert (seen == 1).all()
    assert list(cut([(0, 3), (0, 0)], 5)) == []


def test_latitudes_stored_from_north_to_south(spark, tmp_path):
    write(f"{tmp_path}/d.nc", {"latitude": 3}, {
        "latitude": (("latitude",), {}, np.array([30, 20, 10], "f4")),
        "so": (("latitude",), {}, np.array([3, 2, 1], "f4"))})
    cube = open_netcdf(spark, f"{tmp_path}/d.nc", ["so"])
    assert found(cube.isel(latitude=0).frame) == [(3.0,)]
    assert cube.values().column("so").to_pylist() == [3.0, 2.0, 1.0]
