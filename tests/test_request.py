import json
import logging

import pytest
from grids import cube, day, found
from test_netcdf import ocean

from pelagrid import Catalog, Product, Request, open_cube, open_dataset, store_report, subset, take_years, write_cube
from pelagrid.jobs import acquire
from pelagrid.sources import snapshot
from pelagrid.sources.request import credentials

DIMS = ("time", "depth", "latitude", "longitude")


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('shelf')}/ocean"
    times = ["2000-01-01", "2000-12-31", "2000-12-31T12:00", "2001-06-01", "2002-01-01"]
    cells = [(day(t), z, la, lo, la + lo, z) for t in times for z in (0.49402499198913574, 1.5413750410079956)
             for la in (-10.0, 0.0, 31.0) for lo in (-75.0, -35.0)]
    write_cube(cube(spark, "time timestamp_ntz, depth float, latitude float, longitude float, so float, thetao float",
                    cells, DIMS), path)
    return Catalog({"ocean": Product(path, DIMS), "closed": Product(path, DIMS, login=True)})


BOX = dict(dataset_id="ocean", variables=["so"], minimum_longitude=-75, maximum_longitude=-40,
           minimum_latitude=-10, maximum_latitude=30, minimum_depth=0.49402499198913574,
           maximum_depth=0.49402499198913574)


def test_open_selects_variable_box_level_and_time(spark, shelf):
    got = open_dataset(spark, shelf, **BOX, start_datetime="2000-01-01T00:00:00", end_datetime="2000-12-31T00:00:00")
    assert got.dims == DIMS and got.data_vars == ("so",)
    assert found(got.frame, "latitude", "longitude") == [(-10.0, -75.0)] * 2 + [(0.0, -75.0)] * 2
    assert got.isel(depth=0).squeeze().dims == ("time", "latitude")


def test_without_depth_all_levels_come(spark, shelf):
    got = open_dataset(spark, shelf, dataset_id="ocean", start_datetime="2002-01-01", end_datetime="2002-01-01")
    assert got.frame.count() == 12 and got.data_vars == ("so", "thetao")


def test_year_requests_lose_what_is_after_the_last_midnight(spark, shelf):
    whole = open_dataset(spark, shelf, dataset_id="ocean").isel(depth=0, latitude=0, longitude=0)
    assert {str(r.time) for r in take_years(whole, [2000, 2002]).frame.collect()} == {
        "2000-01-01 00:00:00", "2000-12-31 00:00:00", "2002-01-01 00:00:00"}
    assert take_years(whole, [2000, 2002]).axis("time").count() == 3
    with pytest.raises(ValueError):
        take_years(whole, [])


def test_subset_is_stored_by_year_under_a_default_name(spark, shelf, tmp_path):
    path = subset(spark, shelf, str(tmp_path), years=range(2000, 2002), **BOX)
    assert path == f"{tmp_path}/ocean_so_-75..-40E_-10..30N_0.49402499198913574..0.49402499198913574m"
    assert sorted({r.year for r in open_cube(spark, path, DIMS).frame.collect()}) == [2000, 2001]


def test_existing_subset_stays_without_force(spark, shelf, tmp_path):
    first = dict(output_filename="part", dataset_id="ocean", variables=["so"])
    path = subset(spark, shelf, str(tmp_path), **first, start_datetime="2002-01-01")
    subset(spark, shelf, str(tmp_path), force_download=False, **first, end_datetime="2000-01-01")
    assert open_cube(spark, path, DIMS).axis("time").count() == 1
    subset(spark, shelf, str(tmp_path), force_download=True, **first, end_datetime="2000-01-01")
    assert [str(r.time) for r in open_cube(spark, path, DIMS).axis("time").collect()] == ["2000-01-01 00:00:00"]


def test_years_stored_again_leave_the_others(spark, shelf, tmp_path):
    part = dict(output_filename="years", dataset_id="ocean", variables=["so"])
    path = subset(spark, shelf, str(tmp_path), years=[2001, 2002], **part)
    subset(spark, shelf, str(tmp_path), years=[2000], **part)
    subset(spark, shelf, str(tmp_path), years=[2001], minimum_latitude=0, **part)
    cells = open_cube(spark, path, DIMS).frame.groupBy("year").count()
    assert found(cells) == [(2000, 24), (2001, 8), (2002, 12)]


def test_failure_is_logged_and_raised_again(spark, shelf, tmp_path, caplog):
    with caplog.at_level(logging.ERROR), pytest.raises(KeyError):
        subset(spark, shelf, str(tmp_path), dataset_id="ocean", variables=["no_such"])
    assert "failed" in caplog.text
    with pytest.raises(KeyError):
        open_dataset(spark, shelf, dataset_id="nowhere")


def test_credentials_come_from_outside_the_code(spark, shelf, monkeypatch):
    monkeypatch.delenv("PELAGRID_USER", raising=False)
    with pytest.raises(PermissionError):
        open_dataset(spark, shelf, dataset_id="closed")
    monkeypatch.setenv("PELAGRID_USER", "someone")
    monkeypatch.setenv("PELAGRID_PASSWORD", "something")
    assert credentials(spark) == {"user": "someone", "password": "something"}
    assert open_dataset(spark, shelf, dataset_id="closed").data_vars == ("so", "thetao")


def test_request_for_a_year():
    wanted = Request("ocean").for_year(2004)
    assert (wanted.start_datetime, wanted.end_datetime) == ("2004-01-01T00:00:00", "2004-12-31T00:00:00")


def test_acquire_from_the_command_line(spark, shelf, tmp_path):
    product = shelf.products["ocean"]
    listing = tmp_path / "products.json"
    listing.write_text(json.dumps({"ocean": {"path": product.path, "dims": list(DIMS)}}))
    path = acquire.main(["--catalog", str(listing), "--output", str(tmp_path), "--name", "part", "--dataset", "ocean",
                         "--variables", "so", "--longitude", "-75", "-40", "--latitude", "-10", "30",
                         "--depth", "0.494", "0.494", "--years", "2000", "2001"])
    assert found(open_cube(spark, path, DIMS).mean(*DIMS).frame) == [(-80.0,)]


def test_a_product_of_netcdf_files(spark, tmp_path):
    for first in (0, 366):
        ocean(f"{tmp_path}/salt_{first}.nc", first)
    shelf = Catalog({"files": Product(f"{tmp_path}/salt_*.nc", DIMS, fmt="netcdf")})
    got = open_dataset(spark, shelf, dataset_id="files", variables=["so"], minimum_longitude=-65, maximum_longitude=-50,
                       minimum_depth=0.5, maximum_depth=0.5, start_datetime="2000-01-03", end_datetime="2001-01-01")
    assert got.dims == DIMS and got.isel(depth=0).frame.count() == 2 * 3 * 2
    path = subset(spark, shelf, str(tmp_path), "kept", years=[2001], dataset_id="files", variables=["so"])
    assert open_cube(spark, path, DIMS).frame.count() == 72


def test_requests_that_differ_have_different_names():
    base = dict(dataset_id="ocean", variables=["so"], minimum_longitude=1.0000001, maximum_longitude=2)
    names = {Request(**base, start_datetime=t).default_name() for t in ("2000-01-01T00:00", "2000-01-01T12:00")}
    names.add(Request(**{**base, "minimum_longitude": 1.0000002}, start_datetime="2000-01-01T00:00").default_name())
    assert len(names) == 3


def test_only_missing_years_are_fetched_without_force(spark, shelf, tmp_path):
    part = dict(output_filename="years", dataset_id="ocean", variables=["so"], force_download=False)
    path = subset(spark, shelf, str(tmp_path), years=[2000], **part)
    before = snapshot.current(spark, path)
    subset(spark, shelf, str(tmp_path), years=[2000, 2001], **part)
    assert found(open_cube(spark, path, DIMS).frame.groupBy("year").count()) == [(2000, 24), (2001, 12)]
    assert snapshot.current(spark, path).cells["2000"] == before.cells["2000"]


def test_a_store_by_year_does_not_mix_requests(spark, shelf, tmp_path):
    part = dict(output_filename="years", dataset_id="ocean", variables=["so"], force_download=False)
    path = subset(spark, shelf, str(tmp_path), years=[2000], **part)
    subset(spark, shelf, str(tmp_path), years=[2000, 2001], minimum_latitude=0, **part)
    assert found(open_cube(spark, path, DIMS).frame.groupBy("year").count()) == [(2000, 16), (2001, 8)]


def test_a_store_that_breaks_off_leaves_the_old_state(spark, shelf, tmp_path, monkeypatch):
    part = dict(output_filename="years", dataset_id="ocean", variables=["so"])
    path = subset(spark, shelf, str(tmp_path), years=[2000, 2001], **part)
    with monkeypatch.context() as broken:
        broken.setattr(snapshot, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            subset(spark, shelf, str(tmp_path), years=[2001], minimum_latitude=0, **part)
    back = open_cube(spark, path, DIMS)
    assert found(back.frame.groupBy("year").count()) == [(2000, 24), (2001, 12)]
    assert back.axis("latitude").count() == 3 and back.isel(latitude=0).frame.count() == 12


def test_a_cube_opened_before_a_commit_stays_whole(spark, shelf, tmp_path):
    part = dict(output_filename="years", dataset_id="ocean", variables=["so"])
    path = subset(spark, shelf, str(tmp_path), years=[2000, 2001], **part)
    old = open_cube(spark, path, DIMS)
    subset(spark, shelf, str(tmp_path), years=[2001], minimum_latitude=0, **part)
    assert found(old.frame.groupBy("year").count()) == [(2000, 24), (2001, 12)]
    assert found(open_cube(spark, path, DIMS).frame.groupBy("year").count()) == [(2000, 24), (2001, 8)]
    for _ in range(2):
        subset(spark, shelf, str(tmp_path), years=[2001], minimum_latitude=0, **part)
    versions = {p.name for p in (tmp_path / "years" / "year=2001").iterdir()}
    assert len(versions) == 2 and len(list((tmp_path / "years" / "_manifest").glob("*.json"))) == 2


def test_two_writers_at_once_do_not_both_commit(spark, shelf, tmp_path):
    path = subset(spark, shelf, str(tmp_path), "part", dataset_id="ocean", variables=["so"])
    with pytest.raises(RuntimeError, match="at the same time"):
        snapshot.commit(spark, path, snapshot.current(spark, path))


def test_what_is_stored_is_counted_on_the_way(spark, shelf, tmp_path, caplog):
    with caplog.at_level(logging.INFO):
        path = subset(spark, shelf, str(tmp_path), "part", years=[2000, 2001], dataset_id="ocean", variables=["so"])
    assert "'cells': 36" in caplog.text
    report = {(r.kind, r["name"]): r for r in store_report(spark, path).collect()}
    assert report["var", "so"].cells == 36 and report["var", "so"].missing == 0
    assert report["dim", "latitude"]["first"] == "-10.0" and report["dim", "latitude"]["last"] == "31.0"
    assert report["var", "so"].request == "ocean_so" and report["var", "so"].years == ["2000", "2001"]


def test_a_year_without_cells_replaces_what_was_there(spark, shelf, tmp_path):
    part = dict(output_filename="years", dataset_id="ocean", variables=["so"])
    path = subset(spark, shelf, str(tmp_path), years=[2000, 2001], **part)
    subset(spark, shelf, str(tmp_path), years=[2001], minimum_latitude=1000, **part)
    back = open_cube(spark, path, DIMS)
    assert found(back.frame.groupBy("year").count()) == [(2000, 24)]
    # Times of the source stay on the axis, as a place without a cell does.
    assert {r.time.year for r in back.axis("time").collect()} == {2000, 2001}


def test_an_empty_subset_can_be_opened(spark, shelf, tmp_path):
    path = subset(spark, shelf, str(tmp_path), dataset_id="ocean", variables=["so"], minimum_latitude=1000)
    back = open_cube(spark, path, DIMS)
    assert back.data_vars == ("so",) and back.frame.count() == 0


def test_what_broke_off_is_not_stored(spark, shelf, tmp_path):
    part = dict(output_filename="part", dataset_id="ocean", variables=["so"], force_download=False)
    (tmp_path / "part" / "year=2000").mkdir(parents=True)
    path = subset(spark, shelf, str(tmp_path), **part)
    assert open_cube(spark, path, DIMS).axis("time").count() > 1
