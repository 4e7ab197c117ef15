import pytest
from grids import cube, day, found
from pyspark.sql import functions as F

from pelagrid import combine, duplicate_cells, from_frame, keep_axes, open_cube, open_many, open_means, season_mean, seasonality, write_cube
from pelagrid.sources import store
from plans import scans

DIMS = ("time", "latitude", "longitude")
SCHEMA = "time timestamp_ntz, latitude float, longitude float, so float"


def days(spark, *texts, so=1.0):
    cells = [(day(t), lat, lon, so) for t in texts for lat in (10.0, 20.0) for lon in (-5.0, -4.0)]
    return cube(spark, SCHEMA, cells, DIMS)


def test_round_trip_by_year(spark, tmp_path):
    path = f"{tmp_path}/salt"
    whole = days(spark, "2000-12-31", "2001-01-01", "2001-07-01")
    write_cube(whole, path)
    assert sorted(p.name for p in (tmp_path / "salt").glob("year=*")) == ["year=2000", "year=2001"]
    back = open_cube(spark, path, DIMS)
    assert back.data_vars == ("so",) and back.year == "year"
    assert found(back.frame.select(whole.frame.columns)) == found(whole.frame)
    assert back.frame.schema["latitude"].dataType.simpleString() == "float"


def test_axes_are_kept_beside_the_cells(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(days(spark, "2000-12-31", "2001-01-01"), path)
    back = open_cube(spark, path, DIMS)
    assert "/_axes/latitude" in back.axes["latitude"].source.inputFiles()[0]
    assert [r.latitude for r in back.axis("latitude").collect()] == [10.0, 20.0]
    assert [r.time for r in back.axis("time").collect()] == [day("2000-12-31"), day("2001-01-01")]


def test_only_the_years_written_again_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(days(spark, "2000-01-01", "2001-01-01", "2001-01-02"), path)
    write_cube(days(spark, "2001-06-01", so=9.0), path)
    back = open_cube(spark, path, DIMS)
    assert {(r.time, r.so) for r in back.frame.collect()} == {(day("2000-01-01"), 1.0), (day("2001-06-01"), 9.0)}
    assert [r.time for r in back.axis("time").collect()] == [day("2000-01-01"), day("2001-06-01")]
    write_cube(days(spark, "2002-01-01"), path, replace_all=True)
    assert [r.time for r in open_cube(spark, path, DIMS).axis("time").collect()] == [day("2002-01-01")]


def test_cube_without_time_is_kept_whole(spark, tmp_path):
    path = f"{tmp_path}/w"
    write_cube(cube(spark, "depth float, w double", [(0.5, 1.0), (1.5, 2.0)], ("depth",)), path, files=2)
    back = open_cube(spark, path, ("depth",))
    assert back.year is None and found(back.isel(depth=1).frame) == [(2.0,)]


def test_nan_is_missing_once_opened(spark, tmp_path):
    path = f"{tmp_path}/raw"
    spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0)], "lat double, w double").write.parquet(path)
    opened = open_cube(spark, path, ("latitude",), rename={"lat": "latitude"})
    assert found(opened.frame) == [(1.0, None), (2.0, 3.0)]


def test_time_selection_names_the_year_partitions(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(days(spark, "2000-12-31", "2001-01-01", "2002-07-01"), path)
    part = open_cube(spark, path, DIMS).sel_time("2001-01-01", "2001-12-31")
    (scan,) = scans(part.frame)
    assert "year" in scan["PartitionFilters"] and "2001" in scan["PartitionFilters"]
    assert len(part.frame.inputFiles()) <= len(open_cube(spark, path, DIMS).frame.inputFiles())
    assert part.frame.count() == 4
    first = open_cube(spark, path, DIMS).isel(time=0)
    assert "2000" in scans(first.frame)[0]["PartitionFilters"]


def test_a_hot_year_is_split_between_files(spark, tmp_path):
    path = f"{tmp_path}/hot"
    cells = [(day("2000-01-01"), float(i % 50), float(i // 50), 1.0) for i in range(3000)]
    cells += [(day("2001-01-01"), float(i), 0.0, 1.0) for i in range(50)]
    write_cube(cube(spark, SCHEMA, cells, DIMS).pick("so"), path, files=6)
    assert len(list((tmp_path / "hot" / "year=2000").rglob("*.parquet"))) >= 4


def year_file(spark, tmp_path, name, *texts, so=1.0):
    path = f"{tmp_path}/{name}"
    days(spark, *texts, so=so).frame.coalesce(1).write.parquet(path)
    return path


def test_many_files_are_one_cube(spark, tmp_path):
    year_file(spark, tmp_path, "salt_2001", "2001-01-01", "2001-12-31")
    year_file(spark, tmp_path, "salt_2000", "2000-01-01")
    whole = open_many(spark, f"{tmp_path}/salt_*", DIMS)
    assert [r.time for r in whole.axis("time").collect()] == [day("2000-01-01"), day("2001-01-01"), day("2001-12-31")]
    assert whole.frame.count() == 12


def test_overlapping_files_raise(spark, tmp_path):
    a = year_file(spark, tmp_path, "a", "2000-01-01", "2001-01-01")
    b = year_file(spark, tmp_path, "b", "2001-01-01", "2001-12-31")
    with pytest.raises(ValueError, match="overlapping time"):
        open_many(spark, [a, b], DIMS)
    assert open_many(spark, [a, b], DIMS, check=False).frame.count() == 16


def test_one_file_inside_the_span_of_another_raises(spark, tmp_path):
    a = year_file(spark, tmp_path, "a", "2000-01-01", "2002-01-01")
    b = year_file(spark, tmp_path, "b", "2000-02-01")
    c = year_file(spark, tmp_path, "c", "2001-03-01")
    with pytest.raises(ValueError):
        open_many(spark, [c, a, b], DIMS)


def test_files_of_one_directory_are_one_slab(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(days(spark, "2000-01-01", "2000-06-01", "2001-01-01"), path, files=4)
    with pytest.raises(ValueError):
        open_many(spark, f"{path}/year=*", DIMS)
    assert open_many(spark, f"{path}/year=*", DIMS, slab="directory").frame.count() == 12


def test_variables_line_up_by_name(spark, tmp_path):
    a = year_file(spark, tmp_path, "a", "2000-01-01")
    b = f"{tmp_path}/b"
    renamed = days(spark, "2001-01-01").frame.withColumnRenamed("so", "tx")
    renamed.coalesce(1).write.parquet(b)
    both = open_many(spark, [a, b], DIMS)
    assert set(both.data_vars) == {"so", "tx"}
    assert found(both.isel(time=0, latitude=0, longitude=0).frame, "so", "tx") == [(1.0, None)]
    joined = combine([days(spark, "2000-01-01"), days(spark, "2001-01-01").rename({"so": "tx"})])
    assert found(joined.isel(time=1, latitude=0, longitude=0).frame, "so", "tx") == [(None, 1.0)]


def test_duplicate_cells_are_counted(spark):
    twice = combine([days(spark, "2000-01-01"), days(spark, "2000-01-01", "2000-01-02")])
    assert found(duplicate_cells(twice), "copies") == [(2,)] * 4


def test_a_kept_axis_remembers_its_direction(spark, tmp_path):
    path = f"{tmp_path}/salt"
    down = type(days(spark, "2000-01-01")).of(days(spark, "2000-01-01").frame, DIMS, descending=["latitude"])
    write_cube(down, path)
    back = open_cube(spark, path, DIMS)
    assert back.axes["latitude"].descending and not back.axes["longitude"].descending
    assert [r.latitude for r in back.axis("latitude").collect()] == [20.0, 10.0]
    assert found(back.isel(latitude=0, longitude=0).frame.select("so")) == [(1.0,)]


def test_axes_can_be_kept_for_files_from_elsewhere(spark, tmp_path):
    path = f"{tmp_path}/found"
    days(spark, "2000-01-01", "2001-01-01").frame.write.parquet(path)
    keep_axes(spark, path, DIMS, descending=["longitude"])
    back = open_cube(spark, path, DIMS)
    assert "/_axes/time" in back.axes["time"].source.inputFiles()[0]
    assert found(back.isel(time=1, latitude=0).frame.where("longitude = -4")) == [(-4.0, 1.0)]
    assert back.axis("longitude").first().longitude == -4.0
    assert back.frame.count() == 8


def test_one_level_lies_in_few_files(spark, tmp_path):
    path = f"{tmp_path}/levels"
    cells = [(day("2000-01-01"), float(z), float(la), float(lo), 1.0)
             for z in range(4) for la in range(20) for lo in range(20)]
    schema = "time timestamp_ntz, depth float, latitude float, longitude float, so float"
    write_cube(cube(spark, schema, cells, ("time", "depth", "latitude", "longitude")), path, files=8)
    files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(
        F.countDistinct("depth").alias("levels"), (F.max("latitude") - F.min("latitude")).alias("span"))
    assert files.count() >= 6 and files.where("levels > 2").count() == 0


def downward(spark, *texts):
    cells = [(day(t), lat, lat) for t in texts for lat in (10.0, 20.0, 30.0)]
    return from_frame(spark.createDataFrame(cells, "time timestamp_ntz, lat double, so double"),
                      ("time", "latitude"), rename={"lat": "latitude"}, descending=["latitude"])


def test_direction_outlives_rename_and_glob(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(downward(spark, "2000-01-01", "2001-01-01").rename({"latitude": "y"}), path)
    for back in (open_cube(spark, path, ("time", "latitude"), rename={"y": "latitude"}),
                 open_many(spark, f"{path}/year=*", ("time", "latitude"), rename={"y": "latitude"})):
        assert [r.so for r in back.isel(latitude=0).frame.collect()] == [30.0, 30.0]
        assert back.year == "year"


def test_a_glob_over_some_years_has_their_axes(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(downward(spark, "2000-01-01", "2001-01-01", "2010-01-01"), path)
    part = open_many(spark, f"{path}/year=200*", ("time", "latitude"))
    assert [r.time for r in part.axis("time").collect()] == [day("2000-01-01"), day("2001-01-01")]
    assert "/_axes/time/year=200" in part.axes["time"].source.inputFiles()[0]
    (scan,) = scans(part.sel_time("2001-01-01", "2001-12-31").frame)
    assert "2001" in scan["PartitionFilters"]


def test_storing_moves_no_position(spark, tmp_path):
    path = f"{tmp_path}/salt"
    whole = cube(spark, SCHEMA, [(day("2000-01-01"), float(lat), 0.0, 1.0 * lat) for lat in (10, 20, 30, 40)]
                 + [(day("2001-01-01"), float(lat), 0.0, 1.0 * lat) for lat in (10, 30, 40)], DIMS)
    late = whole.sel_time("2001-01-01", None)
    write_cube(late, path)
    back = open_cube(spark, path, DIMS)
    assert back.axis("latitude").count() == 4
    for at in range(4):
        assert found(back.isel(latitude=at).frame.select("so")) == found(late.isel(latitude=at).frame.select("so"))


def test_kept_means_read_sums_alone(spark, tmp_path):
    path = f"{tmp_path}/salt"
    whole = combine([days(spark, "2000-01-01", "2000-12-31", so=2.0), days(spark, "2001-01-15", "2001-07-01", so=5.0)])
    write_cube(whole, path, partials=True)
    for part, full in (("month", seasonality), ("season", season_mean)):
        means = open_means(spark, path, part)
        assert means.dims == (part, "latitude", "longitude")
        assert found(means.frame) == found(full(whole).frame.select(*means.frame.columns))
        assert all("/_partials/" in f for f in means.frame.inputFiles())
    assert [r.season for r in open_means(spark, path, "season").axis("season").collect()] == ["DJF", "JJA"]


def test_kept_means_follow_a_replaced_year(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(days(spark, "2000-01-01", "2001-01-01", so=1.0), path, partials=True)
    old = set((tmp_path / "salt" / "_partials" / "year=2000").iterdir())
    write_cube(days(spark, "2001-01-05", so=4.0), path)
    means = open_means(spark, path, rename={"latitude": "lat"})
    assert means.dims == ("month", "lat", "longitude")
    assert found(means.frame, "month", "so") == [(1, 2.5)] * 4
    assert set((tmp_path / "salt" / "_partials" / "year=2000").iterdir()) == old
    write_cube(days(spark, "2002-01-01"), path, years=[2000])
    assert found(open_means(spark, path).frame, "so") == [(2.5,)] * 4


def test_means_are_kept_of_all_years_or_of_none(spark, tmp_path):
    path = f"{tmp_path}/salt"
    write_cube(days(spark, "2000-01-01"), path)
    with pytest.raises(FileNotFoundError):
        open_means(spark, path)
    with pytest.raises(ValueError, match="no partial means are kept of"):
        write_cube(days(spark, "2001-01-01"), path, partials=True)
    write_cube(days(spark, "2000-01-01", "2001-01-01"), path, partials=True)
    assert open_means(spark, path).frame.count() == 4


def test_overlaps_of_many_files_need_no_single_task(spark, tmp_path):
    from plans import plan_text

    from pelagrid.sources import store

    spans = spark.sql("select concat('f', id) as slab, id * 10 as first, id * 10 + if(id % 50 = 7, 25, 9) as last from range(400)")
    clashes = store.overlaps(spans)
    # One window, within ranges; what is gathered is a row a range.
    assert plan_text(clashes).count("windowspecdefinition(") == plan_text(clashes).count("windowspecdefinition(__part") > 0
    assert {r.slab for r in clashes.collect()} == {f"f{i + k}" for i in range(7, 400, 50) for k in (1, 2)}


def row_groups(path, **bounds):
    """Row groups that the statistics leave for closed bounds, and all."""
    import pyarrow.parquet as pq

    left = total = 0
    for file in path.rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(i).statistics for i, n in enumerate(names)}
            total += 1
            left += all(stats[d].min <= high and stats[d].max >= low for d, (low, high) in bounds.items())
    return left, total


def test_interleaved_order_prunes_a_box_and_a_day(spark, tmp_path):
    frame = spark.sql("""select timestamp_ntz'2000-01-01' + make_dt_interval(t) as time, double(z) as depth, double(y) as latitude,
        double(x) as longitude, double(t + z + y + x) as so from (select explode(sequence(0, 360, 12)) as t)
        cross join (select explode(sequence(0, 7)) as z) cross join (select explode(sequence(0, 19)) as y)
        cross join (select explode(sequence(0, 19)) as x)""")
    whole = from_frame(frame, ("time", "depth", "latitude", "longitude"))
    box, when = dict(latitude=(2.0, 4.0), longitude=(2.0, 4.0)), dict(time=(day("2000-03-01"), day("2000-03-01")))
    read = {}
    for layout in ("place", "interleaved"):
        write_cube(whole, f"{tmp_path}/{layout}", files=64, layout=layout)
        read[layout] = {k: row_groups(tmp_path / layout / "year=2000", **b) for k, b in (("box", box), ("day", when))}
        back = open_cube(spark, f"{tmp_path}/{layout}", whole.dims)
        assert back.frame.count() == 31 * 8 * 400
        assert back.sel_range(**box).frame.count() == 31 * 8 * 9
        assert back.isel(time=5, depth=0).frame.count() == 400
    groups, of = read["interleaved"]["box"][0], read["interleaved"]["day"][0]
    assert groups < read["place"]["box"][0] and of < read["place"]["day"][0] / 2, read
    with pytest.raises(ValueError, match="layout"):
        write_cube(whole, f"{tmp_path}/other", layout="else")


def test_interleaved_order_of_odd_coordinates(spark, tmp_path):
    cells = [(None, 1.0, "a", 1.0), (day("2000-01-01"), None, None, 2.0), (day("2000-12-31"), 1.0, "b", 3.0)]
    odd = cube(spark, "time timestamp_ntz, depth double, name string, so double", cells, ("time", "depth", "name"))
    write_cube(odd, f"{tmp_path}/odd", layout="interleaved")
    assert found(open_cube(spark, f"{tmp_path}/odd", odd.dims).frame, "so") == [(1.0,), (2.0,), (3.0,)]


def test_interleaved_key_is_computed_once_a_row(spark, tmp_path, monkeypatch):
    """Rows are sorted by a column, not by an expression that each comparison computes again."""
    cells = [(day("2000-01-01"), float(z), float(y), float(y)) for z in range(3) for y in range(4)]
    small = cube(spark, "time timestamp_ntz, depth double, latitude double, key double", cells, ("time", "depth", "latitude"))
    seen, append = [], store._append
    monkeypatch.setattr(store, "_append", lambda frame, *rest: (seen.append(frame), append(frame, *rest)))
    write_cube(small, f"{tmp_path}/small", files=2, layout="interleaved")
    assert seen[0].columns == ["time", "depth", "latitude", "key", "year"]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.splitlines() if "Sort [" in line or "RepartitionByExpression" in line]
    assert len(moved) == 2 and not any("shift" in line for line in moved), plan
    # The bits of latitude, depth and time in turn, highest first.
    steps = [(int((y / 3) * 4095), int((z / 2) * 4095), int(24 / (367 * 24) * 4095)) for _, z, y, _ in cells]
    wanted = [sum((s >> b & 1) << (3 * b + k) for k, s in zip((1, 0, 2), step) for b in range(12)) for step in steps]
    found_ = store.interleaved(small, small.frame, "place").orderBy("depth", "latitude")
    assert [r["place"] for r in found_.collect()] == wanted
