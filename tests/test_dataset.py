import pytest
from grids import cube, day, found
from plans import count_nodes, scans

from pelagrid import Catalog, Dataset, Product, combine, open_cube, open_dataset, open_groups, subset, write_cube, write_dataset
from pelagrid.sources import snapshot

DEEP = ("time", "depth", "latitude")
FLAT = ("time", "latitude")


def ocean(spark, latitudes=(10.0, 20.0, 30.0)):
    """so by depth, and zos without; the surface has one latitude more."""
    times = ("2000-01-01", "2000-07-01", "2001-01-01")
    so = [(day(t), z, la, 100 * z + la + i) for i, t in enumerate(times) for z in (0.0, 1.0) for la in latitudes[:-1]]
    zos = [(day(t), la, la / 10 + i) for i, t in enumerate(times) for la in latitudes]
    return combine([
        cube(spark, "time timestamp_ntz, depth double, latitude double, so double", so, DEEP),
        cube(spark, "time timestamp_ntz, latitude double, zos double", zos, FLAT)])


def test_unlike_cubes_share_their_axes(spark):
    data = ocean(spark)
    assert isinstance(data, Dataset) and data.dims == DEEP and data.data_vars == ("so", "zos")
    assert data.groups[0].axes["latitude"] is data.groups[1].axes["latitude"]
    assert [r.latitude for r in data.axis("latitude").collect()] == [10.0, 20.0, 30.0]
    top = data.isel(latitude=2)
    assert top.pick("so").cube().frame.count() == 0 and top.pick("zos").cube().frame.count() == 3
    assert found(data.info(), "kind", "name", "size", "over") == [
        ("dim", "depth", 2, None), ("dim", "latitude", 3, None), ("dim", "time", 3, None),
        ("var", "so", None, "time, depth, latitude"), ("var", "zos", None, "time, latitude")]
    assert str(data).startswith("Dataset(Cube(time")


def test_a_mean_leaves_other_variables_alone(spark):
    data = ocean(spark)
    flat = data.mean("depth")
    assert flat.dims == FLAT and flat.groups[1].frame is data.groups[1].frame
    both = flat.cube("so", "zos").frame.where("time = timestamp_ntz'2000-01-01'")
    assert found(both.select("latitude", "so", "zos")) == [(10.0, 60.0, 1.0), (20.0, 70.0, 2.0), (30.0, None, 3.0)]
    assert found(data.mean().cube().frame) == [(66.0, 3.0)]


def test_drop_dims_needs_no_names_of_variables(spark):
    rest = ocean(spark).drop_dims("depth")
    assert rest.data_vars == ("zos",) and rest.cube().frame.count() == 9
    assert ocean(spark).drop_dims("latitude").groups == ()


def test_selection_touches_the_variables_that_have_the_dimension(spark):
    data = ocean(spark)
    part = data.sel(depth=1.0).sel_time("2000-01-01", "2000-12-31")
    assert part.dims == FLAT
    assert found(part.cube("zos").frame, "zos") == [(1.0,), (2.0,), (2.0,), (3.0,), (3.0,), (4.0,)]
    assert found(part.sel_range(latitude=(15, None)).isel(latitude=0, time=1).cube().frame) == [(121.0, 3.0)]
    assert found(data.sel_nearest(drop=True, depth=0.9).isel(time=0, latitude=0).cube().frame) == [(110.0, 1.0)]
    assert data.isel(depth=slice(0, 1)).squeeze().dims == FLAT
    with pytest.raises(KeyError):
        data.sel(depth=7.0)
    with pytest.raises(KeyError):
        data.mean("longitude")
    with pytest.raises(IndexError):
        data.isel(depth=2)


def test_climatology_of_what_has_a_time(spark):
    still = cube(spark, "latitude double, bottom double", [(10.0, 5.0), (20.0, 6.0)], ("latitude",))
    data = Dataset.of([*ocean(spark).groups, still]).group_mean("season")
    assert found(data.cube("bottom").frame) == [(10.0, 5.0), (20.0, 6.0)]
    djf = data.sel(strict=False, season="DJF").sel(latitude=10.0)
    assert found(djf.cube("zos").frame) == [(2.0,)]


def test_variables_of_unlike_dimensions_are_no_cube(spark):
    data = ocean(spark)
    with pytest.raises(ValueError, match="different dimensions"):
        data.cube()
    spread = data.spread("so", "zos")
    assert spread.dims == DEEP and spread.frame.count() == 12
    assert found(spread.isel(time=0, latitude=1).frame) == [(0.0, 20.0, 2.0), (1.0, 120.0, 2.0)]
    with pytest.raises(ValueError, match="more than one variable"):
        Dataset.of([data.groups[0], data.groups[0]])


def test_renaming_keeps_axes_shared(spark):
    data = ocean(spark).rename({"latitude": "lat", "zos": "height"})
    assert data.dims == ("time", "depth", "lat") and data.data_vars == ("so", "height")
    assert data.groups[0].axes["lat"] is data.groups[1].axes["lat"]
    with pytest.raises(ValueError):
        data.rename({"so": "height"})


def test_a_flat_variable_is_split_off(spark):
    long = cube(spark, "depth int, latitude double, so double, zos double",
                [(0, 1.0, 5.0, 0.1), (1, 1.0, 6.0, 0.1), (0, 2.0, 7.0, None)], ("depth", "latitude"))
    data = Dataset.split(long, {"zos": ("latitude",)})
    assert found(data.cube("zos").frame) == [(1.0, 0.1), (2.0, None)]
    assert data.cube("so").dims == ("depth", "latitude")
    with pytest.raises(Exception, match="so varies"):
        Dataset.split(long, {"so": ("latitude",)}).cube("so").frame.collect()


def test_groups_are_kept_and_opened(spark, tmp_path):
    path = f"{tmp_path}/ocean"
    write_dataset(ocean(spark), path)
    assert sorted(p.name for p in (tmp_path / "ocean").iterdir()) == ["time_depth_latitude", "time_latitude"]
    back = open_groups(spark, path)
    assert back.dims == DEEP and set(back.data_vars) == {"so", "zos"}
    one = back.sel_time("2001-01-01", None).isel(depth=0)
    assert all("2001" in scans(g.frame)[0]["PartitionFilters"] for g in one.groups)
    assert found(one.isel(latitude=1).cube("so", "zos").frame, "so", "zos") == [(22.0, 4.0)]
    with pytest.raises(FileNotFoundError):
        open_groups(spark, f"{tmp_path}/nowhere")


def test_no_join_before_variables_meet(spark):
    data = ocean(spark).mean("depth")
    assert all(count_nodes(g.frame, "SortMergeJoin") == 0 for g in data.groups)


def test_a_product_with_a_flat_variable(spark, tmp_path):
    path = f"{tmp_path}/long"
    write_cube(ocean(spark).spread("so", "zos"), path)
    shelf = Catalog({"ocean": Product(path, DEEP, own_dims={"zos": FLAT})})
    got = open_dataset(spark, shelf, dataset_id="ocean", minimum_depth=0.8, maximum_depth=0.8, minimum_latitude=15)
    assert isinstance(got, Dataset) and found(got.cube("so").frame, "depth", "so") == [(1.0, 120.0), (1.0, 121.0), (1.0, 122.0)]
    assert found(got.cube("zos").frame, "latitude", "zos") == [(20.0, 2.0), (20.0, 3.0), (20.0, 4.0)]
    flat = open_dataset(spark, shelf, dataset_id="ocean", variables=["zos"], minimum_depth=0.8, maximum_depth=0.8)
    assert flat.dims == FLAT
    part = dict(output_filename="kept", dataset_id="ocean", minimum_depth=0.0, maximum_depth=0.0)
    kept = subset(spark, shelf, str(tmp_path), years=[2000], **part)
    subset(spark, shelf, str(tmp_path), years=[2000, 2001], force_download=False, **part)
    assert open_groups(spark, kept).cube("zos").frame.count() == 6
    assert open_groups(spark, kept).cube("so").frame.count() == 6
    assert all(set(m.requests) == {"2000", "2001"} for m in snapshot.stores(spark, kept).values())
    assert open_cube(spark, f"{kept}/time_latitude", FLAT).data_vars == ("zos",)
