"""The whole analyses on grids small enough to work out by hand."""

import os
import subprocess
import sys
from itertools import product
from pathlib import Path
from types import SimpleNamespace

import pytest
from grids import cube, day, found

from pelagrid import from_frame
from pelagrid.plans import workflows
from pelagrid.session import shared_folder

DAILY = "time timestamp_ntz, depth float, latitude double, longitude double, so double"


@pytest.fixture(scope="module")
def salt(spark):
    """Two winter days and one in summer; fresh in the west in winter."""
    cells = []
    for lat, lon in product((0.0, 1.0), (0.0, 1.0, 2.0)):
        cells += [(day("2001-01-01"), 0.5, lat, lon, 20.0 + 10 * lon), (day("2001-12-01"), 0.5, lat, lon, 22.0 + 10 * lon),
                  (day("2001-07-01"), 0.5, lat, lon, 35.0), (day("2001-07-01"), 9.0, lat, lon, 1.0)]
    return cube(spark, DAILY, cells, ("time", "depth", "latitude", "longitude"))


@pytest.fixture(scope="module")
def green(spark):
    """Chlorophyll on another grid, in winter only."""
    cells = [(day("2003-02-01"), 0.25, 0.25, 3.0), (day("2003-02-02"), 0.25, 0.25, 5.0)]
    return cube(spark, "time timestamp_ntz, latitude double, longitude double, CHL double", cells,
                ("time", "latitude", "longitude"))


def test_plume_edge_over_another_field(salt, green):
    maps = workflows.plume_maps(salt, green)
    assert found(maps.salinity.isel(latitude=0, longitude=1).frame) == [("DJF", 31.0), ("JJA", 35.0)]
    assert found(maps.edge) == [
        ("DJF", "longitude", 0.0, 0.9, "30"), ("DJF", "longitude", 1.0, 0.9, "30")]
    assert found(maps.layers, "layer", "season", "latitude", "longitude", "CHL", "label") == [
        ("edge", "DJF", 0.0, 0.9, None, "30"), ("edge", "DJF", 1.0, 0.9, None, "30"),
        ("field", "DJF", 0.25, 0.25, 4.0, None)]


def test_month_section_is_the_mean_of_cell_means(salt):
    section = workflows.month_section(salt.isel(depth=0), "so")
    assert found(section) == [(1, 0.0, 30.0), (1, 1.0, 30.0), (12, 0.0, 32.0), (12, 1.0, 32.0), (7, 0.0, 35.0), (7, 1.0, 35.0)]


def test_bands_between_robust_limits(spark):
    grid = cube(spark, "latitude double, so double", [(float(i), float(i)) for i in range(101)], ("latitude",))
    banded = {r.so: r.band for r in workflows.robust_bands(grid, "so").collect()}
    # Limits 2 and 98 in six bands: steps of 20 from 0 to 100.
    assert [banded[v] for v in (0, 19, 20, 50, 99, 100)] == [0, 0, 1, 2, 4, 4]


@pytest.fixture(scope="module")
def flow(spark):
    cells = [(day(t), z, float(la), float(lo), 100 * i + 10 * la + lo + z, -z)
             for i, t in enumerate(("2001-01-01", "2001-01-02")) for z in (0.5, 1.5)
             for la in range(4) for lo in range(4)]
    return cube(spark, "time timestamp_ntz, depth double, latitude double, longitude double, uo double, vo double",
                cells, ("time", "depth", "latitude", "longitude"))


@pytest.fixture(scope="module")
def rising(spark):
    cells = [(z, float(la), float(lo), 1000 * z + la + lo) for z in (0.0, 2.0) for la in range(4) for lo in range(4)]
    return cube(spark, "depth double, lat double, lon double, w double", cells, ("depth", "latitude", "longitude"),
                rename={"lat": "latitude", "lon": "longitude"})


PATCH = (slice(1, 3), slice(2, 4))


def test_velocity_profile_at_an_instant(flow, rising):
    table = workflows.velocity_profile(flow, rising, 1, PATCH, (1, 1))
    assert table.columns == ["depth [m]", "u [m/s]", "v [m/s]", "w[m/s]"]
    assert [tuple(r) for r in table.collect()] == [(0.5, 123.5, -0.5, 5.0), (1.5, 124.5, -1.5, 2005.0)]


def test_velocity_profile_of_time_means(flow, rising):
    table = workflows.velocity_profile(flow, rising, None, PATCH, (0, 0))
    assert [tuple(r) for r in table.collect()] == [(0.5, 62.5, -0.5, 3.0), (1.5, 63.5, -1.5, 2003.0)]


def test_only_a_local_session_may_make_its_own_folder():
    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(**{"spark.master": "yarn"}))
    path = shared_folder(session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"}))
    assert path.startswith("hdfs:///shared/") and "//" not in path[len("hdfs://"):].lstrip("/")


@pytest.mark.parametrize("values, bands", [([2.0, 2.0, None], [0, 0, None]), ([None, None], [None, None])])
def test_bands_of_a_constant_field(spark, values, bands):
    frame = spark.createDataFrame(list(enumerate(values)), "cell int, so double")
    found = workflows.robust_bands(from_frame(frame, ("cell",)), "so").orderBy("cell")
    assert [r.band for r in found.collect()] == bands


def test_intermediates_need_no_setting(tmp_path):
    """In a process of its own, as its session has no folder named."""
    code = """
from pyspark.sql import SparkSession
from pelagrid import from_frame, robust_limits
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
print("LIMITS", tuple(robust_limits(from_frame(spark.range(11).selectExpr("id", "double(id) so"), ("id",)), "so").first()))
"""
    home = Path(__file__).resolve().parents[1]
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env=os.environ | {"PYTHONPATH": str(home), "SPARK_CONF_DIR": str(tmp_path)})
    assert "LIMITS (0.2, 9.8)" in done.stdout, done.stderr[-2000:]
