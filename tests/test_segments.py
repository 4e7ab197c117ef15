import random
from collections import Counter

import pytest
from grids import cube, found

from pelagrid import isoline, isoline_segments

ENDS = ("latitude_from", "longitude_from", "latitude_to", "longitude_to")


def raster(spark, rows):
    cells = [(float(y), float(x), v) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return cube(spark, "latitude double, longitude double, so double", cells, ("latitude", "longitude"))


def test_one_corner_is_cut_off(spark):
    assert found(isoline_segments(raster(spark, [[10.0, 50.0], [50.0, 50.0]]), "so", 30)) == [(0.0, 0.5, 0.5, 0.0)]
    assert found(isoline_segments(raster(spark, [[10.0, 10.0], [50.0, 50.0]]), "so", 30)) == [(0.5, 0.0, 0.5, 1.0)]


def test_a_saddle_goes_by_the_mean_of_its_corners(spark):
    low = raster(spark, [[10.0, 40.0], [40.0, 10.0]])  # mean 25: the low corners belong together
    assert found(isoline_segments(low, "so", 30), *ENDS) == [
        (0.0, pytest.approx(2 / 3), pytest.approx(1 / 3), 1.0), (pytest.approx(2 / 3), 0.0, 1.0, pytest.approx(1 / 3))]
    high = raster(spark, [[20.0, 60.0], [60.0, 20.0]])  # mean 40: each low corner is cut off
    assert found(isoline_segments(high, "so", 30), *ENDS) == [(0.0, 0.25, 0.25, 0.0), (1.0, 0.75, 0.75, 1.0)]


def test_a_missing_corner_or_a_gap_on_the_axis_leaves_no_piece(spark):
    assert isoline_segments(raster(spark, [[10.0, 50.0], [None, 50.0]]), "so", 30).count() == 0
    assert isoline_segments(raster(spark, [[10.0, 50.0]]), "so", 30).count() == 0
    gap = cube(spark, "latitude double, longitude double, so double",
               [(0.0, 0.0, 1.0), (0.0, 2.0, 50.0), (1.0, 1.0, 7.0), (1.0, 0.0, 1.0), (1.0, 2.0, 50.0)], ("latitude", "longitude"))
    assert isoline_segments(gap, "so", 30).count() == 0


def test_pieces_join_at_the_crossings(spark):
    rng = random.Random(4)
    grid = raster(spark, [[rng.choice([10.0, 20.0, 30.0, 45.0, 60.0]) for _ in range(9)] for _ in range(8)])
    ends = Counter()
    for r in isoline_segments(grid, "so", 30).collect():
        ends[r[0], r[1]] += 1
        ends[r[2], r[3]] += 1
    points = {(r.latitude, r.longitude): r.edge for r in isoline(grid, "so", 30).collect()}
    assert {p for p in points} == set(ends)
    for (lat, lon), edge in points.items():
        border = lat in (0, 7) if edge == "longitude" else lon in (0, 8)
        # Crossings at one grid point, where a value is the level itself, fall together.
        if lat % 1 or lon % 1:
            assert ends[lat, lon] == (1 if border else 2)


def test_segments_need_the_raster_alone(spark):
    with pytest.raises(ValueError, match="exactly the dimensions"):
        isoline_segments(raster(spark, [[1.0]]), "so", 30, by=(), x="longitude", y="longitude")
