import pytest
from grids import cube, day, found
from pyspark.sql import functions as F

from pelagrid import bands, clipped, facet, facet_labels, filled, hovmoller, isoline, labelled, profile_line, season_mean
from pelagrid.functions.values import level_band, round_levels


def raster(spark, rows, lats=None, lons=None):
    lats, lons = lats or range(len(rows)), lons or range(len(rows[0]))
    cells = [(float(y), float(x), v) for y, row in zip(lats, rows) for x, v in zip(lons, row)]
    return cube(spark, "latitude double, longitude double, so double", cells, ("latitude", "longitude"))


def points(grid, level=30.0):
    return sorted((r.edge, r.latitude, r.longitude) for r in isoline(grid, "so", level).collect())


def test_isoline_interpolates_between_neighbours(spark):
    assert points(raster(spark, [[20.0, 40.0], [20.0, 25.0]])) == [
        ("latitude", pytest.approx(2 / 3), 1.0), ("longitude", 0.0, 0.5)]


def test_isoline_with_a_value_on_the_level_and_a_hole(spark):
    grid = raster(spark, [[20.0, 30.0, 40.0], [20.0, None, 20.0], [20.0, 20.0, 20.0]])
    assert points(grid) == [("latitude", 0.5, 2.0), ("longitude", 0.0, 1.0)]


def test_isoline_skips_a_cell_that_has_no_row(spark):
    whole = raster(spark, [[20.0, 25.0, 40.0]])
    whole = cube(spark, "latitude double, longitude double, so double",
                 [(0.0, 0.0, 20.0), (0.0, 2.0, 40.0), (1.0, 1.0, 20.0)], ("latitude", "longitude"))
    assert points(whole) == []


def test_isoline_on_an_irregular_axis(spark):
    assert points(raster(spark, [[20.0, 40.0]], lons=[10.0, 18.0])) == [("longitude", 0.0, 14.0)]


def test_isoline_follows_each_facet(spark):
    cells = [("DJF", 0.0, 0.0, 20.0), ("DJF", 0.0, 1.0, 40.0), ("JJA", 0.0, 0.0, 50.0), ("JJA", 0.0, 1.0, 40.0)]
    grid = cube(spark, "season string, latitude double, longitude double, so double", cells,
                ("season", "latitude", "longitude"))
    lines = labelled(isoline(grid, "so", 30, by=["season"]), 30)
    assert found(lines) == [("DJF", "longitude", 0.0, 0.5, "30")]
    with pytest.raises(ValueError):
        isoline(grid, "so", 30)


def test_facets_are_columns(spark):
    days = [(day("2001-01-01"), 0.0, 1.0), (day("2001-02-01"), 0.0, 3.0), (day("2001-07-01"), 1.0, 5.0)]
    daily = cube(spark, "time timestamp_ntz, latitude double, so double", days, ("time", "latitude"))
    expected = [(0.0, 2.0, None), (1.0, None, 5.0)]
    assert found(facet(daily, "so", "season", ["DJF", "JJA"])) == expected
    assert found(facet(season_mean(daily), "so", "season", ["DJF", "JJA"])) == expected
    assert found(facet_labels(season_mean(daily), "season")) == [(0, "DJF"), (1, "JJA")]


def test_clip_leaves_a_missing_value_missing(spark):
    grid = cube(spark, "latitude double, so double", [(0.0, -1.0), (1.0, None), (2.0, 9.0), (3.0, 2.0)], ("latitude",))
    assert found(clipped(grid, "so", 0, 4)) == [(0.0, 0.0), (1.0, None), (2.0, 4.0), (3.0, 2.0)]


def test_bands_count_from_their_lower_limit(spark):
    grid = cube(spark, "latitude double, so double", [(0.0, 9.99), (1.0, 10.0), (2.0, -0.5), (3.0, None)], ("latitude",))
    assert found(bands(grid, "so", low=0, step=5), "latitude", "band") == [(0.0, 1), (1.0, 2), (2.0, -1), (3.0, None)]


def test_filled_bands_between_levels(spark):
    values = [(float(i), v) for i, v in enumerate([-1.0, 0.0, 0.9, 1.0, 4.0, 4.1, None])]
    grid = cube(spark, "latitude double, so double", values, ("latitude",))
    assert [b for _, b in found(filled(grid, "so", [0, 1, 4]), "latitude", "band")] == [-1, 0, 0, 1, 1, 2, None]
    with pytest.raises(ValueError):
        level_band(F.lit(1.0), [1, 1])


def test_round_levels_cover_the_limits():
    assert round_levels(0.3, 5.7) == [0, 1, 2, 3, 4, 5, 6]
    assert round_levels(28.1, 36.4) == [27.0, 28.5, 30.0, 31.5, 33.0, 34.5, 36.0, 37.5]
    with pytest.raises(ValueError):
        round_levels(2, 2)


def test_hovmoller_averages_what_is_left(spark):
    cells = [(1, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 3.0), (2, 0.0, 0.0, 5.0)]
    grid = cube(spark, "month int, latitude double, longitude double, so double", cells,
                ("month", "latitude", "longitude"))
    assert found(hovmoller(grid, "so", x="month")) == [(1, 0.0, 2.0), (2, 0.0, 5.0)]


def test_profile_line_in_drawing_order(spark):
    line = cube(spark, "depth double, w double", [(0.0, 1.0), (1500.0, 2.0), (10.0, 3.0), (1501.0, 4.0)], ("depth",))
    drawn = profile_line(line, "w", window=(1500, 0), downward=True)
    assert [tuple(r) for r in drawn.collect()] == [(1500.0, 2.0), (10.0, 3.0), (0.0, 1.0)]
    assert [r.depth for r in profile_line(line, "w").collect()] == [0.0, 10.0, 1500.0, 1501.0]
