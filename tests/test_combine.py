import pytest
from grids import cube, day, found
from pyspark.errors import PySparkException

from pelagrid import overlay, profile_series, profile_table, season_mean


def column(spark, name, records):
    return cube(spark, f"depth double, {name} double", records, ("depth",))


def test_levels_pair_by_position_not_by_label(spark):
    u = column(spark, "uo", [(0.5, 1.0), (1.5, 2.0), (9.0, 3.0)])
    w = column(spark, "w", [(0.0, 10.0), (2.0, None), (8.0, 30.0)])
    table = profile_table({"u [m/s]": (u, "uo"), "w[m/s]": (w, "w")})
    assert table.columns == ["depth [m]", "u [m/s]", "w[m/s]"]
    assert [tuple(r) for r in table.collect()] == [(0.5, 1.0, 10.0), (1.5, 2.0, None), (9.0, 3.0, 30.0)]


def test_unequal_lengths_raise(spark):
    u = column(spark, "uo", [(0.5, 1.0), (1.5, 2.0)])
    w = column(spark, "w", [(0.0, 10.0)])
    with pytest.raises(ValueError, match="unequal"):
        profile_table({"u": (u, "uo"), "w": (w, "w")})


def test_two_cells_at_a_level_raise(spark):
    u = column(spark, "uo", [(0.5, 1.0), (0.5, 2.0)])
    with pytest.raises(PySparkException, match="more than one cell"):
        profile_table({"u": (u, "uo")}).collect()


def test_profile_needs_one_dimension(spark):
    flow = cube(spark, "depth double, latitude double, uo double", [(0.0, 0.0, 1.0)], ("depth", "latitude"))
    with pytest.raises(ValueError, match="dimensions"):
        profile_table({"u": (flow, "uo")})


def test_level_without_a_cell_is_a_missing_value(spark):
    flow = cube(spark, "depth double, latitude double, uo double",
                [(0.0, 0.0, 1.0), (1.0, 0.0, 2.0), (0.0, 1.0, 3.0)], ("depth", "latitude"))
    table = profile_table({"u": (flow.isel(latitude=1), "uo")})
    assert [tuple(r) for r in table.collect()] == [(0.0, 3.0), (1.0, None)]


def test_series_are_long(spark):
    u = column(spark, "uo", [(0.5, 1.0)])
    table = profile_table({"u [m/s]": (u, "uo"), "v [m/s]": (u, "uo")})
    assert found(profile_series(table)) == [(0.5, "u [m/s]", 1.0), (0.5, "v [m/s]", 1.0)]


def test_layers_pair_with_facets_by_label(spark):
    schema = "time timestamp_ntz, latitude double, so double"
    base = season_mean(cube(spark, schema, [(day("2001-01-01"), 0.0, 1.0)], ("time", "latitude")))
    salt = season_mean(cube(spark, schema, [(day("2001-01-01"), 7.0, 5.0), (day("2001-07-01"), 7.0, 6.0)],
                            ("time", "latitude")))
    stacked = overlay(base, "chl", {"salt": salt.frame.withColumnRenamed("so", "s")}, on="season")
    assert found(stacked, "layer", "season", "latitude", "so", "s") == [
        ("chl", "DJF", 0.0, 1.0, None), ("salt", "DJF", 7.0, None, 5.0)]
