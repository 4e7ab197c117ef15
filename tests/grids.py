"""Small cubes for hand-worked cases."""

from datetime import datetime
from itertools import product

from pelagrid import from_frame


def day(text):
    return datetime.fromisoformat(text)


def cube(spark, schema, records, dims, data_vars=None, **options):
    return from_frame(spark.createDataFrame(records, schema), dims, data_vars, **options)


def patch(spark, size=4):
    """size x size raster where the value at (lat, lon) positions i, j is 10 * i + j."""
    records = [(10.0 + i, -5.0 + j, 10.0 * i + j) for i, j in product(range(size), range(size))]
    return cube(spark, "latitude double, longitude double, so double", records, ("latitude", "longitude"))


def found(frame, *names):
    names = names or frame.columns
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=str)
