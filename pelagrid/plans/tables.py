"""Cubes over the given tables, which hold no ocean grid: order lines stand in for
a salinity or velocity column, orders for a surface field, events for a track.

Variables are whole hundredths held as DOUBLE. Sums of those are exact in any
order, so a mean does not depend on how Spark splits the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..dataset import Dataset
from ..sources.request import Catalog, Product
from ..sources.store import combine, from_frame

PLACE = ("depth", "latitude", "longitude")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def hundredths(value: Column) -> Column:
    return F.floor(value * 100 + 0.5).cast("double")


def field(spark: SparkSession, folder: str) -> Cube:
    """so and tx over time, depth (7), latitude (50) and longitude (11)."""
    lines = table(spark, folder, "lineitem")
    return from_frame(lines.select(
        F.col("l_shipdate").alias("time"),
        F.col("l_linenumber").alias("depth"),
        F.col("l_quantity").alias("latitude"),
        F.col("l_discount").alias("longitude"),
        hundredths(F.col("l_extendedprice")).alias("so"),
        hundredths(F.col("l_tax")).alias("tx"),
    ), ("time", *PLACE))


def yearly(spark: SparkSession, folder: str) -> Cube:
    """The field with one instant a year, a cell being the rounded mean of that year."""
    whole = field(spark, folder)
    year = F.make_date(F.year("time"), F.lit(1), F.lit(1)).cast("timestamp_ntz").alias("time")
    means = whole.frame.groupBy(year, *PLACE).agg(
        *[F.floor(F.avg(v) + 0.5).cast("double").alias(v) for v in whole.data_vars])
    return from_frame(means, whole.dims)


def holed_field(spark: SparkSession, folder: str) -> Cube:
    """The field with NaN at the deepest level, as a masked source delivers it."""
    whole = field(spark, folder)
    so = F.when(F.col("depth") == 7, F.lit(float("nan"))).otherwise(F.col("so"))
    return from_frame(whole.frame.withColumn("so", so), whole.dims, ("so",))


def chl(spark: SparkSession, folder: str) -> Cube:
    """CHL over time, latitude (nation) and segment."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return from_frame(joined.select(
        F.col("o_orderdate").alias("time"),
        F.col("c_nationkey").alias("latitude"),
        F.col("c_mktsegment").alias("segment"),
        hundredths(F.col("o_totalprice")).alias("CHL"),
    ), ("time", "latitude", "segment"))


def surface(spark: SparkSession, folder: str) -> Cube:
    """so along depth, and zos which repeats along it: line and order prices."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return from_frame(joined.select(
        F.col("l_orderkey").alias("place"),
        F.col("l_linenumber").alias("depth"),
        hundredths(F.col("l_extendedprice")).alias("so"),
        hundredths(F.col("o_totalprice")).alias("zos"),
    ), ("place", "depth"))


def mixed(spark: SparkSession, folder: str) -> Dataset:
    """so along place and depth, zos along place alone: order lines and orders."""
    depths = surface(spark, folder).pick("so")
    orders = table(spark, folder, "orders")
    heights = from_frame(orders.select(
        F.col("o_orderkey").alias("place"), hundredths(F.col("o_totalprice")).alias("zos")), ("place",))
    return combine([depths, heights])


def catalog(folder: str) -> Catalog:
    """Data sets to request from: the tables as they are, columns renamed."""
    at = folder.rstrip("/")
    return Catalog({
        "lines_daily": Product(
            f"{at}/lineitem.parquet", ("time", *PLACE), ("so", "tx"),
            {"l_shipdate": "time", "l_linenumber": "depth", "l_quantity": "latitude",
             "l_discount": "longitude", "l_extendedprice": "so", "l_tax": "tx"},
        ),
        "events_track": Product(
            f"{at}/events.parquet", ("time", "event_type", "user_id"), ("value",), {"ts": "time"},
        ),
    })
