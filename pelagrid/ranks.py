"""Global ranks and running totals without gathering the rows in one task."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import written

PART, SHIFT = "__part", "__shift"
# Rows of a range where they are counted first.
RANGE = 200_000


def ranked(frame: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """The rows with their rank from 0 in `order`, as a bigint column `name`.

    Rows that are equal in the whole order get ranks in any order; they fall into one
    range, so let the order end with a column that tells them apart.
    """
    return before(frame, order, F.lit(1), name)


def before(frame: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """The rows with the total weight of the rows before them in `order`, as a bigint
    column `name`.

    Rows are dealt out by ranges of the order and written once, so that the ranges
    stay what they are if an executor is lost. Each range is added up on its own and
    shifted by the total of the ranges before it; the driver holds one number a range.
    """
    return _before(frame, order, weight, name, written, _ranges(frame))


def ranked_in_memory(frame: DataFrame, order: Sequence[Column], name: str = "position") -> tuple[DataFrame, int]:
    """`ranked` for what is asked often, such as an axis, and the number of rows. `frame` should be cached, and
    must give the same rows each time. There are as many ranges as its counted rows need; they and
    the ranks are cached by Spark and not written. A lost part of
    the cache comes again from the ranges that were drawn before, as they belong to the cached plan."""
    n = frame.count()
    ranks = _before(frame, order, F.lit(1), name, cached, _ranges(frame, n))
    return cached(ranks), n


@contextmanager
def ranked_once(frame: DataFrame, order: Sequence[Column], name: str = "position") -> Iterator[tuple[DataFrame, int]]:
    """As `ranked_in_memory`, for one use: nothing stays cached afterwards."""
    with _once(frame, order, F.lit(1), name) as found:
        yield found


@contextmanager
def running(frame: DataFrame, order: Sequence[Column], weight: Column, name: str) -> Iterator[DataFrame]:
    """As `before`, for one use and in memory: `frame` must give the same rows each time."""
    with _once(frame, order, weight, name) as (found, _):
        yield found


@contextmanager
def _once(frame: DataFrame, order: Sequence[Column], weight: Column, name: str) -> Iterator[tuple[DataFrame, int]]:
    held = [frame.persist()]

    def hold(dealt: DataFrame) -> DataFrame:
        held.append(dealt.persist())
        return held[-1]

    try:
        n = held[0].count()
        yield _before(held[0], order, weight, name, hold, _ranges(frame, n)), n
    finally:
        for kept in held:
            kept.unpersist()


def cached(frame: DataFrame) -> DataFrame:
    return frame if frame.storageLevel.useMemory else frame.persist()


def _ranges(frame: DataFrame, rows: int | None = None) -> int:
    """Ranges for so many rows, and no more than there are shuffle partitions."""
    most = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return most if rows is None else max(1, min(most, -(-rows // RANGE)))


def _before(frame: DataFrame, order: Sequence[Column], weight: Column, name: str,
            frozen: Callable[[DataFrame], DataFrame], ranges: int) -> DataFrame:
    spark = frame.sparkSession
    dealt = frame.withColumn(name, weight.cast("bigint")).repartitionByRange(ranges, *order)
    kept = frozen(dealt.withColumn(PART, F.spark_partition_id()))
    earlier = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = kept.withColumn(name, F.coalesce(F.sum(name).over(earlier), F.lit(0)))
    if ranges == 1:
        return within.drop(PART)
    totals = sorted(tuple(r) for r in kept.groupBy(PART).agg(F.sum(name)).collect())
    shifts = [{PART: part, SHIFT: at} for (part, _), at in zip(totals, [0, *accumulate(n for _, n in totals)])]
    listed = F.from_json(F.lit(json.dumps(shifts)), f"array<struct<{PART}:int,{SHIFT}:bigint>>")
    shifts = spark.range(1).select(F.inline(listed))
    shifted = within.join(F.broadcast(shifts), PART)
    return shifted.withColumn(name, F.col(name) + F.col(SHIFT)).drop(PART, SHIFT)


def furthest_before(frame: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The rows with the largest value among the rows before them in `order`, as a column `name`.

    As in `before` rows are dealt out by ranges; each looks back within its range, and over the largest
    values of the ranges before it, one small row a range.
    """
    dealt = cached(frame.withColumn(name, value).repartitionByRange(_ranges(frame), *order).withColumn(PART, F.spark_partition_id()))
    most = dealt.groupBy(PART).agg(F.max(name).alias(SHIFT))
    listed = most.agg(F.collect_list(F.struct(PART, SHIFT)).alias("all"))
    reach = most.select(PART).join(F.broadcast(listed)).select(PART, F.array_max(F.transform(
        F.filter("all", lambda r: r[PART] < F.col(PART)), lambda r: r[SHIFT])).alias(SHIFT))
    earlier = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn(name, F.max(name).over(earlier)).join(F.broadcast(reach), PART)
    return within.withColumn(name, F.greatest(name, SHIFT)).drop(PART, SHIFT)
