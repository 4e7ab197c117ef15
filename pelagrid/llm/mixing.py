"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import ranked
from ..session import written
from .common import WORD, Docs, small

MOST_COPIES = 3
# Documents a flight takes at once: bounds the memory of a task.
BLOCK = 4096


def mixture(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each document goes into a mix of the given weights and total size.

    The size of a document is its number of words, 0 for null. Sources in order of
    their code points, null last, weigh 1, 2, 3, repeating, and share the size of
    all documents; a target stops at MOST_COPIES times the size of its source, and
    what is over goes to the others by weight until none is above.

    A source is taken at the rate target / size: each of its documents as often as
    the whole part of the rate says, and once more with the fraction as probability.
    These probabilities take the flight of the cube method: three at a time move in
    the null space of (size, 1) until one is 0 or 1, so that words and documents of
    a source keep their totals. Blocks of a source, by rank in a shuffled order, so that no
    number of equal rows makes one longer, fly apart from each other
    and leave two fractions at most; these fly on together, level by level, until a
    source has two left, which land where its words come nearest to their total.
    Steps are drawn from the ids, so reruns agree.

    Returns a row per row of `docs`: kid, kt, row (a number of its own), id, source, size, source_size, target, copies,
    taken. Repeated rows are units of their own. Empty texts have size 0, count as
    documents, and are taken like others. An empty table gives no rows.
    """
    table = Docs(docs, id, text)
    return _mixture(table.frame.withColumn("row", F.monotonically_increasing_id()), table.column(source))


def _mixture(rows: DataFrame, source: Column) -> DataFrame:
    """`mixture` of rows with a number `row` of their own, which stays with them."""
    units = written(rows.select(
        "kid", "kt", "row", "id", source.cast("string").alias("source"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("size")))
    # Equal rows get different places, in whatever order: they are alike in all that counts.
    shuffled = [F.col("source").asc_nulls_last(), F.xxhash64("kid", "kt"), F.col("kid"), F.col("kt"), F.col("row")]
    units = ranked(units, shuffled, "place")
    sources = written(targets(units.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_docs"), F.min("place").alias("first"))))
    rated = units.join(small(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rated = rated.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rated.withColumn("whole", F.least(F.floor("rate"), F.lit(MOST_COPIES)).cast("int"))
    rated = rated.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rated = rated.withColumn("p", F.when(F.col("whole") >= MOST_COPIES, 0.0).otherwise(F.col("p")))
    chosen = flights(rated, sources.agg(F.max("source_docs").alias("n")).first()["n"] or 0)
    copies = F.col("whole") + F.col("extra")
    return chosen.select(
        "kid", "kt", "row", "id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"),
        (F.col("size") * copies).cast("bigint").alias("taken"))


def targets(sources: DataFrame) -> DataFrame:
    """The sources with their rank, weight and target.

    A target is the lesser of its cap and weight * level. The level that shares out
    the total rises until no target passes its cap; each step is one sum over the
    sources, and there are no more steps than sources.
    """
    weighted = written(ranked(sources, [F.col("source").asc_nulls_last()], "rank").withColumns({
        "weight": (F.col("rank") % 3 + 1).cast("double"),
        "cap": (F.col("source_size") * MOST_COPIES).cast("double")}))
    total = float(weighted.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        held, free = weighted.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or (next_level := (total - held) / free) <= level:
            break
        level = next_level
    return weighted.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)))


def flights(rated: DataFrame, most_docs: int) -> DataFrame:
    """The rows with `extra` 0 or 1 drawn by the cube method from `p`, within each source."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rated.schema.fields)}, x double, block bigint"
    state = rated.withColumn("x", F.col("p")).withColumn(
        "block", F.floor((F.col("place") - F.col("first")) / BLOCK).cast("bigint"))
    landed, levels = [], 0
    blocks = max(1, -(-most_docs // BLOCK))
    while True:
        last = blocks == 1
        open_ = (F.col("x") > 0) & (F.col("x") < 1)
        flown = state.groupBy("source", "block").applyInPandas(_flight(levels), schema)
        flown = written(flown)
        landed.append(flown.where(~open_))
        if last:
            landed.append(flown.where(open_).groupBy("source").applyInPandas(_landing, schema))
            break
        blocks = max(1, -(-2 * blocks // BLOCK))
        levels += 1
        left = F.ceil(F.col("source_docs") / BLOCK)
        for _ in range(levels):
            left = F.ceil(2 * left / BLOCK)
        state = flown.where(open_).withColumn("block", _block(left, "block"))
    done = landed[0]
    for more in landed[1:]:
        done = done.unionByName(more)
    return done.withColumn("extra", F.col("x").cast("int"))


def _block(blocks: Column, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), F.greatest(blocks, F.lit(1)).cast("bigint"))


def _flight(level: int):
    def fly(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kid", "kt", "size"], kind="stable").reset_index(drop=True)
        first = rows.iloc[0]
        seed = [level, int(first["block"]) % 2**32, int(first["kid"]) % 2**32]
        x = flown(rows["x"].to_numpy(float).copy(), rows["size"].to_numpy(float), np.random.default_rng(seed))
        return rows.assign(x=x)

    return fly


def flown(x: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The probabilities after the flight: all but two at most are 0 or 1, and the
    sums of x and of x * size are what they were."""
    waiting = np.flatnonzero((x > 0) & (x < 1))
    # Long documents fly first: the short ones after them can still even them out.
    draw.shuffle(waiting)
    waiting = waiting[np.argsort(size[waiting], kind="stable")]
    luck = draw.random(len(waiting) + 2).tolist()
    values, sizes = x.tolist(), size.tolist()
    waiting = waiting.tolist()
    held: list[int] = []
    while waiting or len(held) == 3:
        while waiting and len(held) < 3:
            held.append(waiting.pop())
        if len(held) < 3:
            break
        i, j, k = held
        step = (sizes[j] - sizes[k], sizes[k] - sizes[i], sizes[i] - sizes[j])
        if not any(step):
            step = (1.0, -1.0, 0.0)
        scale = max(map(abs, step))
        step = tuple(s / scale for s in step)
        moved = [(values[n], s) for n, s in zip(held, step) if s]
        up = min((1 - v) / s if s > 0 else v / -s for v, s in moved)
        down = min(v / s if s > 0 else (1 - v) / -s for v, s in moved)
        way = up if luck.pop() * (up + down) < down else -down
        for n, s in zip(held, step):
            v = values[n] + way * s
            values[n] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        held = [n for n in held if 0 < values[n] < 1]
        if not luck:
            luck = draw.random(1024).tolist()
    return np.array(values)


def _landing(rows: pd.DataFrame) -> pd.DataFrame:
    """The last fractions of a source, two at most, become 0 or 1: of all outcomes
    the one whose words come nearest to what the fractions stand for."""
    rows = rows.sort_values(["kid", "kt", "size"], kind="stable").reset_index(drop=True)
    x, size = rows["x"].to_numpy(float), rows["size"].to_numpy(float)
    outcomes = (np.arange(2 ** len(rows))[:, None] >> np.arange(len(rows)) & 1).astype(float)
    off = np.abs(outcomes @ size - x @ size) + 1e-6 * np.abs(outcomes.sum(1) - x.sum())
    return rows.assign(x=outcomes[off.argmin()])


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the columns of `docs`, each row as often as `mixture` says."""
    table = Docs(docs, id, text)
    # Written once, so that a row keeps its number.
    rows = written(table.frame.withColumn("row", F.monotonically_increasing_id()))
    found = _mixture(rows, table.column(source)).where("copies > 0").select("row", "copies")
    joined = rows.join(found, "row")
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies")))
    return table.restored(joined.withColumn("copy", times))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    return mixture(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
