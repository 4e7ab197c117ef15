"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import before, ranked
from .common import Docs, small

SHARDS = 40
SEED = "17"


def sharded(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED,
    id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Every document with its shard and its slot there, by the law `rows`: the
    shards' numbers of rows are at most one apart.

    Equal texts are a group, a text that is alone one of one row, and of the source of its row with
    the least id. The groups of each source are shuffled by a seeded hash of that id; a
    group of n rows with r rows before it among N has the fractional rank (r + n/2) / N. In the
    order of the fractional ranks, ties by source and shuffle, the rows are cut into shards of
    equal length, so that each holds the sources in the proportions of the whole.

    Groups stay in one shard: those of several rows go where they start in this order, before
    the shard's single rows, which fill what is left of the shards
    in their order. Only what such groups are over the length of a shard goes on as single rows do.

    Null is a source of its own, the last. Null ids are shuffled as one; rows that repeat id and
    text follow each other. An empty table gives no rows. All rankings deal the
    rows out by ranges, so a source or a group with most of the rows is split between tasks.

    Returns kid, kt, id, source, size (UTF-8 bytes, null none, and 16), text_crc32,
    shard, slot.
    """
    table = Docs(docs, id, text)
    rows = table.slim(
        "id", table.column(source).cast("string").alias("source"),
        (F.octet_length("text") + 16).cast("bigint").alias("size"), F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("shuffle"))
    total = rows.count()
    first = [(s * total + shards - 1) // shards for s in range(shards + 1)]
    room = [b - a for a, b in zip(first, first[1:])]

    # The groups, ranked within sources, then over all: where they start, and the shard that is there.
    shuffled = [F.col("source").asc_nulls_last(), F.col("shuffle"), F.col("kid"), F.col("kt")]
    groups = rows.groupBy("text_a", "text_b").agg(
        F.count("*").alias("n"), F.min(F.struct("kid", "kt", "shuffle", "source")).alias("least"))
    placed = before(groups.select("text_a", "text_b", "n", "least.*"), shuffled, F.col("n"), "place")
    sources = placed.groupBy("source").agg(F.min("place").alias("first"), F.sum("n").alias("of"))
    known = placed.join(small(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    spread = known.withColumn("fraction", (F.col("place") - F.col("first") + F.col("n") / 2) / F.col("of"))
    order = [F.col("fraction"), F.col("source").asc_nulls_last(), F.col("place")]
    spread = spread.select("text_a", "text_b", "n", "source", "place", "fraction")
    started = before(spread, order, F.col("n"), "start").withColumn(
        "shard", F.expr(f"(start * {shards}) div {max(total, 1)}").cast("int")).drop("source", "place", "fraction")
    several = before(started.where("n > 1"), [F.col("start")], F.col("n"), "at")
    loads = {r["shard"]: r for r in several.groupBy("shard").agg(F.sum("n").alias("load"), F.min("at").alias("base")).collect()}
    base = [loads[s]["base"] if s in loads else 0 for s in range(shards)]
    used = [min(loads[s]["load"], room[s]) if s in loads else 0 for s in range(shards)]
    slots = several.withColumn("at", F.col("at") - _of(base, F.col("shard"))).unionByName(
        started.where("n = 1").withColumn("at", F.lit(None).cast("bigint"))).drop("n")

    members = rows.join(slots, ["text_a", "text_b"]).drop("text_a", "text_b")
    rows = ranked(members, [F.col("start"), *shuffled], "row").withColumn("slot", F.col("at") + F.col("row") - F.col("start"))
    fits = F.coalesce(F.col("slot") < _of(room, F.col("shard")), F.lit(False))
    columns = ["kid", "kt", "id", "source", "size", "text_crc32", "shard", "slot"]

    # The others fill what is free, in order.
    ends = list(accumulate(r - u for r, u in zip(room, used)))
    skipped = [end - (r - u) - u for end, r, u in zip(ends, room, used)]
    others = ranked(rows.where(~fits).drop("shard", "slot"), ["row"], "rest")
    filled = others.withColumn("shard", F.size(F.filter(_bigints(ends), lambda end: end <= F.col("rest"))))
    filled = filled.withColumn("slot", F.col("rest") - _of(skipped, F.col("shard")))
    return rows.where(fits).select(*columns).unionByName(filled.select(*columns))


def _bigints(numbers: list[int]) -> Column:
    return F.array(*[F.lit(n).cast("bigint") for n in numbers])


def _of(numbers: list[int], shard: Column) -> Column:
    return F.get(_bigints(numbers), shard)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return sharded(docs).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# CRC-32 by its definition, a step a byte, as the other engine has no such function.
ORACLE_SQL = f"""
WITH table_of AS (
  SELECT list(c ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT range::BIGINT AS i FROM range(256)))),
sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS shuffle,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
summed AS (
  SELECT * EXCLUDE (bytes, steps), xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM sized, table_of),
firsts AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY t) AS n FROM summed),
grouped AS (SELECT t, n, source, sum(n) OVER (PARTITION BY source ORDER BY shuffle, doc_id) - n AS r,
    sum(n) OVER (PARTITION BY source) AS total_of, shuffle, doc_id FROM firsts WHERE i = 1),
spread AS (SELECT t, sum(n) OVER (ORDER BY (r + n / 2.0::DOUBLE) / total_of, source NULLS LAST, r) - n AS start FROM grouped),
started AS (SELECT f.*, start, count(*) OVER () AS total,
    row_number() OVER (ORDER BY start, source NULLS LAST, shuffle, doc_id) - 1 AS row FROM firsts f JOIN spread USING (t)),
owned AS (SELECT *, start * {SHARDS} // total AS own FROM started),
slotted AS (SELECT *, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY n > 1, own ORDER BY row) - 1 END AS pos,
    ((own + 1) * total + {SHARDS - 1}) // {SHARDS} - (own * total + {SHARDS - 1}) // {SHARDS} AS room FROM owned),
others AS (SELECT *, row_number() OVER (ORDER BY row) - 1 AS rest FROM slotted WHERE pos IS NULL OR pos >= room),
shards AS (SELECT s AS shard, ((s + 1) * total + {SHARDS - 1}) // {SHARDS} - (s * total + {SHARDS - 1}) // {SHARDS} AS room,
    (SELECT count(*) FROM slotted x WHERE x.own = s AND x.pos < x.room) AS used
  FROM range({SHARDS}) AS q(s), (SELECT count(*) AS total FROM documents)),
ends AS (SELECT *, sum(room - used) OVER (ORDER BY shard) AS upto FROM shards),
placed AS (
  SELECT doc_id, size, text_crc32, own AS shard, pos AS slot FROM slotted WHERE pos < room
  UNION ALL SELECT doc_id, size, text_crc32, shard, rest - (upto - (e.room - used)) + used
    FROM others o JOIN ends e ON rest < upto AND rest >= upto - (e.room - used))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, slot::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed"""
