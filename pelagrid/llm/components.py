"""Connected components of a graph whose links lie in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): root is the least node reachable.

    Large star and small star in turn until nothing changes: each node's larger, then
    its smaller neighbours are linked to the least one it knows. Both are a minimum by
    node and a join with it; a node with very many links is one row on the side of the
    minima, and the skew join splits the other side. Each round is written to the shared folder; the
    driver sees a count and a checksum.
    """
    a, b = F.col("a"), F.col("b")
    now = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a != b).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(b.alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        now = written(small.where(a != b).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = now.select(b.alias("node"), b.alias("root")).distinct()
    return now.select(a.alias("node"), b.alias("root")).unionByName(roots)
