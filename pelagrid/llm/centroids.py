"""Centroid clustering with exact integers: each vector keeps its dot products with all centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

CENTROIDS, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
# Components below this keep every product and distance inside a long.
LARGEST = 2**27


def clustered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS,
              rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept vector: the id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components).

    Kept are vectors of exactly `size` components, none null or non-finite; a component
    becomes the integer floor(scale * x). Rows that repeat an id are vectors of their own.
    The first centroids are the vectors whose `seed:id` has the least SHA-256, in that
    order, those of one id by their components; a null id counts as empty text there. With
    fewer vectors than `centroids` there are as many centroids as vectors, and without
    any the result is empty. A component of LARGEST or more, for which distances need not fit
    in a long, raises. Other columns of `vectors` play no part.

    A vector is stored with its dot product with every centroid. Each round changes the
    products by the components of a centroid that changed, and no others; the nearest
    centroid follows from the products and the centroid's own length. The driver holds
    the centroids, of a number and size that are parameters; sums per cluster are one small row a
    task. Each round is a table in the shared folder, and the one before it goes.
    """
    spark = vectors.sparkSession
    state = _Kept.of(_integers(vectors, id, vector, size, scale), spark)
    middles = _first(state.frame, centroids, size, seed)
    if not len(middles):
        return _described(state.frame.selectExpr("id", "0 cluster", "0L distance"), id, middles, {})
    known = np.zeros_like(middles)
    for turn in range(rounds + 1):
        state = state.replaced_by(_assigned(state.frame, known, middles))
        known = middles
        if turn < rounds:
            middles = _moved(state.frame, middles)
    totals = state.frame.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()
    return _described(state.frame, id, middles, {r["cluster"]: r["d"] for r in totals})


class _Kept:
    """A table in the shared folder that goes when the next one is there."""

    def __init__(self, spark: SparkSession, path: str, frame: DataFrame):
        self.spark, self.path, self.frame = spark, path, frame

    @classmethod
    def of(cls, frame: DataFrame, spark: SparkSession) -> _Kept:
        path = shared_folder(spark)
        frame.write.parquet(path)
        return cls(spark, path, spark.read.schema(frame.schema).parquet(path))

    def replaced_by(self, frame: DataFrame) -> _Kept:
        new = _Kept.of(frame, self.spark)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return new


def _integers(vectors: DataFrame, id: str, vector: str, size: int, scale: int) -> DataFrame:
    """id, x (integers) and an empty list of products."""
    plain = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v"))

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def whole(x: Column) -> Column:
        at = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, at).otherwise(
            F.raise_error(F.lit(f"a component of {LARGEST // scale} or more has no exact distances")).cast("bigint"))

    kept = plain.where(F.col("v").isNotNull() & (F.size("v") == size)).where(F.forall("v", usable))
    return kept.select("id", F.transform("v", whole).alias("x"), F.array().cast("array<bigint>").alias("dots"))


def _first(vectors: DataFrame, centroids: int, size: int, seed: int) -> np.ndarray:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(named, 256).alias("rank"), "x").orderBy("rank", "x").limit(centroids).collect()
    return np.array([r["x"] for r in rows], np.int64).reshape(-1, size)


def _assigned(state: DataFrame, known: np.ndarray, middles: np.ndarray) -> DataFrame:
    """The state with its products brought from the centroids `known` to `middles`,
    and the nearest centroid of each vector; of equally near ones the first."""
    change = middles - known
    moved = [np.flatnonzero(row) for row in change]
    lengths = (middles * middles).sum(1)
    n, size = middles.shape

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            x = batch.column("x").flatten().to_numpy().reshape(-1, size)
            dots = batch.column("dots").flatten().to_numpy().reshape(len(x), -1)
            dots = dots.copy() if dots.shape[1] else np.zeros((len(x), n), np.int64)
            for c, at in enumerate(moved):
                if len(at):
                    dots[:, c] += x[:, at] @ change[c, at]
            apart = lengths - 2 * dots
            cluster = apart.argmin(1)
            distance = (x * x).sum(1) + apart[np.arange(len(x)), cluster]
            offsets = pa.array(np.arange(0, (len(x) + 1) * n, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("x"), pa.ListArray.from_arrays(offsets, pa.array(dots.ravel())),
                 pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["id", "x", "dots", "cluster", "distance"])

    schema = T.StructType([*state.schema.fields[:3], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return state.select("id", "x", "dots").mapInArrow(batches, schema)


def _moved(state: DataFrame, middles: np.ndarray) -> np.ndarray:
    """Each centroid as the rounded-down mean of its vectors; one without vectors stays."""
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(middles.shape[1])]
    new = middles.copy()
    for cluster, n, *total in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        new[cluster] = [t // n for t in total]
    return new


def _described(state: DataFrame, id: str, middles: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """The assignment with what belongs to its cluster; one small row a centroid."""
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), m.tolist()) for c, m in enumerate(middles)]
    each = state.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    joined = state.select("id", "cluster", "distance").join(F.broadcast(each), "cluster")
    return joined.select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(vectors: DataFrame) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    named = F.sha2(F.array_join("centroid", ","), 256)
    return clustered(vectors).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))


def sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle_sql() -> str:
    """The query for another engine, by full distances, with a step a round."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY rank) - 1 AS INTEGER) AS cluster, x AS m FROM (
  SELECT sha256('{SEED}:' || vec_id) AS rank, x FROM kept ORDER BY rank LIMIT {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, c := cluster)) AS best FROM (
    SELECT vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept, m{i}) GROUP BY vec_id)""")
        if i < ROUNDS:
            steps.append(f"""m{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(any_value(new), any_value(m)) AS m FROM m{i} LEFT JOIN (
    SELECT c, list(f ORDER BY j) AS new FROM (
      SELECT best.c AS c, j, CAST((sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
      FROM a{i}, range(1, {SIZE + 1}) t(j) GROUP BY ALL) GROUP BY c) ON c = cluster GROUP BY cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN m{ROUNDS} ON best.c = cluster"""
