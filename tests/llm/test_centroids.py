"""Centroid clustering against full distances, and on odd tables."""

import hashlib
import math

import pytest
from compare import differences, engine

from pelagrid.llm import centroids
from pelagrid.llm.catalogue import QUERIES, SQL


def slow(vectors, k, rounds, size):
    """{position in vectors: (cluster, distance)} and the centroids, by full distances."""
    kept = {i: [math.floor(256 * x) for x in v] for i, (_, v) in enumerate(vectors)
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)}
    rank = {i: (hashlib.sha256(f"2:{'' if vectors[i][0] is None else vectors[i][0]}".encode()).hexdigest(), kept[i]) for i in kept}
    middles = [kept[i] for i in sorted(kept, key=rank.get)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        of = {i: nearest(v)[1] for i, v in kept.items()}
        groups = {c: [kept[i] for i in kept if of[i] == c] for c in range(len(middles))}
        middles = [[sum(col) // len(g) for col in zip(*g)] if g else middles[c] for c, g in groups.items()]
    return {i: nearest(v)[::-1] for i, v in kept.items()}, middles


def test_query_agrees_with_sql(spark, folder):
    name = "op12_centroid_clustering"
    assert differences(QUERIES[name](spark, folder), engine(folder).sql(SQL[name])) == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (1, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-0.001, 0.5]), (3, [5.0, -5.0]), (None, [2.0, 2.0]),
        (4, None), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, None]), (9, [nan, 0.0]), (10, [0.0, inf]), (11, [-inf, 0.0])]
    frame = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id bigint, embedding array<float>, cluster string, x int")
    for k in (1, 3, 40):
        expected, middles = slow(vectors, k, 5, 2)
        found = centroids.clustered(frame, centroids=k, size=2).collect()
        wanted = sorted((vectors[i][0] or 0, c, d, tuple(middles[c])) for i, (c, d) in expected.items())
        assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"], tuple(r["centroid"])) for r in found) == wanted
        total = sum(d for _, d in expected.values())
        assert {r["inertia"] for r in found} == {total}
        for r in found:
            assert r["cluster_inertia"] == sum(d for c, d in expected.values() if c == r["cluster"])


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    found = centroids.digest(frame)
    assert found.count() == 0
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_component_without_exact_distance(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="no exact distances"):
        centroids.clustered(frame, size=2).collect()


def test_products_follow_changed_components_alone(spark):
    """A centroid that does not move changes no product: the state is the same."""
    import numpy as np

    frame = spark.createDataFrame([(1, [3, 4], [])], "id bigint, x array<bigint>, dots array<bigint>")
    one = centroids._assigned(frame, np.zeros((2, 2), np.int64), np.array([[1, 0], [0, 2]]))
    assert one.first()["dots"] == [3, 8]
    two = centroids._assigned(one, np.array([[1, 0], [0, 2]]), np.array([[1, 0], [5, 2]]))
    assert two.first()["dots"] == [3, 23] and (two.first()["cluster"], two.first()["distance"]) == (1, 8)
