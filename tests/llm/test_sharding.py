"""Shards keep equal texts together, hold equal numbers of rows and the mixture."""

from collections import defaultdict

import pytest

from pelagrid.llm import sharding


def shards(spark, rows, n):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = sharding.sharded(docs, n).collect()
    texts = {i: (t or "", s) for i, t, s in rows}
    held = defaultdict(list)
    for r in found:
        held[r["shard"]].append((r["slot"], *texts[r["id"]]))
    # The law: counts at most one apart, slots without a gap.
    assert sorted(len(held[s]) for s in range(n)) == sorted((len(rows) * (s + 1)) // n - (len(rows) * s) // n for s in range(n))
    assert all(sorted(x[0] for x in held[s]) == list(range(len(held[s]))) for s in range(n))
    return held


def where(held):
    at = defaultdict(set)
    for shard, rows in held.items():
        for _, text, _ in rows:
            at[text].add(shard)
    return at


def test_groups_stay_together(spark):
    rows = [(i, f"group {i % 150}" if i % 2 else f"own {i}", "hot" if i % 3 else f"s{i % 5}") for i in range(1200)]
    held = shards(spark, rows, 8)
    assert all(len(s) == 1 for s in where(held).values())
    for source in ("hot", "s0", "s3"):
        counts = [sum(x[2] == source for x in held[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 25


@pytest.mark.parametrize("n", [1, 3, 7])
def test_a_group_longer_than_a_shard_goes_on(spark, n):
    rows = [(i, "same" if i % 3 else f"own {i % 40}", "a") for i in range(200)] + [(i, None, None) for i in range(200, 206)]
    held = shards(spark, rows, n)
    apart = {t for t, s in where(held).items() if len(s) > 1}
    assert apart <= {"same"} if n > 1 else not apart


def test_nothing_but_groups_and_few_rows(spark):
    shards(spark, [(i, f"t{i % 10}", None) for i in range(95)], 10)
    shards(spark, [(i, "t", "a") for i in range(3)], 5)
