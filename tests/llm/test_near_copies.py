"""The near-copies stage against Jaccard similarities of all pairs."""

import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pelagrid.llm import near_copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(texts):
    """The least id of each component of near copies."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and label[i] != label[j] and alike(sets[i], sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return set(label.values())


def test_stage_keeps_one_of_each_group_by_jaccard(spark):
    draw = np.random.default_rng(5)
    texts, n = {}, 0
    for g in range(40):
        words = [f"w{x}" for x in draw.integers(0, 500, draw.integers(12, 300))]
        for _ in range(4):
            copy = list(words)
            for at in draw.integers(0, len(words), draw.integers(0, max(2, len(words) // 20))).tolist():
                copy[at] = f"x{g}"
            texts[n] = " ".join(copy).upper() if n % 7 == 0 else " ".join(copy)
            n += 1
    texts |= {900: "", 901: None, 902: "a b", 903: "A  b", 904: "a c"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert found == sorted(kept({i: t or "" for i, t in texts.items()}))


def test_stage_on_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    found = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert found == sorted(kept(texts))


def test_buckets_that_grow_do_not_pair_what_is_joined():
    draw = np.random.default_rng(2)
    base = np.unique(draw.integers(0, 2**63, 100, dtype=np.uint64))
    sets = [np.unique(np.append(base, draw.integers(0, 2**63, 3, dtype=np.uint64))) for _ in range(500)]
    assert len(near_copies.joined(sets)) == 499


def test_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q")], "doc_id long, text string")
    assert sorted(map(repr, (r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()))) == ["1", "None"]
    assert corpus_pipeline.drop_near_copies(spark, docs.where(F.lit(False)), "").count() == 0


def test_close_copies_are_linked_by_fingerprints_in_trees(spark):
    """SimHash and BK-trees alone find the closest copies; each of their links is a near copy."""
    draw = np.random.default_rng(8)
    texts = {}
    for g in range(30):
        words = [f"w{x}" for x in draw.integers(0, 5000, 600)]
        texts[3 * g] = " ".join(words)
        texts[3 * g + 1] = " ".join([*words, "more"])
        words[300:500] = [f"x{x}" for x in draw.integers(0, 5000, 200)]
        texts[3 * g + 2] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = near_copies.sketched(docs).cache()
    number = {r["fingerprint"]: r["id"] for r in rows.collect()}
    nodes = rows.select("fingerprint", F.struct("kid", "kt").alias("place"), "bands", "prints")
    found = {tuple(sorted((number[r["a"]], number[r["b"]]))) for r in near_copies.by_fingerprint(near_copies.Docs(docs).slim("text"), nodes).collect()}
    assert found == {(3 * g, 3 * g + 1) for g in range(30)}


def test_what_is_joined_already_is_not_paired():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in range(4)]
    assert near_copies.joined(sets, [7, 7, 7, 7]) == []
    assert len(near_copies.joined(sets, [7, 7, 9, 9])) == 1


def test_fingerprints_take_the_majority_of_each_bit():
    for n in (1, 2, 255, 256, 3000):
        found = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        for k, print_ in enumerate(near_copies.prints(found).tolist()):
            mixed = near_copies._mixed(found * near_copies.FACTORS[k]).tolist()
            assert print_ == sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > n)
