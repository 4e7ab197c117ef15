"""The suffix tree against a version with dictionaries of words, and on odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagrid.llm import suffix_tree
from pelagrid.llm.catalogue import QUERIES


class Slow:
    """The same model by the words themselves."""

    def __init__(self, texts, share=suffix_tree.SHARE, depth=suffix_tree.DEPTH):
        docs = [self.tokens(t) for t in texts]
        self.c = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        least = max(2, math.ceil(self.n / 2**share))
        self.next, self.occurs = {}, {}
        known = {(w,): k for w, k in self.c.items() if k >= least and w != "\n"} | {("",): len(docs)}
        for length in range(1, depth + 1):
            grams = Counter()
            for d in docs:
                row = ["", *d]
                for i in range(length, len(row)):
                    s, w = tuple(row[i - length:i]), row[i]
                    if s in known and (w == "\n" or self.c[w] >= least) and (length == 1 or (*s[1:], w) in upper):
                        grams[s, w] += 1
            upper = {(*s, w): k for (s, w), k in grams.items() if k >= least}
            for s in {g[:-1] for g in upper}:
                self.next[s], self.occurs[s] = {}, known[s]
            for g, k in upper.items():
                self.next[g[:-1]][g[-1]] = k
            known = {g: k for g, k in upper.items() if g[-1] != "\n"}
        self.kept = set()
        for s, following in self.next.items():
            parts = len(following) + 1
            apart = mass = 0
            for w in following:
                p, q = self.chance(w, s), self.chance(w, s[1:])
                apart, mass = apart + p * math.log(p / q), mass + p
            apart += (1 - mass) * math.log(self.rest(s))
            if self.occurs[s] * apart >= parts * math.log(max(self.n, 2)):
                self.kept |= {s[i:] for i in range(len(s))}

    @staticmethod
    def tokens(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]

    def rest(self, s):
        parts = len(self.next[s]) + 1
        return (self.occurs[s] - sum(self.next[s].values()) + parts) / (self.occurs[s] + parts)

    def chance(self, w, s):
        if not s:
            return (self.c[w] + 1) / (self.n + self.v + 1)
        if s not in self.next:
            return self.chance(w, s[1:])
        return self.next[s].get(w, 0) / (self.occurs[s] + len(self.next[s]) + 1) + self.rest(s) * self.chance(w, s[1:])

    def score(self, text, depth=suffix_tree.DEPTH):
        row = ["", *self.tokens(text)]
        total = base = 0
        for i in range(1, len(row)):
            s = next((tuple(row[j:i]) for j in range(max(0, i - depth), i) if tuple(row[j:i]) in self.kept), ())
            total += math.log10(self.chance(row[i], s))
            base += math.log10(self.chance(row[i], ()))
        return len(row) - 1, sum(self.c[w] > 0 for w in row[1:]), self.n, base, total


def checked(found, rows, slow):
    """found: rows of digest; rows: (id, text)."""
    wanted = sorted(((i or 0, *slow.score(t)) for i, t in rows))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    for g, w in zip(got, wanted):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def test_query_agrees_with_dictionaries(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    slow = Slow([t for i, t in rows if not out(i)])
    found = QUERIES["op11_lm_scoring"](spark, folder).collect()
    assert {r["doc_id"] for r in found if r["held_out"]} == {i for i, _ in rows if out(i)}
    assert {len(s) for s in slow.kept} == {1, 2, 3}
    checked(found, rows, slow)
    # Contexts are worth something, and on texts that were not learned from, too.
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_documents(spark):
    text = "the cat sat on the mat . the cat sat on the hat . "
    rows = [(1, text), (1, text), (1, text), (2, text + "A DOG"), (3, None), (4, ""), (5, " \n\t"), (None, "the cat sat"),
            (6, "x" * 200_000), (7, "Ä ä É the"), (8, "퟿ \U0001F600 the cat"), (9, text * 3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS ids", "2 AS k0", "true AS train")
    checked(suffix_tree.digest(frame).collect(), rows, Slow([t for i, t in rows if not out(i)]))


def test_bound_by_share(spark, monkeypatch):
    """A larger share of the tokens is asked for, as with a large corpus."""
    monkeypatch.setattr(suffix_tree, "SHARE", 6)
    monkeypatch.setattr(suffix_tree, "HELD", 3)
    rows = [(i, "one two three four " * (i % 5) + f"rare{i} " + "one two six " * 4) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    slow = Slow([t for i, t in rows if not out(i)], share=6)
    model = suffix_tree.fit(frame, ~suffix_tree.held_out())
    assert all(len(level.keys) <= 2**6 for level in model.levels) and len(model.hashes) <= 2**6
    checked(suffix_tree.digest(frame).collect(), rows, slow)


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d " * 5 + "e f") for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = suffix_tree.fit(frame, F.lit(True))
    assert all(level.kept.any() for level in model.levels)
    every = [suffix_tree.END, *range(suffix_tree.FIRST, len(model.numbers))]
    unknown = 1 / model.total
    for context in ([], [3], [3, 4], [4, 5, 3], [5, 5, 5]):
        x = np.array([n for w in [*every, suffix_tree.RARE] for n in (suffix_tree.BEGIN, *context, w)])
        found = suffix_tree.chances(x, model)[1][len(context) + 1::len(context) + 2]
        assert found[:-1].sum() + found[-1] * unknown == pytest.approx(1)


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_tree.digest(empty).collect() == []
    none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    found = suffix_tree.scored(none, F.lit(None)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
