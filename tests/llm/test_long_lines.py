"""Runs of few but long lines."""

from collections import defaultdict

import corpus_pipeline
import numpy as np

from pelagrid.llm import line_dedup


def left(docs, run=3, words=50):
    """By all pairs: of equal runs of `run` lines, or of fewer with `words` words, the first stays."""
    places = defaultdict(list)
    full = {i: [n for n, line in enumerate(t.split("\n")) if line.split()] for i, t in docs}
    for i, t in docs:
        lines = t.split("\n")
        for at in range(len(full[i])):
            for k in range(1, run + 1):
                some = full[i][at:at + k]
                whole = tuple(lines[n] for n in some)
                if len(some) == k and (k == run or sum(len(x.split()) for x in whole) >= words):
                    places[whole].append((i, some))
    gone = {(i, n) for found in places.values() for i, some in found[1:] for n in some}
    return [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in docs]


def pick(frame):
    return sorted((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())


def test_long_lines_and_pairs_of_them(spark):
    one = " ".join(f"w{i}" for i in range(50))
    half, rest = " ".join(f"h{i}" for i in range(30)), " ".join(f"r{i}" for i in range(20))
    short = " ".join(f"s{i}" for i in range(49))
    rows = [(1, f"a\n{one}\nb"), (2, one), (3, f"c\n{one}\n\nd"), (4, f"{half}\n{rest}\ne"), (5, f"f\n{half}\n\n{rest}"),
            (6, f"{half}\ng"), (7, short), (8, short), (9, f"{one}\nh\n{one}"), (10, f"x\n{one}"), (11, f"x\n{one}")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    done = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    found = dict(pick(done))
    assert [found[i] for i in (1, 2, 3, 5, 8, 9, 11)] == [f"a\n{one}\nb", "", "c\n\nd", "f\n", short, "h", ""]
    assert pick(done) == left(rows)
    assert done.where("n_chars <> length(text)").count() == 0


def test_any_lines_against_all_pairs(spark):
    draw = np.random.default_rng(4)
    pool = [" ".join(f"p{k}w{i}" for i in range(draw.integers(1, 60))) for k in range(25)]
    rows = [(i, "\n".join(["", *pool][k] for k in draw.integers(0, 26, draw.integers(1, 9)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pick(line_dedup.dedup_lines(docs, words=50)) == left(rows)
    assert pick(line_dedup.dedup_lines(docs)) == left(rows, words=10**9)
