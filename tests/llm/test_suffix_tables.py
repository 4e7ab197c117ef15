"""The suffix tree in tables against dictionaries of words: nothing that was seen twice is left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_suffix_tree import Slow, checked, out

from pelagrid import session
from pelagrid.llm import suffix_tables, suffix_tree
from pelagrid.llm.catalogue import QUERIES

ROWS = [(i, "one two three four " * (i % 5) + f"rare{i} " + "one two six " * 4 + f"few{i // 4} of{i // 4} these{i // 4} " * 6) for i in range(40)]


@pytest.mark.parametrize("head", [3, 6, suffix_tables.HEAD])
def test_query_takes_what_the_bounded_tree_leaves_out(spark, tmp_path, monkeypatch, head):
    """Contexts and next tokens are in the tree however small their share of the tokens is."""
    monkeypatch.setattr(suffix_tree, "SHARE", 6)
    monkeypatch.setattr(suffix_tables, "HEAD", head)
    monkeypatch.setattr(suffix_tables, "HELD", 3)
    monkeypatch.setattr(suffix_tables, "PORTION", 100)
    spark.createDataFrame(ROWS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    checked(QUERIES["op11_lm_scoring"](spark, str(tmp_path)).collect(), ROWS, Slow([t for i, t in ROWS if not out(i)], share=20))


def test_full_filters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_tables, "MOST_BITS", 8)
    monkeypatch.setattr(suffix_tables, "CHUNK", 8)
    monkeypatch.setattr(suffix_tables, "HEAD", 4)
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    checked(suffix_tables.digest(frame).collect(), ROWS, Slow([t for i, t in ROWS if not out(i)]))


def test_odd_documents(spark):
    text = "the cat sat on the mat . the cat sat on the hat . "
    rows = [(1, text), (1, text), (1, text), (2, text + "A DOG"), (3, None), (4, ""), (5, " \n\t"), (None, "the cat sat"),
            (6, "x" * 200_000), (7, "Ä ä É the"), (8, "퟿ \U0001F600 the cat"), (9, text * 3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS row", "'x' AS ids", "2 AS k0", "true AS train")
    checked(suffix_tables.digest(frame).collect(), rows, Slow([t for i, t in rows if not out(i)]))


def test_tables_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_tables.digest(empty).collect() == []
    none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    found = suffix_tables.scored(none, F.lit(None)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def test_keys_are_those_of_spark(spark):
    a, b = np.random.default_rng(1).integers(-2**63, 2**63, (2, 50))
    frame = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    assert [r[0] for r in frame.select(F.xxhash64("a", "b")).collect()] == suffix_tables.paired(a, b).tolist()


def test_tables_hold_what_can_be_worth_its_entries_and_go(spark, monkeypatch):
    """Contexts seen less than WORTH times are in no table, and tables of counts and levels do not stay."""
    made = []

    def noted(frame, path=None):
        table = session.written(frame, path)
        made.append((table.columns, table.agg(F.min("occurs")).first()[0] if "occurs" in table.columns else None, table))
        return table

    monkeypatch.setattr(suffix_tables, "written", noted)
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    checked(suffix_tables.digest(frame).collect(), ROWS, Slow([t for i, t in ROWS if not out(i)]))
    assert min(least for _, least, _ in made if least is not None) >= 4
    levels = [table.inputFiles for columns, _, table in made if columns[:3] == ["context", "shorter", "n"]]
    assert len(levels) == 6
    for files in levels:
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(files()[0]).count()


def test_sequences_that_share_half_their_bits_are_counted_apart():
    """Two contexts with the same upper bits before the same word, and one before two words."""
    context = np.array([5 << 32, (5 << 32) + 1, 5 << 32, 5 << 32])
    shorter = np.array([77, 77, 77, 78])
    packed = suffix_tables._packed(*suffix_tables._summed([(context, shorter, np.full(4, 2))]), 12)
    found = [row for batch in suffix_tables._twice(packed) for row in zip(*(c.to_pylist() for c in batch.columns))]
    assert sorted(found) == [(5 << 32, 77, 4), (5 << 32, 78, 2), ((5 << 32) + 1, 77, 2)]
