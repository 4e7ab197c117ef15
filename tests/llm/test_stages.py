"""What the stages of the pipeline give for nulls, empty and long texts, repeated rows and odd columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i}" for i in range(5000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, token_ids string, lang_pred string, `a.b` string"
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", None, "a", 13), (3, "one two three", None, "a", 13),
    (None, "no id here", "en", None, 10), (4, LONG, "en", "b", len(LONG)), (5, "x\n" + LONG, "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "mine", "mine", "mine", "mine") for r in ROWS], SCHEMA).cache()


@pytest.mark.parametrize("stage", dict(corpus_pipeline.STAGES))
def test_empty_tables(spark, docs, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.where(F.lit(False)), "").count() == 0


def test_lines(spark, docs):
    done = corpus_pipeline.drop_repeated_lines(spark, docs, "")
    assert done.columns == docs.columns
    found = {(r["doc_id"], r["text"], r["n_chars"], r["copies"]) for r in done.collect()}
    assert done.count() == len(ROWS)
    assert (1, None, None, "mine") in found or (1, "", 0, "mine") in found
    assert (5, "x", 1, "mine") in found and (4, LONG, len(LONG), "mine") in found


def test_mix(spark, docs):
    done = corpus_pipeline.mix_sources(spark, docs, "")
    assert done.columns == docs.columns
    before = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in done.collect()} <= before


def test_tokens(spark, docs):
    done = corpus_pipeline.encode_tokens(spark, docs, "").collect()
    assert len(done) == len(ROWS)
    assert all(r["text_sha256"] == r["decoded_sha256"] and r["n_tokens"] == len(r["token_ids"]) for r in done)
    assert {r["n_tokens"] for r in done if r["doc_id"] in (1, 2)} == {0}
