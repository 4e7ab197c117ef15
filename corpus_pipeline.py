"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of `documents`. `run` writes each table before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagrid.llm import bpe, catalogue, language, line_dedup, mixing, near_copies, simhash
from pelagrid.llm.common import hex_sha256
from pelagrid.session import written

# A document is rejected if its language is known with less certainty than this.
LEAST_SCORE = 0.5
# A repeated passage of so many words goes, on however few lines.
LEAST_WORDS = 50


def _columns(docs: DataFrame) -> list[str]:
    return ["`" + name.replace("`", "``") + "`" for name in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go; the others get the
    language that was found. Without any label to learn from all documents with a letter stay.
    Null and empty texts have no letter; repeated rows are judged alike."""
    model = language.fit(docs, ~language.held_out())
    if model is None:
        return docs.where(language.has_letter(F.col("text")))
    found = language.identify(docs, model)
    sure = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.withColumn("lang", F.col("lang_pred")).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three lines, or of LEAST_WORDS words on whole lines, go; every
    document stays, n_chars follows its text. Null and empty texts have no lines and stay; rows
    that repeat id and text are one document and lose the same lines."""
    done = line_dedup.dedup_lines(docs, words=LEAST_WORDS)
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: 5-word shingles, Jaccard similarity of 0.8 or more; SimHash fingerprints
    in BK-trees find what is near, MinHash the rest, and each link is verified. Texts without
    a word, null and empty ones, are one group; so are repeated rows."""
    return simhash.one_of_each(docs, near=near_copies.near)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all. Null and empty texts
    have no size; repeated rows and rows without a source are drawn as others are."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a digest of what they decode to. A null or empty text has no ids;
    every row, repeated or not, gives one. Other columns go."""
    coded = bpe.round_trip(docs, catalogue.VOCABULARY, catalogue.PATTERN)
    return coded.select(
        "doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("bigint").alias("n_tokens"),
        hex_sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"), hex_sha256(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

# Training, sampling and BPE are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalogue.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
