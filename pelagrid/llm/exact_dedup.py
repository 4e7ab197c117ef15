"""Exact dedup by recipes of content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import Docs, hex_sha256, replaced

# A chunk ends where a hash of the last WINDOW bytes has ZERO_BITS zero bits, LEAST
# bytes after the last end at the earliest and MOST bytes at the latest.
WINDOW, LEAST, MOST, ZERO_BITS = 16, 256, 8192, 10


def dedup_exact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its group of equal texts, and whether it is the one that stays.

    Texts are equal if identical; null counts as empty. Of equal texts the row with
    the largest id stays. Null ids come after all others; rows that repeat the id
    that stays are all `kept`, and so are all rows of a group without any id.

    Each text is cut into content-defined chunks, and its recipe is the ordered list
    of their 64-bit identifiers. A dictionary of the distinct chunks, combined
    before it is shuffled, verifies that an identifier stands for one content; a text
    that holds one with two contents has its SHA-256 compared as well. Documents are
    grouped by recipe: a text moves once, as chunks, and only where no other row of
    its task has them. Groups are counted by partial sums, and a hot one is split by
    the skew join, whose other side has one row a group.

    Returns a row per row of `docs`: the id under its name, keep_id, group_size,
    kept, text_sha256. Other columns are not read. An empty table gives no rows.
    """
    table = Docs(docs, id, text)
    recipes = written(
        chunked(table.slim("id", hex_sha256(F.col("text")).alias("sha"), "text"))
        .withColumn("recipe", F.transform("chunks", lambda c: F.xxhash64(c))).drop("chunks"))

    contents = chunked(table.frame.select("text")).select(F.explode("chunks").alias("content"))
    dictionary = contents.select(F.xxhash64("content").alias("chunk"), "content").distinct()
    doubtful = dictionary.groupBy("chunk").count().where("count > 1").select("chunk")
    holders = recipes.select("kid", "kt", F.explode("recipe").alias("chunk")).join(
        doubtful, "chunk", "left_semi").select("kid", "kt").distinct().withColumn("doubt", F.lit(True))
    verified = recipes.join(holders, ["kid", "kt"], "left").withColumn(
        "exact", F.when(F.col("doubt"), F.col("sha")).otherwise(""))

    groups = verified.groupBy("recipe", "exact").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return verified.join(groups, ["recipe", "exact"]).select(
        F.col("id").alias(id), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def chunked(frame: DataFrame) -> DataFrame:
    """The frame with its `text` replaced by `chunks`, an array of binaries that
    make up the text in UTF-8; empty texts have none."""
    kept = [f for f in frame.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("chunks", T.ArrayType(T.BinaryType()))])
    return frame.mapInArrow(_chunk_batches, schema)


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield replaced(batch, ("text",), chunks=_chunks(texts))


def _chunks(texts: pa.StringArray) -> pa.ListArray:
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    text_bytes = np.frombuffer(data or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    marks = np.flatnonzero(_rolling(text_bytes) >> np.uint32(32 - ZERO_BITS) == 0) + 1
    ends, counts = [0], [0]
    for start, stop, low, high in zip(
            at[:-1].tolist(), at[1:].tolist(), np.searchsorted(marks, at[:-1]), np.searchsorted(marks, at[1:])):
        last, before = start, len(ends)
        for mark in [*marks[low:high].tolist(), stop]:
            while mark - last > MOST:
                last += MOST
                ends.append(last)
            if mark - last >= LEAST or mark == stop > last:
                last = mark
                ends.append(last)
        counts.append(len(ends) - before)
    pieces = pa.BinaryArray.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(text_bytes)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pieces)


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a 32-bit hash of the WINDOW bytes that end there. Chunks are
    longer than the window, so a cut never depends on the text before it."""
    spread = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
    out, factor, width = spread[data], 0x01000193, 1
    while width < WINDOW:
        out[width:] += out[:-width] * np.uint32(factor)
        factor, width = factor * factor % 2**32, 2 * width
    return out * np.uint32(0x85EBCA6B)


ORACLE_SQL = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM hashed WINDOW g AS (PARTITION BY t)"""
