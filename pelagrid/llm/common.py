"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but these six characters: fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"
# A side of a join is broadcast up to so many rows; beyond, both sides are shuffled.
BROADCAST_ROWS = 10_000


class Docs:
    """A table of documents with its columns renamed by position, so that no column
    of the caller's, whatever its name, can clash with one of an operator's.

    frame has c0, c1, ... and besides
      id    the document id as bigint, null kept
      text  the text, null as empty
      kid, kt  the key. kid is the id, or a 64-bit hash of the text where the id is null; kt is
        another hash of the text, of 63 bits, whose lowest bit says that the id is null.
    Rows that repeat both id and text share a key and get the same result. Others do not: without
    an id 127 bits of hash tell texts apart, and no id can be taken for null.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text"):
        self.names = docs.columns
        plain = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.frame = plain.select(
            "*",
            self.column(id).cast("bigint").alias("id"),
            F.coalesce(self.column(text).cast("string"), F.lit("")).alias("text"),
        ).withColumns({
            "kid": F.coalesce(F.col("id"), F.xxhash64("text")),
            "kt": F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("id").isNull().cast("bigint")),
        })

    def column(self, name: str) -> Column:
        if name not in self.names:
            raise KeyError(f"no column {name!r} among {self.names}")
        return F.col(f"c{self.names.index(name)}")

    def slim(self, *columns: str | Column) -> DataFrame:
        return self.frame.select("kid", "kt", *columns)

    def restored(self, frame: DataFrame, **new: Column) -> DataFrame:
        """Under the caller's names again; `new` replaces columns or adds them."""
        old = [new.pop(n, F.col(f"c{i}")).alias(n) for i, n in enumerate(self.names)]
        return frame.select(*old, *[c.alias(n) for n, c in new.items()])


def has_id() -> Column:
    """Whether the row of a key has an id: false, which comes first, for a null one."""
    return F.col("kt").bitwiseAND(F.lit(1)) == 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has no more than so many rows; else as it is."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def replaced(batch: pa.RecordBatch, drop: tuple[str, ...], **new: pa.Array) -> pa.RecordBatch:
    """The batch without the columns in `drop` and with the new ones at its end."""
    names = [n for n in batch.schema.names if n not in drop]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*arrays, *new.values()], names=[*names, *new])


def hex_sha256(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as lowercase hex."""
    return F.sha2(text.cast("binary"), 256)
