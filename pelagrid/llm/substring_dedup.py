"""Substring dedup: repeated windows of words go, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Docs, has_id, hex_sha256

WINDOW = 35
# A difference cover: every number modulo PERIOD is a difference of two of COVER. So
# of any two equal windows some place lies at a position in COVER in both.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
# Words that are compared with each other before anything is shuffled.
BLOCK_WORDS = 4_000_000
ODD = 0x9E3779B97F4A7C15

_FOUND = "block long, ids binary, texts binary, runs binary, places binary"
_PACKED = f"bucket int, known boolean, {_FOUND}, hashes binary"


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the words that lie in a window found more than once.

    A window is `window` consecutive words of one document; it is found again if
    equal words, unchanged, start anywhere else, in the same document or another one.
    All windows are judged on the input, so every copy goes, the first one included.

    Difference cover: only at positions in COVER modulo PERIOD a shorter window, the
    anchor, is hashed. It is so short that any two equal windows share one at an aligned
    position. Anchors found once end there. Around the others the match is extended:
    the windows that hold one are hashed with 96 bits, and those found twice go.

    Hashes are compared within blocks first, so that a passage repeated in many
    documents is shuffled once a block; then they are dealt out by hash, as packed arrays. What was
    found comes back by block, and from there by document. Nothing is formed that pairs
    places with each other.

    Returns the columns of `docs`, the text replaced by the words that stay joined by
    one space (null stays null), and n_words, n_removed, which replace columns of the
    caller's of those names. Null and empty texts have no words. Rows that repeat
    id and text are documents of their own, so windows of theirs repeat. An empty
    table stays empty.
    """
    if window < PERIOD + 1:
        raise ValueError(f"the window must be longer than {PERIOD} words")
    table = Docs(docs, id, text)
    texts = table.slim("text")
    keys = _keys(docs.sparkSession)
    anchors = texts.mapInArrow(_anchors(window - PERIOD + 1, keys), _PACKED)
    likely = _gathered(_twice(anchors, 4, len(keys)), len(keys))
    asked = texts.join(likely, ["kid", "kt"])
    windows = asked.mapInArrow(_windows(window, keys), _PACKED)
    found = _gathered(_twice(windows, 12, len(keys)), len(keys))
    # The same exchange of the texts serves both joins.
    judged = texts.join(found, ["kid", "kt"], "left")
    left = judged.mapInArrow(_removed(window), "kid long, kt long, left string, n_words long, n_removed long")
    if table.names == [id, text]:
        return left.select(
            F.when(has_id(), F.col("kid")).alias(id), F.col("left").alias(text), "n_words", "n_removed")
    once = left.dropDuplicates(["kid", "kt"])
    joined = table.frame.drop("text").join(once, ["kid", "kt"])
    return table.restored(joined, **{
        text: F.when(table.column(text).isNotNull(), F.col("left")),
        "n_words": F.col("n_words"), "n_removed": F.col("n_removed")})


def _keys(spark: SparkSession) -> list[int]:
    """For each shuffle partition a number that is dealt to it, so that one bucket of
    hashes goes to each."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys: dict[int, int] = {}
    start, step = 0, 32 * parts
    while len(keys) < parts:
        key = F.col("id").cast("int")
        dealt = spark.range(start, start + step).groupBy(F.pmod(F.hash(key), F.lit(parts)).alias("part")).agg(F.min(key).alias("key"))
        keys = {r["part"]: r["key"] for r in dealt.collect()} | keys
        start += step
    return [keys[part] for part in range(parts)]


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolled(h: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of every `length` consecutive words, by doubling: the hash of 2n words
    is that of n words times a power of `factor`, and that of the next n."""
    out, have = None, 0
    part, width, power = h, 1, factor % 2**64
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, have = part, width
                else:
                    n = len(h) - have - width + 1
                    out = out[:n] * np.uint64(power) + part[have:have + n]
                    have += width
            rest >>= 1
            if rest:
                part = part[:len(part) - width] * np.uint64(power) + part[width:]
                width, power = 2 * width, power * power % 2**64
    return out


class Block:
    """Hashes of some documents with their places, until there are enough of them."""

    def __init__(self, width: int, keys: list[int]):
        self.width, self.keys, self.buckets = width, keys, len(keys)
        self.clear()

    def clear(self) -> None:
        self.ids, self.texts, self.counts, self.places, self.hashes, self.more = [], [], [], [], [], []
        self.size = 0

    def add(self, kid: int, kt: int, places: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> None:
        """hashes deal out and compare; more are further bits to compare."""
        if len(places):
            self.ids.append(kid)
            self.texts.append(kt)
            self.counts.append(len(places))
            self.places.append(places.astype(np.int32))
            self.hashes.append(hashes)
            self.more.append(more)
            self.size += len(places)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """Packed rows: places known to repeat within the block, and for the other
        blocks each hash once, by bucket. Empties the block."""
        if not self.size:
            return
        ids, texts = np.array(self.ids, np.int64), np.array(self.texts, np.int64)
        # What is found comes back together by this number; rows do not rely on it.
        block = xxhash.xxh3_64_intdigest(ids.tobytes() + texts.tobytes()) >> 1
        doc = np.repeat(np.arange(len(ids)), self.counts)
        places, h, more = map(np.concatenate, (self.places, self.hashes, self.more))
        self.clear()
        order = np.lexsort((more, h)) if self.width > 4 else np.argsort(h, kind="stable")
        hs, ms = h[order], more[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ms[1:] != ms[:-1])
        alone = new & np.append(new[1:], True)
        known, first = np.sort(order[~alone]), order[new]
        rows = [_pack(-1, True, block, ids, texts, doc, places, known, b"")]
        bucket = (h[first] % np.uint64(self.buckets)).astype(np.int32)
        by = np.lexsort((first, bucket))
        first, bucket = first[by], bucket[by]
        ends = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in range(self.buckets):
            if ends[b + 1] > ends[b]:
                part = first[ends[b]:ends[b + 1]]
                rows.append(_pack(self.keys[b], False, block, ids, texts, doc, places, part, _key_bytes(h[part], more[part], self.width)))
        yield pa.RecordBatch.from_pylist([r for r in rows if r["places"]], schema=_schema())


FOUND_SCHEMA = pa.schema([("block", pa.int64()), *[(n, pa.binary()) for n in ("ids", "texts", "runs", "places")]])


def _schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *FOUND_SCHEMA, ("hashes", pa.binary())])


def _key_bytes(h: np.ndarray, more: np.ndarray, width: int) -> bytes:
    high = (h >> np.uint64(32)).astype("<u4")
    return high.tobytes() if width == 4 else high.tobytes() + more.astype("<u8").tobytes()


def _pack(bucket: int, known: bool, block: int, ids, texts, doc, places, at, hashes: bytes) -> dict:
    """Places in document order, the documents themselves by runs."""
    docs = doc[at]
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(at) else np.empty(0, int)
    runs = np.diff(np.append(starts, len(at))).astype(np.int32)
    return {"bucket": bucket, "known": known, "block": block, "ids": ids[docs[starts]].tobytes(), "texts": texts[docs[starts]].tobytes(),
            "runs": runs.tobytes(), "places": places[at].tobytes(), "hashes": hashes}


def _collect(keys: list[int], width: int, of_text: Callable) -> Callable:
    """A map over (kid, kt, text, ...) whose `of_text` gives places, hashes, more."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(width, keys)
        for batch in found:
            rest = [c for c in batch.columns[3:]]
            for i, (kid, kt) in enumerate(zip(batch.columns[0].to_pylist(), batch.columns[1].to_pylist())):
                block.add(kid, kt, *of_text(_words(batch.columns[2][i].as_py()), *[c[i] for c in rest]))
                if block.size >= BLOCK_WORDS:
                    yield from block.batches()
        yield from block.batches()

    return batches


def _anchors(length: int, keys: list[int]) -> Callable:
    buckets = len(keys)

    def of_text(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(words) - length + 1
        if n <= 0:
            return (np.empty(0, np.int32),) * 3
        every = np.arange(0, n, PERIOD)
        places = np.sort((every[:, None] + np.array(COVER)).ravel())
        places = places[places < n]
        h = _mixed(_rolled(_hashed(words), length, ODD)[places])
        # 32 bits besides the bucket's: anchors only say where to look.
        h = (h & np.uint64(0xFFFFFFFF00000000)) | (h & np.uint64(0x00000000FFFFFFFF)) % np.uint64(buckets)
        return places, h, np.zeros(n and len(places), np.uint64)

    return _collect(keys, 4, of_text)


def _windows(window: int, keys: list[int]) -> Callable:
    reach, buckets = PERIOD - 1, len(keys)

    def of_text(words: list[bytes], spots: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(words) - window + 1
        at = np.unique(np.concatenate([np.frombuffer(b, np.int32) for b in spots.as_py()]))
        if n <= 0:
            return (np.empty(0, np.int32),) * 3
        # Every window that holds an anchor: it starts up to `reach` words before.
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, np.maximum(at - reach, 0), 1)
        np.add.at(edges, at + 1, -1)
        places = np.flatnonzero(np.cumsum(edges)[:n] > 0)
        h = _hashed(words)
        one, two = _rolled(h, window, ODD), _rolled(_mixed(h), window, 0xC2B2AE3D27D4EB4F)
        h = _mixed(one[places])
        h = (h & np.uint64(0xFFFFFFFF00000000)) | (h & np.uint64(0x00000000FFFFFFFF)) % np.uint64(buckets)
        return places, h, two[places]

    return _collect(keys, 12, of_text)


def _twice(packed: DataFrame, width: int, parts: int) -> DataFrame:
    """Of the packed rows the places that are found more than once."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in found:
            for row in batch.to_pylist():
                if row["known"]:
                    yield from _chosen(row, np.ones(len(row["places"]) // 4, bool))
                else:
                    held.setdefault(row["bucket"], []).append(row)
        for bucket in list(held):
            rows = held.pop(bucket)
            sizes = [len(r["places"]) // 4 for r in rows]
            high = np.concatenate([np.frombuffer(r["hashes"], "<u4", n) for r, n in zip(rows, sizes)])
            if width > 4:
                low = np.concatenate([np.frombuffer(r["hashes"], "<u8", n, 4 * n) for r, n in zip(rows, sizes)])
                order = np.lexsort((low, high))
                same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
            else:
                order = np.argsort(high, kind="stable")
                same = high[order][1:] == high[order][:-1]
            again = np.zeros(len(high), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            start = 0
            for row, n in zip(rows, sizes):
                yield from _chosen(row, again[start:start + n])
                start += n

    dealt = packed.repartition(parts, F.when(F.col("known"), F.hash("ids", "places")).otherwise(F.col("bucket")))
    return dealt.mapInArrow(batches, _FOUND)


def _chosen(row: dict, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The packed row with the chosen places only; nothing if there are none."""
    if chosen.any():
        runs = np.frombuffer(row["runs"], np.int32)
        left = np.add.reduceat(chosen, np.cumsum(runs) - runs, dtype=np.int32)
        some = left > 0
        yield pa.RecordBatch.from_pylist([{
            "block": row["block"],
            "ids": np.frombuffer(row["ids"], np.int64)[some].tobytes(),
            "texts": np.frombuffer(row["texts"], np.int64)[some].tobytes(),
            "runs": left[some].tobytes(),
            "places": np.frombuffer(row["places"], np.int32)[chosen].tobytes()}], schema=FOUND_SCHEMA)


def _gathered(found: DataFrame, parts: int) -> DataFrame:
    """A row (kid, kt, spots) per key. Rows that repeat a key have the same places, which count
    once: its arrays are together no longer than the document."""
    by_block = found.repartition(parts, "block").sortWithinPartitions("block")
    rows = by_block.mapInArrow(_merged, "kid long, kt long, places binary")
    return rows.groupBy("kid", "kt").agg(F.collect_set("places").alias("spots"))


def _merged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed rows of one block after the other, as a row per document."""
    rows = (row for batch in found for row in batch.to_pylist())
    for _, block in groupby(rows, key=itemgetter("block")):
        held = list(block)

        def all_of(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(r[name] for r in held), kind)

        ids, texts, runs, places = (
            all_of(n, k) for n, k in (("ids", np.int64), ("texts", np.int64), ("runs", np.int32), ("places", np.int32)))
        order = np.lexsort((texts, ids))
        ids, texts, first, runs = ids[order], texts[order], (np.cumsum(runs) - runs)[order], runs[order]
        ends = np.cumsum(runs)
        places = places[np.arange(ends[-1]) + np.repeat(first - (ends - runs), runs)]
        new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])))
        cuts = np.append((ends - runs)[new], ends[-1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[new]), pa.array(texts[new]),
             pa.array([np.unique(places[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
            names=["kid", "kt", "places"])


def _removed(window: int) -> Callable:
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            left, counts = [], []
            for text, spots in zip(batch.columns[2], batch.columns[3].to_pylist()):
                words = _words(text.as_py())
                stay = words
                if spots:
                    at = np.concatenate([np.frombuffer(b, np.int32) for b in spots])
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    stay = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) <= 0)]
                left.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
                counts.append((len(words), len(words) - len(stay)))
            n = np.array(counts, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(left, pa.string()), pa.array(n[:, 0]), pa.array(n[:, 1])],
                names=["kid", "kt", "left", "n_words", "n_removed"])

    return batches


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup_substrings(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", hex_sha256(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM documents),
windows AS (
  SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS w
  FROM words),
hashed AS (SELECT doc_id, i, md5(array_to_string(w, ' ')) AS h FROM windows WHERE len(w) = {WINDOW}),
twice AS (SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, range(0, {WINDOW}) AS r(k)),
marked AS (SELECT w.doc_id, w.i, w.word, g.i IS NULL AS stays FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE NOT stays) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE stays) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)"""
