"""SimHash near-dedup: fingerprints linked by BK-trees over shards of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import Docs, small
from .components import components

SHINGLE = 3
RADIUS = 3
HASH_SEED = 42
# A shard of more fingerprints than this is split, so often at most.
MOST, LEVELS = 4096, 3
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: kid, kt, id, fingerprint (bigint, its bits unsigned).

    A-Z in lower case; words; shingles of SHINGLE words, repeats included, joined by a
    space, of fewer words the whole sequence. A bit is set if it is in over half of
    the shingles' XXH64. Null counts as empty; without a word all bits are 0.
    """
    rows = Docs(docs, id, text).slim("id", "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fingerprint", T.LongType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            prints = np.array([fingerprint(x.as_py()) for x in batch.columns[-1]], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "fingerprint"])

    return rows.mapInArrow(batches, schema)


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends)), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ += bits.sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * set_ > n).astype(np.uint64)).sum(dtype=np.uint64))


def near(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: kid, kt, id, fingerprint, and component_id, the least id that
    links lead to, its own included; null where none of them has an id.

    Fingerprints link at RADIUS or fewer differing bits; equal ones always do.
    Each different fingerprint is one node, whatever the number of its documents.
    Fingerprints are dealt out to shards by a quarter of their bits, of which any two that link share one, and
    each shard is searched by a BK-tree. The links of a shard are cut down to
    a tree of each component before they leave it; the rest is `components`.
    Rows that repeat an id are documents of their own. An empty table gives no rows.
    """
    rows = written(fingerprints(docs, id, text))
    nodes = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")))
    return rooted(rows, nodes, links(nodes.select("fingerprint")))


def rooted(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`rows` with the root and the component_id of their fingerprints; nodes has
    each fingerprint and the least id behind it."""
    linked = components(links)
    found = nodes.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    found = found.withColumn("root", F.coalesce("root", "fingerprint"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(least, "root").select("fingerprint", "root", "component_id")
    return rows.join(known, "fingerprint").select("kid", "kt", "id", "fingerprint", "root", "component_id")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of different fingerprints at RADIUS or fewer differing bits, as
    many as join up what is joined at all: each shard is searched by its own BK-tree. With a wider
    radius also those up to it that are in one shard."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shards(nodes).repartition(parts, "table", "value")
    return dealt.sortWithinPartitions("table", "value", "fingerprint").mapInArrow(lambda b: _linked(b, radius), "a long, b long")


def shards(nodes: DataFrame) -> DataFrame:
    """table, value, fingerprint: two fingerprints that link are in one shard (table, value).

    Of RADIUS + 1 parts of the bits one is equal in both: a shard is such a part with its
    value. One of more than MOST fingerprints is split by the same rule for the bits
    that are left, again and again while there are enough of them; so a tree is no longer than MOST,
    but for fingerprints that are all alike in most of their bits.
    """
    every = list(range(64))
    tables = {0: []}
    state = nodes.select(F.lit(0).alias("table"), "fingerprint")
    done = None
    for level in range(LEVELS):
        children: dict[int, list[tuple[int, list[int]]]] = {}
        for table, fixed in tables.items():
            rest = [b for b in every if b not in fixed]
            step = len(rest) // (RADIUS + 1)
            children[table] = [
                (table * (RADIUS + 1) + k + 1, fixed + rest[k * step:(k + 1) * step]) for k in range(RADIUS + 1)]
        tables = dict(c for found in children.values() for c in found)
        keys = F.lit(None)
        for table, found in children.items():
            keys = F.when(F.col("table") == table, F.array(*[F.struct(
                F.lit(t).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(_mask(bits))).alias("value"))
                for t, bits in found])).otherwise(keys)
        dealt = state.select("fingerprint", F.explode(keys).alias("shard")).select("shard.table", "shard.value", "fingerprint")
        large = written(dealt.groupBy("table", "value").agg(F.count("*").alias("n")).where(F.col("n") > MOST).drop("n"))
        last = level == LEVELS - 1 or large.isEmpty()
        fits = dealt if last else dealt.join(small(large), ["table", "value"], "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if last:
            return done
        state = dealt.join(small(large), ["table", "value"], "left_semi").select("table", "fingerprint")
    return done


def _mask(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _linked(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Goes through the sorted shards of a task one by one, one at a time in memory."""
    held: list[np.ndarray] = []
    key = None
    for batch in batches:
        table, value, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = np.flatnonzero((table[1:] != table[:-1]) | (value[1:] != value[:-1])) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)]):
            if at == end:
                continue
            if (table[at], value[at]) != key:
                yield from _tree_of(held, radius)
                held, key = [], (table[at], value[at])
            held.append(prints[at:end])
    yield from _tree_of(held, radius)


def _tree_of(held: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    if sum(map(len, held)) > 1:
        shard = np.concatenate(held)
        pairs = joined(shard.view(np.uint64), radius)
        if pairs:
            a, b = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(shard[a]), pa.array(shard[b])], names=["a", "b"])


class Tree:
    """A BK-tree of fingerprints: one at each node, its children keyed by their distance to it. What
    lies within the radius of a query hangs on edges within the radius of the query's own distance."""

    def __init__(self, prints: np.ndarray, at: np.ndarray):
        self.followed = 0
        open_ = [(self, at)]
        while open_:
            tree, at = open_.pop()
            tree.at, tree.children, rest = at[0], {}, at[1:]
            apart = np.bitwise_count(prints[rest] ^ prints[at[0]])
            for distance in set(apart.tolist()):
                tree.children[distance] = child = Tree.__new__(Tree)
                open_.append((child, rest[apart == distance]))

    def search(self, prints: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, found) within the radius, in portions; `followed` counts the edges gone along."""
        open_ = [(self, queries)]
        while open_:
            tree, some = open_.pop()
            apart = np.bitwise_count(prints[some] ^ prints[tree.at]).astype(int)
            hit = some[apart <= radius]
            if len(hit):
                yield hit, np.full(len(hit), tree.at)
            for distance, child in tree.children.items():
                near_ = some[np.abs(apart - distance) <= radius]
                if len(near_):
                    self.followed += 1
                    open_.append((child, near_))


def joined(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Of all pairs within the radius, as positions, those that first join two components."""
    tree = Tree(prints, np.arange(len(prints)))
    parent = np.arange(len(prints))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = []
    # Queries go in portions, so that a portion's pairs stay few.
    for at in range(0, len(prints), 1024):
        for query, found in tree.search(prints, np.arange(at, min(at + 1024, len(prints))), radius):
            while not np.array_equal(parent, again := parent[parent]):
                parent[:] = again
            apart = np.flatnonzero(parent[query] != parent[found])
            label = parent[query[apart]] * len(prints) + parent[found[apart]]
            for i in apart[np.unique(label, return_index=True)[1]].tolist():
                a, b = top(int(query[i])), top(int(found[i]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    pairs.append((int(query[i]), int(found[i])))
    return pairs


def one_of_each(
    docs: DataFrame, id: str = "doc_id", text: str = "text", near: Callable[..., DataFrame] = near,
) -> DataFrame:
    """The columns of `docs`, of each component of `near` one row: the one with the least id,
    null last; of rows that repeat that id, or have none, the one with the least fingerprint
    and hash of its text."""
    table = Docs(docs, id, text)
    found = near(docs, id, text)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "fingerprint", "kid", "kt")
    chosen = found.groupBy("root").agg(F.min(rank).alias("r")).select(
        F.col("r.kid").alias("kid"), F.col("r.kt").alias("kt"))
    kept = table.frame.join(chosen.distinct(), ["kid", "kt"], "left_semi")
    return table.restored(kept.dropDuplicates(["kid", "kt"]))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    return near(docs).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
