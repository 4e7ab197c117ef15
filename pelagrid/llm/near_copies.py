"""Near copies by the Jaccard similarity of word shingles: candidates by SimHash and BK-trees, the rest by MinHash, each link verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import simhash
from .common import Docs
from .components import components
from .simhash import LOWER, rooted

SHINGLE = 5
# Texts are near copies at a Jaccard similarity of PART / OF or more.
PART, OF = 4, 5
# A pair at 0.8 misses all of BANDS bands of BAND_ROWS minima with a chance of (1 - 0.8^4)^24, or 3e-6.
BANDS, BAND_ROWS = 24, 4
# SimHash fingerprints of a set, independent of each other, and the bits in which two may differ. All that differ in
# simhash.RADIUS bits are found, of others those that have a quarter of their bits in common.
PRINTS, RADIUS = 4, 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)
FACTORS = np.random.default_rng(11).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The different shingles of a text, as sorted 64-bit hashes: A-Z in lower case,
    SHINGLE words each; of fewer words the whole sequence, without a word none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    rolled = np.full(n, size, np.uint64)
    for k in range(size):
        rolled = _mixed((rolled + hashes[k:k + n]) * FACTOR)
    return np.unique(rolled)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def bands(found: np.ndarray) -> np.ndarray:
    """A hash of each BAND_ROWS minima. Equal sets have equal ones."""
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 2048):
        least = np.minimum(least, _mixed(found[at:at + 2048, None] * FACTORS).min(0))
    out = np.zeros(BANDS, np.uint64)
    for minima in least.reshape(BANDS, BAND_ROWS).T:
        out = _mixed((out + minima) * FACTOR)
    return out


def prints(found: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints: a bit is set if it is in over half of the set's hashes, which are mixed anew for each."""
    out = np.zeros(PRINTS, np.uint64)
    for k in range(PRINTS if len(found) else 0):
        bits = np.unpackbits(_mixed(found * FACTORS[k]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Up to 255 ones fit a byte.
        set_ = np.add.reduceat(bits, range(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
        out[k] = (np.uint64(1) << np.flatnonzero(2 * set_ > len(found)).astype(np.uint64)).sum(dtype=np.uint64)
    return out


def node(found: np.ndarray) -> int:
    """A number of the set of shingles, the same for equal sets."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def sketched(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: kid, kt, id, fingerprint (the number of its set), bands, prints."""
    rows = Docs(docs, id, text).slim("id", "text")
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField("fingerprint", T.LongType()),
        *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("bands", "prints")]])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            sets = [shingles(x.as_py()) for x in batch.columns[-1]]
            nodes = pa.array([node(s) for s in sets], pa.int64())
            made = [pa.array([f(s).view(np.int64) for s in sets], pa.list_(pa.int64())) for f in (bands, prints)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], nodes, *made], names=[*batch.schema.names[:-1], "fingerprint", "bands", "prints"])

    return rows.mapInArrow(batches, schema)


def near(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of `simhash.near`, fingerprint being the number of the set of shingles.

    Texts link if the Jaccard similarity of their sets of shingles is PART / OF or
    more; texts without a word link to each other. Equal sets are one node, whatever
    the number of their documents. Nodes whose SimHash fingerprints link in BK-trees are verified first. What
    lies further apart is found by MinHash: nodes that share a band meet in a bucket. Buckets
    of one node, or of nodes joined already, end there, of buckets of the same nodes one stays, and in those left all pairs
    that are not joined yet are verified. Every link is verified on the shingles of the whole texts.
    """
    rows = written(sketched(docs, id, text))
    nodes = written(rows.groupBy("fingerprint").agg(
        F.min("id").alias("least"), F.min(F.struct("kid", "kt")).alias("place"), F.first("bands").alias("bands"), F.first("prints").alias("prints")))
    return rooted(rows, nodes, links(Docs(docs, id, text).slim("text"), nodes))


def links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): near copies among the nodes, as many as join up all that are joined."""
    close = written(by_fingerprint(texts, nodes))
    known = components(close).withColumnRenamed("node", "fingerprint")
    far = by_band(texts, nodes.join(known, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    return close.unionByName(far)


def by_fingerprint(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): near copies among nodes of which a fingerprint is the same or links in a shard's BK-tree.

    One node stands for all with a fingerprint: the others are compared with it, and it with those of the
    fingerprints linked. Fingerprints of all PRINTS kinds are searched as one: the kinds hardly ever meet, and
    each link is verified.
    """
    each = nodes.select("fingerprint", F.explode("prints").alias("print"))
    first = written(each.groupBy("print").agg(F.min("fingerprint").alias("first")))
    found = simhash.links(first.select(F.col("print").alias("fingerprint")), RADIUS)
    ends = [first.select(F.col("print").alias(c), F.col("first").alias(n)) for c, n in (("a", "one"), ("b", "other"))]
    across = found.join(ends[0], "a").join(ends[1], "b").select("one", "other")
    same = each.join(first, "print").select(F.col("first").alias("one"), F.col("fingerprint").alias("other"))
    pairs = across.unionByName(same).where("one <> other").select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other"))
    met = pairs.distinct().select(F.xxhash64("one", "other").alias("bucket"), F.explode(F.array("one", "other")).alias("fingerprint"))
    return verified(texts, met.join(nodes.select("fingerprint", "place", F.col("fingerprint").alias("root")), "fingerprint"))


def by_band(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): near copies among nodes that share a band, as many as join up each bucket; root says
    which nodes are joined already."""
    dealt = nodes.select("fingerprint", "place", "root", F.posexplode("bands").alias("band", "value")).select(
        F.xxhash64("band", "value").alias("bucket"), "fingerprint", "place", "root")
    met = dealt.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high"),
        F.bit_xor(F.xxhash64("fingerprint")).alias("mark"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    once = met.groupBy("n", "low", "high", "mark").agg(F.min("bucket").alias("bucket"))
    return verified(texts, dealt.join(once.select("bucket"), "bucket", "left_semi"))


def verified(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): near copies among the members (bucket, fingerprint, place, root) of each bucket."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = texts.join(members.select("bucket", "fingerprint", "root", "place.*"), ["kid", "kt"])
    asked = asked.select("bucket", "fingerprint", "root", "text").repartition(parts, "bucket")
    return asked.sortWithinPartitions("bucket", "fingerprint").mapInArrow(_linked, "a long, b long")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the sorted buckets of a task one by one, one at a time in memory."""
    held: dict[int, tuple[np.ndarray, int]] = {}
    key = None
    for batch in batches:
        for bucket, number, root, text in zip(*(c for c in batch.columns)):
            if bucket.as_py() != key:
                yield from _pairs_of(held)
                held, key = {}, bucket.as_py()
            if (number := number.as_py()) not in held:
                found = shingles(text.as_py())
                # Another text may share the key by which this one was looked up.
                if node(found) == number:
                    held[number] = found, root.as_py()
    yield from _pairs_of(held)


def _pairs_of(held: dict[int, tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    sets, roots = zip(*held.values()) if held else ((), ())
    pairs = joined(list(sets), list(roots))
    if pairs:
        nodes = np.array(list(held), np.int64)
        a, b = np.array(pairs).T
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])


def joined(sets: list[np.ndarray], roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Of all pairs of near copies, as positions, some that join up the same components. Sets
    of one root are joined already. Each set is compared with the later ones of other components, so a group that is
    joined already costs nothing."""
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets)) if roots is None else np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    pairs = []
    for i, one in enumerate(sets[:-1]):
        apart = i + 1 + np.flatnonzero(label[i + 1:] != label[i])
        fits = OF * np.minimum(sizes[apart], sizes[i]) >= PART * np.maximum(sizes[apart], sizes[i])
        others = apart[fits & (sizes[apart] > 0)]
        # In portions, for the memory of a bucket of many texts.
        for at in range(0, len(others), 1024):
            some = others[at:at + 1024]
            all_ = np.concatenate([sets[j] for j in some])
            hit = one[np.minimum(np.searchsorted(one, all_), len(one) - 1)] == all_
            both = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(sizes[some])[:-1]))
            alike = some[OF * both >= PART * (sizes[i] + sizes[some] - both)]
            # One link for each component met.
            new = alike[np.unique(label[alike], return_index=True)[1]]
            new = new[label[new] != label[i]]
            pairs += [(i, int(j)) for j in new]
            label[np.isin(label, label[new])] = label[i]
    return pairs
