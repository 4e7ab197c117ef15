"""The whole suffix tree of `suffix_tree`, in tables: whatever was seen twice, however rare."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import removed, shared_folder, written
from .common import Docs, replaced
from .suffix_tree import DEPTH, END_HASH, HELD, PORTION, _counts, held_out, word_hash, words_of

# No word has a line feed.
BEGIN_HASH = word_hash(b"\n\n")
# A sequence as a context has another key than as a context with its next token.
AS_CONTEXT = 0x5DEECE66D1234567
# What makes up one in 2^HEAD of the training tokens is looked up in every task, all else in the tables.
HEAD = 20
# A context seen less often is never worth its entries: of T - 1 next tokens seen R >= 2 * (T - 1) times after C <= 3
# occurrences there is one at most, and C times its divergence is below 2 * ln N, as nothing is less likely than 1 / N.
WORTH = 4
# Buckets of keys for each shuffle partition. Next tokens of one context lie in up to 16 places.
BUCKETS = 4
APART = np.int64(-2**60)
# Bits of a filter per key, and at most; a fuller one lets more pass, which changes no result.
BITS, MOST_BITS = 8, 2**28
CHUNK = 2**16
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = seed + P5 + np.uint64(8)
    k = x * P2
    h ^= ((k << np.uint64(31)) | (k >> np.uint64(33))) * P1
    h = ((h << np.uint64(27)) | (h >> np.uint64(37))) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for two bigints. A sequence of tokens is known by that of the sequence
    without its last token and of the one without its first."""
    first = _xxhash(a.view(np.uint64), np.full(len(a), 42, np.uint64))
    return _xxhash(b.view(np.uint64), first).view(np.int64)


@dataclass
class Filter:
    """A bit for each key, several keys a bit: says of every key that is there, and of some others, that it is."""

    shift: int
    bits: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> np.uint64(self.shift)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


PLACES = "chunk int, places binary, size int"


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of HELD or a little more."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > HELD:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def filter_of(keys: DataFrame) -> Filter:
    """A filter of the column `key`. Each task makes stretches of the bits; the driver holds MOST_BITS at most."""
    wanted = keys.count() * BITS
    size = CHUNK
    while size < min(wanted, MOST_BITS):
        size *= 2
    shift = 64 - int(math.log2(size))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(CHUNK, size >> 8)

    def places(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(shift)).astype(np.int64)
            cuts = np.flatnonzero(np.append(True, np.diff(at // width) > 0)) if len(at) else np.zeros(0, np.int64)
            yield from _rows([(int(at[a] // width), _small(at[a:b] % width), int(b - a)) for a, b in zip(cuts, np.append(cuts[1:], len(at)))], PLACES)

    def chunks(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in found:
            for row in batch.to_pylist():
                held.setdefault(row["chunk"], np.zeros(width, bool))[_unpacked(row["places"], row["size"])] = True
        for c, bits in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["chunk", "bits"])

    bits = np.zeros(size // 8, np.uint8)
    dealt = keys.select("key").mapInArrow(lambda found: places(_larger(found)), PLACES).repartition(parts, "chunk")
    made = dealt.mapInArrow(chunks, "chunk long, bits binary").toArrow()
    for c, some in zip(made.column("chunk").to_pylist(), made.column("bits")):
        bits[c * width // 8:(c + 1) * width // 8] = np.frombuffer(some.as_buffer(), np.uint8)
    return Filter(shift, bits)


def scored(docs: DataFrame, train: Column, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """What `suffix_tree.scored` gives, without its bound: the same tree with every word, context and next
    token that is there twice in training, whatever the size of the corpus. What is seen once
    counts for the words only: a context seen less than WORTH times is never worth its entries.

    Levels of the tree are tables: contexts and next tokens are counted, tested and looked up by shuffles and
    joins. The log10 of a token's probability is that of the token alone and, for each context of it that
    is kept, what the context adds: the share that it leaves to the shorter one and, for a token counted
    after it, the rest. So a text is the sum of the values of its keys: those of frequent keys are sent to every
    task; all others are asked for by packed arrays, dealt out with the values by hash, and the sums go back
    to the texts. Filters spare keys that are in no table. Null counts as empty;
    repeated rows, and rows without an id, are rows of their own; a table without rows gives none.
    """
    spark = docs.sparkSession
    coded = written(_coded(docs, F.coalesce(train.cast("boolean"), F.lit(False)), keep, text))
    blocks = coded.where("words is not null")
    training = blocks.where("train").select(*BLOCK)
    words = written(training.mapInArrow(_word_sums, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(2, -(-tokens >> HEAD))
    values = _values(training, words, tokens, distinct)
    rare = values.where(F.col("n") < least).drop("n")
    sent = spark.sparkContext.broadcast((_head(values.where(F.col("n") >= least)), filter_of(rare)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.select(*BLOCK).mapInArrow(lambda found: _asking(found, *sent.value, BUCKETS * parts), ASKED)
    # The place of a key among the buckets is that of its upper bits, as in `_buckets`.
    upper = F.shiftrightunsigned("key", 32)
    table = rare.select(F.shiftright(upper * F.lit(BUCKETS * parts), 32).cast("int").alias("bucket"), *rare.columns)
    partial = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_answered, ASKED)
    sums = partial.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(
        _gathered, "row long, base double, more double, known long")
    kept = [f"k{i}" for i in range(len(keep))]
    joined = coded.select("row", *kept, "n_tokens").join(sums, "row")
    base = F.col("base") - F.col("n_tokens") * math.log10(tokens + distinct + 1)
    return joined.select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)], "n_tokens", F.col("known").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (base + F.col("more")).alias("score"))


BLOCK = ("rows", "sizes", "ids", "words")


def _coded(docs: DataFrame, train: Column, keep: Sequence[str], text: str) -> DataFrame:
    """row, train, the columns kept (by position), n_tokens. Texts are coded in blocks, either to learn from or not; the
    first of a block has its rows, the numbers of words in each, the places of all these words among its
    different ones (packed), and the hashes of those. All others have null there."""
    names = Docs(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))], train.alias("__train")), keep[0] if keep else text, text)
    kept = [names.column(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = names.frame.select(F.monotonically_increasing_id().alias("row"), names.column("__train").alias("train"), *kept, "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in BLOCK]])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each word a number, and by that its hash.
        number, known = {}, np.zeros(0, np.int64)
        for batch in found:
            ids, train = batch.column("row").to_numpy(), batch.column("train").to_pylist()
            sizes, made = np.zeros(len(ids), np.int64), [{} for _ in ids]
            open_blocks = {True: ([], []), False: ([], [])}

            def close(block: tuple[list, list]) -> None:
                if block[0]:
                    spoken = np.concatenate(block[1])
                    there = np.zeros(len(known), bool)
                    there[spoken] = True
                    made[block[0][0]] = {
                        "rows": ids[block[0]].tobytes(), "sizes": sizes[block[0]].tobytes(), "words": known[there].tobytes(),
                        "ids": pa.compress((np.cumsum(there) - 1)[spoken].astype(np.int32).tobytes(), "zstd", asbytes=True)}
                    block[0].clear()
                    block[1].clear()

            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if len(number) > HELD:
                    for block in open_blocks.values():
                        close(block)
                    number, known = {}, known[:0]
                if new := set(words).difference(number):
                    if len(number) + len(new) > len(known):
                        known = np.resize(known, 2 * (len(number) + len(new)))
                    known[len(number):len(number) + len(new)] = np.fromiter(map(word_hash, new), np.int64, len(new))
                    number.update(zip(new, range(len(number), len(number) + len(new))))
                sizes[i] = len(words)
                block = open_blocks[train[i]]
                block[0].append(i)
                block[1].append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                if sizes[block[0]].sum() + len(block[0]) > PORTION:
                    close(block)
            for block in open_blocks.values():
                close(block)
            yield replaced(batch, ("text",), n_tokens=pa.array(sizes + 1), **{c: pa.array([m.get(c) for m in made], pa.binary()) for c in BLOCK})

    return rows.mapInArrow(batches, schema)


def _unblocked(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows, sizes, ids, words of a block."""
    rows, sizes, words = (np.frombuffer(block[c], np.int64) for c in ("rows", "sizes", "words"))
    n = int(sizes.sum())
    return rows, sizes, np.frombuffer(pa.decompress(block["ids"], 4 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32), words


def _word_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and ends of texts, each with how often it is there."""
    held, counts, ends = [], [], 0
    for batch in batches:
        for block in batch.to_pylist():
            _, sizes, ids, words = _unblocked(block)
            held.append(words)
            counts.append(np.bincount(ids, minlength=len(words)))
            ends += len(sizes)
            if sum(map(len, held)) > 3 * HELD:
                yield _counts(*_word_sum(held, counts))
                held, counts = [], []
    if ends:
        yield _counts(*_word_sum([*held, np.array([END_HASH])], [*counts, np.array([ends])]))


def _word_sum(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    words, counts = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(words)
    words = words[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    return words[first], np.add.reduceat(counts[order], first)


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places among sorted keys, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A block at a time: its rows; the hashes of their tokens, one text after the other, each from its
    beginning to its end; the place of each in its text; and its row among them."""
    for block in batch.to_pylist():
        ids, sizes, spoken, words = _unblocked(block)
        row = np.repeat(np.arange(len(sizes)), sizes + 2)
        place = np.arange(len(row)) - (np.cumsum(sizes + 2) - sizes - 2)[row]
        x = np.full(len(row), BEGIN_HASH)
        x[place > sizes[row]] = END_HASH
        x[(place > 0) & (place <= sizes[row])] = words[spoken]
        yield ids, x, place, row


def _longer(grams: np.ndarray) -> np.ndarray:
    """Of the sequences that end at each place those longer by a token; the first has none."""
    return np.append(0, paired(grams[:-1], grams[1:]))


PACKED = "bucket int, places int, mixed binary, runs binary, shorter binary, n binary"
# Keys that a block of texts asks for, and in which of its texts (`of`) and how often; or sums of some of its texts, and
# in a bucket below 0 the rows they have.
ASKED = "bucket int, block long, size int, keys binary, of binary, times binary, base binary, more binary, known binary"


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers of the buckets of keys, by their upper bits: keys in (unsigned) order have them in order."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], depth: int, contexts: Filter, known: Filter, buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts of `depth` tokens and next tokens, by the context and by the sequence without its first token, if
    the one may have been seen WORTH times and the other twice: packed, a row for each bucket."""
    held = []
    for batch in batches:
        for _, x, place, _ in _portions(batch):
            for _ in range(depth - 1):
                x = _longer(x)
            at = np.flatnonzero((place >= depth) & known.has(x))
            at = at[contexts.has(x[at - 1])]
            held.append(_summed([(x[at - 1], x[at], np.ones(len(at), np.int64))]))
            if sum(len(h[0]) for h in held) > 3 * HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD:
                    yield from _packed(*held.pop(), buckets)
    if held:
        yield from _packed(*_summed(held), buckets)


def _mixed(context: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Deals what a context has into 16 places. Done twice, it gives the context again."""
    return (context ^ (shorter & APART)).view(np.uint64)


def _summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each context and sequence once, by 64 bits of both; in the order of the buckets of `_mixed`, what
    belongs to a context together."""
    context, shorter, n = map(np.concatenate, zip(*held))
    if not len(context):
        return context, shorter, n
    key = _mixed(context, shorter) & np.uint64(0xFFFFFFFF00000000) | (context.view(np.uint64) * P1 + shorter.view(np.uint64) * P2) >> np.uint64(32)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return context[order[first]], shorter[order[first]], np.add.reduceat(n[order], first)


def _packed(context: np.ndarray, shorter: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    mixed = _mixed(context, shorter)
    of = _buckets(mixed, buckets)
    cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts, np.append(cuts[1:], len(of))):
        new = np.flatnonzero(np.append(True, mixed[a + 1:b] != mixed[a:b - 1]))
        # Of what lies together the place is there once.
        runs = np.diff(np.append(new, b - a))
        rows.append((int(of[a]), len(new), _steps(mixed[a:b][new]), _small(runs), shorter[a:b].tobytes(), _small(n[a:b])))
    yield from _rows(rows, PACKED)


def _rows(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        names, types = zip(*[c.split() for c in schema.split(", ")])
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=names)


def _small(numbers: np.ndarray) -> bytes:
    """Whole numbers, packed: first the lowest byte of each, then the next."""
    return pa.compress(np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(numbers: bytes, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(numbers, 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


def _steps(keys: np.ndarray) -> bytes:
    """Keys that are nearly in order, as the steps between them."""
    return _small(np.diff(keys.view(np.int64), prepend=np.int64(0)))


def _keys(steps: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpacked(steps, size))


def _twice(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what `_packed` has dealt out, one bucket after the other; what was seen once goes."""
    rows = (row for batch in found for row in batch.to_pylist())
    for _, bucket in groupby(rows, key=lambda row: row["bucket"]):
        held = []
        for row in bucket:
            shorter, runs = np.frombuffer(row["shorter"], np.int64), _unpacked(row["runs"], row["places"])
            mixed = np.repeat(_keys(row["mixed"], len(runs)), runs)
            held.append((_mixed(mixed, shorter).view(np.int64), shorter, _unpacked(row["n"], len(shorter))))
        context, shorter, n = _summed(held)
        there = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(c[there]) for c in (context, shorter, n)], names=["context", "shorter", "n"])


def _values(training: DataFrame, words: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """key, n, base, more, known: what a word adds to base_score (but for the total) and to n_known, and a kept context, or a token
    counted after it, to the score beyond."""
    spark, total = words.sparkSession, tokens + distinct + 1
    parts_of = int(spark.conf.get("spark.sql.shuffle.partitions"))
    room = shared_folder(spark)
    begin = words.where(F.col("key") == END_HASH).select(F.lit(BEGIN_HASH).alias("key"), "n")
    # Sequences seen twice, from single words on, and each without its first token.
    known = words.where("n > 1").unionByName(begin).select(
        "key", "n", ((F.col("n") + 1) / F.lit(float(total))).alias("chance"), F.lit(None).cast("bigint").alias("shorter"))
    levels, contexts = [], []
    for depth in range(1, DEPTH + 1):
        often = known.where(F.col("n") >= WORTH)
        sent = spark.sparkContext.broadcast((filter_of(often), filter_of(known)))
        found = training.mapInArrow(
            lambda b, depth=depth, sent=sent: _counted(b, depth, *sent.value, BUCKETS * parts_of), PACKED)
        dealt = found.repartition(parts_of, "bucket").sortWithinPartitions("bucket")
        counts = written(dealt.mapInArrow(_twice, "context long, shorter long, n long"), f"{room}/counts{depth}")
        parts = counts.groupBy("context").agg(F.sum("n").alias("seen"), (F.count("*") + 1).alias("parts"))
        parts = parts.join(often.select(F.col("key").alias("context"), F.col("n").alias("occurs"), F.col("shorter").alias("suffix")), "context")
        unit = 1 / (F.col("occurs") + F.col("parts"))
        parts = parts.withColumns({"unit": unit, "share": (F.col("occurs") - F.col("seen") + F.col("parts")) * unit})
        above = known.select(F.col("key").alias("shorter"), F.col("chance").alias("above"))
        chance = F.col("n") * F.col("unit") + F.col("share") * F.col("above")
        level = written(counts.join(above, "shorter").join(parts, "context").select(
            "context", "shorter", "n", "occurs", "parts", "suffix", "share", "above", chance.alias("chance")), f"{room}/level{depth}")
        removed(spark, f"{room}/counts{depth}")
        tested = level.groupBy("context").agg(
            *[F.first(c).alias(c) for c in ("occurs", "parts", "suffix", "share")],
            F.sum(F.col("chance") * F.log(F.col("chance") / F.col("above"))).alias("apart"), F.sum("chance").alias("mass"))
        apart = F.col("apart") + (1 - F.col("mass")) * F.log("share")
        worth = F.col("occurs") * apart >= F.col("parts") * math.log(max(tokens, 2))
        levels.append(level)
        contexts.append(written(tested.select("context", "occurs", "suffix", "share", worth.alias("worth")), f"{room}/contexts{depth}"))
        known = level.select(F.xxhash64("context", "shorter").alias("key"), "n", "chance", "shorter")
    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    out = words.select("key", "n", F.log10(F.col("n") + 1).alias("base"), zero.alias("more"), F.lit(1).cast("bigint").alias("known"))
    longer = None
    for level, context in zip(reversed(levels), reversed(contexts)):
        kept = context.where("worth").select("context")
        if longer is not None:
            kept = kept.unionByName(longer.select(F.col("suffix").alias("context"))).distinct()
        longer = written(context.join(kept, "context", "left_semi"))
        share = F.log10("share")
        gain = F.log10(F.col("chance") / F.col("above")) - share
        after = level.join(longer.select("context"), "context", "left_semi")
        out = out.unionByName(longer.select(
            F.col("context").bitwiseXOR(F.lit(AS_CONTEXT)).alias("key"), F.col("occurs").alias("n"), zero.alias("base"), share.alias("more"), none.alias("known")))
        out = out.unionByName(after.select(
            F.xxhash64("context", "shorter").alias("key"), "n", zero.alias("base"), gain.alias("more"), none.alias("known")))
    out = written(out)
    removed(spark, room)
    return out


@dataclass
class Head:
    """Frequent keys, sorted, with their values: of each level at most 2^HEAD contexts and as many next tokens."""

    keys: np.ndarray
    values: dict[str, np.ndarray]
    known: Filter


def _head(frequent: DataFrame) -> Head:
    table = frequent.drop("n").toArrow()
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    return Head(keys[order], {c: table.column(c).to_numpy()[order] for c in ("base", "more", "known")}, filter_of(frequent))


def _asking(batches: Iterator[pa.RecordBatch], head: Head, rare: Filter, buckets: int) -> Iterator[pa.RecordBatch]:
    """Per block of texts the sums of the values of their frequent keys, and their other keys with how often each text
    has them, but for those that the filter knows are in no table."""
    for batch in batches:
        for here, *portion in _portions(batch):
            sums, of, keys, times = _sums(*portion, head, rare)
            block = int(here[0])
            rows = [(-1 - block % buckets, block, len(here), None, here.tobytes(), None, *_sum_bytes(sums))]
            at = _buckets(keys, buckets)
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(at))):
                rows.append((int(at[a]), block, int(b - a), _steps(keys[a:b]), _small(of[a:b]), _small(times[a:b]), None, None, None))
            yield from _rows(rows, ASKED)


def _sum_bytes(sums: dict[str, np.ndarray]) -> list[bytes]:
    return [sums[c].astype(np.float64).tobytes() for c in ("base", "more", "known")]


def _answered(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Of the texts of each block the sums of the values that one bucket has for them."""
    keys = table.column("key").to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], {c: table.column(c).to_numpy()[order] for c in ("base", "more", "known")}
    rows = []
    for row in asked.to_pylist():
        if row["bucket"] < 0:
            rows.append(tuple(row.values()))
            continue
        wanted = _keys(row["keys"], row["size"])
        of, times = (_unpacked(row[c], len(wanted)) for c in ("of", "times"))
        at = _places(keys, wanted)
        of, times, at = of[at >= 0], times[at >= 0], at[at >= 0]
        there, of = np.unique(of, return_inverse=True)
        sums = {c: np.bincount(of, v[at] * times, len(there)) for c, v in values.items()}
        rows.append((row["bucket"], row["block"], len(there), None, _small(there), None, *_sum_bytes(sums)))
    made = list(_rows(rows, ASKED))
    return pa.Table.from_batches(made) if made else asked.slice(0, 0)


def _gathered(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sums of a block, always added in the order of the buckets."""
    rows = (row for batch in found for row in batch.to_pylist())
    for _, block in groupby(rows, key=lambda row: row["block"]):
        ids, sums = np.zeros(0, np.int64), {}
        for row in block:
            some = {c: np.frombuffer(row[c]) for c in ("base", "more", "known")}
            if row["bucket"] < 0:
                ids, sums = np.frombuffer(row["of"], np.int64), {c: v.copy() for c, v in some.items()}
            else:
                of = _unpacked(row["of"], row["size"])
                for c, v in some.items():
                    sums[c][of] += v
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (ids, sums["base"], sums["more"], sums["known"].astype(np.int64))], names=["row", "base", "more", "known"])


def _sums(x: np.ndarray, place: np.ndarray, row: np.ndarray, head: Head, rare: Filter) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    rows = int(row[-1]) + 1
    sums = {c: np.zeros(rows) for c in head.values}
    asked = []

    def look(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Adds up the values of keys at some places, or asks for them; the places whose keys may be in the tree."""
        maybe = np.flatnonzero(head.known.has(keys))
        found = np.full(len(keys), -1)
        found[maybe] = _places(head.keys, keys[maybe])
        there = found >= 0
        for c, values in head.values.items():
            sums[c] += np.bincount(row[at[there]], values[found[there]], rows)
        ask = ~there & rare.has(keys)
        asked.append((row[at[ask]], keys[ask]))
        return at[there | ask]

    at = np.flatnonzero(place > 0)
    look(at, x[at])
    # A context is kept only if the shorter one is; a token is counted after it only if it is after the shorter one.
    contexts = counted = at
    for depth in range(1, DEPTH + 1):
        contexts = look(contexts, x[contexts - 1] ^ np.int64(AS_CONTEXT))
        contexts = contexts[place[contexts] >= depth]
        x = _longer(x)
        under = np.zeros(len(x), bool)
        under[contexts] = True
        counted = counted[under[counted]]
        counted = look(counted, x[counted])
        contexts = contexts[place[contexts] > depth]
    of, keys = (np.concatenate(c) for c in zip(*asked))
    # By the key but for its lowest bits, then by the text: an order in which equal ones all but always lie together.
    bits = np.uint64(rows.bit_length())
    order = np.argsort(keys.view(np.uint64) >> bits << bits | of.view(np.uint64))
    of, keys = of[order], keys[order]
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1]))) if len(of) else np.zeros(0, np.int64)
    return sums, of[first], keys[first], np.diff(np.append(first, len(of)))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    found = scored(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
