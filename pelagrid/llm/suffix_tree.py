"""Language-model scoring by a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import Docs, replaced

# Contexts reach back so many tokens.
DEPTH = 3
# A word, a context with its next token: in the tree if it is at least one in 2^SHARE of the
# training tokens, and there at least twice. So no level of the tree has more than 2^SHARE
# entries, whatever the corpus, and tree and frequent words can be sent to every task.
SHARE = 20
# Numbers of tokens: any other, the end of a text, its beginning, and the frequent words from there on.
RARE, END, BEGIN, FIRST = 0, 1, 2, 3
WIDTH = np.int64(SHARE + 1)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Tokens at a time, of one text or of several.
PORTION = 1_000_000
# Different words or contexts that a task counts before it hands the counts on.
HELD = 1_000_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


# No word has a line feed.
END_HASH = word_hash(b"\n")


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case; split() parts at the six characters of the contract."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


@dataclass
class Level:
    """Contexts of one length with their next tokens, those of one context together.

    keys     number of the context, then of the next token; sorted
    counts   occurrences in training
    parents  place of the same next token after the context less its first token, one level up
    kept, shares, units  per context: in the tree; what its parent's distribution weighs in its own,
             and what one occurrence does
    """

    keys: np.ndarray
    counts: np.ndarray
    parents: np.ndarray | None = None
    kept: np.ndarray | None = None
    shares: np.ndarray | None = None
    units: np.ndarray | None = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Model:
    """A suffix tree: its frequent words and levels, at most 2^SHARE entries each, and the table
    (word, n) of all training words by their 64-bit hash, which stays in the shared folder.

    tokens, distinct  training tokens N and different ones V, ends of texts included
    hashes, numbers   the frequent words, sorted by hash; numbers is the count by token number
    """

    words: DataFrame
    tokens: int
    distinct: int
    hashes: np.ndarray
    numbers: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def total(self) -> int:
        return self.tokens + self.distinct + 1

    @property
    def least(self) -> int:
        return max(2, -(-self.tokens >> SHARE))

    def plain(self) -> Model:
        """What tasks need."""
        return Model(None, self.tokens, self.distinct, self.hashes, self.numbers, self.levels)


def scored(docs: DataFrame, train: Column, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """`fit` on the rows where `train` holds, and `score` of all rows."""
    model, coded = _fitted(docs, train, keep, text)
    return _scored(coded, model, keep)


def fit(docs: DataFrame, train: Column, text: str = "text") -> Model:
    """The tree learned from the rows where `train` holds; a null there counts as false.

    Tokens are the words of the lower-cased text (A-Z) and one end; null counts as empty. Words are counted by
    64-bit hash, all of them. A context is up to DEPTH tokens before another one, the beginning
    of the text included; counted are contexts and next tokens whose parts are frequent enough
    (SHARE), level by level. A context s with T - 1 counted next tokens, R occurrences of these and C in all
    gives a token the probability (c(s, w) + (C - R + T) * P(w | s less its first token)) / (C + T), and no context
    gives (c(w) + 1) / (N + V + 1), with one part for all words that are not known: each sums
    to one. A context is retained if C times its divergence (Kullback-Leibler) from the context one
    shorter is at least T * ln N, and so is every suffix of it. Repeated rows count as often as
    they are there. Without a training row all words are unknown, with probability one.
    """
    return _fitted(docs, train, (), text)[0]


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row of `docs`: the columns `keep`, n_tokens, n_known, train_tokens, base_score, score.

    Each token has its probability from the longest suffix of what comes before it that the
    tree has; score is the sum of their log10, base_score the one without any context. Repeated rows, and
    rows without an id, are rows of their own; an empty text is its end alone; a table without rows gives none.
    """
    return _scored(_coded(docs, F.lit(False), keep, text, model), model, keep)


def _fitted(docs: DataFrame, train: Column, keep: Sequence[str], text: str) -> tuple[Model, DataFrame]:
    spark = docs.sparkSession
    chosen = F.coalesce(train.cast("boolean"), F.lit(False))
    counted = docs.where(chosen).select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    words = written(counted.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    model = Model(words, tokens, distinct, np.zeros(0, np.int64), np.zeros(0, np.int64))
    hashes, counts = _columns(words.where((F.col("n") >= model.least) & (F.col("key") != END_HASH)))
    texts = words.where(F.col("key") == END_HASH).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model.hashes, model.numbers = hashes, np.concatenate([[0, texts, texts], counts]).astype(np.int64)
    coded = written(_coded(docs, chosen, keep, text, model))
    training = coded.where("train").select("ids")
    for _ in range(DEPTH):
        sent = spark.sparkContext.broadcast(model.plain())
        found = training.mapInArrow(lambda b, sent=sent: _level_counts(b, sent.value), "key long, n long")
        keys, counts = _columns(found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= model.least))
        model.levels.append(Level(keys, counts))
    _grow(model)
    return model, coded


def _columns(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by key, sorted, in the driver: at most 2^SHARE of them, since each stands for
    that share of the training tokens."""
    table = found.toArrow()
    keys, counts = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, ends = Counter(), 0
    for batch in batches:
        for text in batch.column("text"):
            held.update(words_of(text.as_py()))
            ends += 1
            if len(held) > HELD:
                yield _counts(np.fromiter(map(word_hash, held), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held)))
                held = Counter()
    yield _counts(np.fromiter(map(word_hash, held), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held)))
    if ends:
        yield _counts(np.array([END_HASH]), np.array([ends]))


def _counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def _coded(docs: DataFrame, train: Column, keep: Sequence[str], text: str, model: Model) -> DataFrame:
    """row, train, the columns kept (by position), n_tokens, ids (numbers of the tokens,
    packed), rare (hashes of the words that are not frequent) and times."""
    names = Docs(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*keep, text))], train.alias("__train")), keep[0] if keep else text, text)
    kept = [names.column(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = names.frame.select(F.monotonically_increasing_id().alias("row"), names.column("__train").alias("train"), *kept, "text")
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())
    schema = T.StructType([
        *rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = sent.value.hashes, {}
        for batch in found:
            sizes, packed, rare, times = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if len(number) > HELD:
                    number = {}
                new = list({w for w in words if w not in number})
                if new:
                    hashed = np.fromiter(map(word_hash, new), np.int64, len(new))
                    at = np.minimum(np.searchsorted(hashes, hashed), max(len(hashes) - 1, 0))
                    known = hashes[at] == hashed if len(hashes) else np.zeros(len(new), bool)
                    number.update(zip(new, np.where(known, at + FIRST, RARE).tolist()))
                ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                others = Counter(words[i] for i in np.flatnonzero(ids == RARE).tolist())
                sizes.append(len(words) + 1)
                packed.append(pa.compress(ids.tobytes(), "zstd", asbytes=True))
                rare.append([word_hash(w) for w in others])
                times.append(list(others.values()))
            yield replaced(batch, ("text",), n_tokens=pa.array(sizes, pa.int64()), ids=pa.array(packed, pa.binary()),
                           rare=pa.array(rare, pa.list_(pa.int64())), times=pa.array(times, pa.list_(pa.int32())))

    return rows.mapInArrow(batches, schema)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Some rows of a batch at a time: which, their tokens one text after the other, each from
    its beginning to its end, and where each text begins."""
    rows, held, size = [], [], 0
    for i, packed in enumerate(batch.column("ids")):
        data = packed.as_buffer()
        ids = np.frombuffer(pa.decompress(data, _length(data), "zstd", asbytes=True), np.int32)
        rows.append(i)
        held += [(BEGIN,), ids, (END,)]
        size += len(ids) + 2
        if size > PORTION:
            yield _joined(rows, held)
            rows, held, size = [], [], 0
    if rows:
        yield _joined(rows, held)


def _length(data: pa.Buffer) -> int:
    """Bytes of what is packed, as the frame's header states them."""
    import zstandard

    return zstandard.frame_content_size(data.to_pybytes()[:18])


def _joined(rows: list[int], held: list) -> tuple[list[int], np.ndarray, np.ndarray]:
    x = np.concatenate(held).astype(np.int64)
    return rows, x, np.flatnonzero(x == BEGIN)


def _places(x: np.ndarray, model: Model) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per level: the context before each token (its number one level up, -1 for none), and
    the place of that context and token (-1 for none)."""
    before = np.where((x == RARE) | (x == END), -1, x)
    contexts, places = [], []
    for level in [*model.levels, None]:
        context = np.append(-1, before[:-1])
        context[x == BEGIN] = -1
        contexts.append(context)
        if level is None:
            return contexts, places
        place = np.full(len(x), -1)
        at = np.flatnonzero((context >= 0) & (x != RARE))
        place[at] = level.find((context[at] << WIDTH) | x[at])
        places.append(place)
        before = np.where(x == END, -1, place)


def _level_counts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Counts of the level below the last one: a context and next token of which both the context and
    the pair without the first token are frequent."""
    held = []
    for batch in batches:
        for _, x, _ in _portions(batch):
            contexts, places = _places(x, model)
            wanted = (contexts[-1] >= 0) & (x != RARE)
            if places:
                wanted &= places[-1] >= 0
            keys, n = np.unique((contexts[-1][wanted] << WIDTH) | x[wanted], return_counts=True)
            held.append((keys, n))
            if sum(len(k) for k, _ in held) > 2 * HELD:
                held = [_summed(held)]
                if len(held[0][0]) > HELD:
                    yield _counts(*held.pop())
    if held:
        yield _counts(*_summed(held))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _grow(model: Model) -> None:
    """The divergence tests, from short contexts to long ones, and their suffixes kept from long to short."""
    of_context = model.numbers
    suffixes: list[np.ndarray | None] = []
    likely = (model.numbers + 1) / model.total
    for depth, level in enumerate(model.levels):
        context, token = level.keys >> WIDTH, level.keys & ((1 << WIDTH) - 1)
        if depth == 0:
            suffixes.append(None)
            above = likely[token]
        else:
            # What the context is without its first token, one level up.
            upper = model.levels[depth - 1]
            suffix = upper.keys & ((1 << WIDTH) - 1) if depth == 1 else upper.parents
            suffixes.append(suffix)
            level.parents = upper.find((suffix[context] << WIDTH) | token)
            above = chance[level.parents]
        n = len(of_context)
        seen = np.bincount(context, level.counts, n)
        parts = np.bincount(context, minlength=n) + 1
        level.units = 1 / (of_context + parts)
        level.shares = (of_context - seen + parts) * level.units
        chance = level.counts * level.units[context] + level.shares[context] * above
        apart = np.bincount(context, chance * np.log(chance / above), n) + (1 - np.bincount(context, chance, n)) * np.log(level.shares)
        level.kept = (of_context * apart >= parts * math.log(max(model.tokens, 2))) & (parts > 1)
        of_context = level.counts
    for depth in range(len(model.levels) - 1, 0, -1):
        suffix = suffixes[depth]
        model.levels[depth - 1].kept[suffix[model.levels[depth].kept]] = True


def chances(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token without and with its context. Those of rare words lack
    the factor of the word itself, which is not known here."""
    base = (model.numbers[x] + 1) / model.total
    base[x == RARE] = 1
    found = base.copy()
    for level, context, place in zip(model.levels, *_places(x, model)):
        at = np.flatnonzero(context >= 0)
        at = at[level.kept[context[at]]]
        counts = np.zeros(len(at), np.int64)
        there = place[at] >= 0
        counts[there] = level.counts[place[at][there]]
        found[at] = counts * level.units[context[at]] + level.shares[context[at]] * found[at]
    base[x == BEGIN] = found[x == BEGIN] = 1
    return base, found


def _scored(coded: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    spark = coded.sparkSession
    sent = spark.sparkContext.broadcast(model.plain())
    kept = [f"k{i}" for i in range(len(keep))]
    rows = coded.select("row", *kept, "n_tokens", "ids")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("found", T.DoubleType())])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in found:
            known, base, score = [], [], []
            for _, x, begins in _portions(batch):
                plain, better = chances(x, model)
                known.append(np.add.reduceat((model.numbers[x] > 0) & (x != BEGIN), begins, dtype=np.int64))
                base.append(np.add.reduceat(np.log10(plain), begins))
                score.append(np.add.reduceat(np.log10(better), begins))
            if known:
                yield replaced(batch, ("ids",), known=pa.array(np.concatenate(known)),
                               base=pa.array(np.concatenate(base)), found=pa.array(np.concatenate(score)))

    texts = rows.mapInArrow(batches, schema)
    # Rare words have their counts from the table; exact sums do not depend on the order of rows.
    asked = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("key"), "w.times")
    n = F.coalesce("n", F.lit(0))
    each = (F.log10((n + 1) / F.lit(float(model.total))) * F.col("times")).cast("decimal(28,14)")
    rare = asked.join(model.words, "key", "left").groupBy("row").agg(
        F.sum(each).cast("double").alias("more"), F.sum(F.when(n > 0, F.col("times").cast("bigint")).otherwise(0)).alias("known_more"))
    joined = texts.join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)], "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("found") + more).alias("score"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    found = scored(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
