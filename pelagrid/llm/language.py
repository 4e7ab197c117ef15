"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Docs

# Lengths of the n-grams, and into how many features they are hashed.
ORDERS = (1, 2, 3)
FEATURES = 1 << 15
# The model is fitted on about so many labelled documents, spread evenly over the
# languages; of each language on about so many at least, if there are.
SAMPLE = 3000
LEAST_ROWS = 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Of follow-the-regularised-leader: step size, elastic net, passes."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    passes: int = 4


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, by feature: those of feature f are at starts[f] to
    starts[f + 1], each with the number of its language; idf by feature; the
    temperature that the scores are calibrated with."""

    languages: list[str]
    starts: np.ndarray
    language: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        starts, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        found = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.bincount(
            self.language[found], self.weights[found] * np.repeat(x, lengths), minlength=len(self.languages))
        return sums + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        at, counts = grams(text)
        p = softmax(self.logits(at, tfidf(at, counts, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    all_ = np.zeros(FEATURES, np.int64)
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    hashed = np.zeros(len(points), np.uint32)
    for order in ORDERS:
        if len(points) < order:
            break
        hashed = (hashed[:len(points) - order + 1] ^ points[order - 1:]) * np.uint32(0x9E3779B1)
        hashed ^= hashed >> np.uint32(15)
        all_ += np.bincount((hashed * np.uint32(0x85EBCA77)) >> shift, minlength=FEATURES)
    at = np.flatnonzero(all_)
    return at, all_[at]


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a document's features, of length one."""
    x = (1.0 + np.log(counts)) * idf[at]
    length = np.sqrt(x @ x)
    return x / length if length else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(docs: DataFrame, usable: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the rows that are `usable` and have a language and a letter;
    None if there are none.

    The idf counts all of those rows, task by task, FEATURES sums in the end. Every
    language is learned. The weights come from a sample, drawn by a hash of id and text,
    of SAMPLE rows in expectation, alike for every language, or LEAST_ROWS a language
    if those are more, and never over twice that. A fifth of it is held back to
    set the temperature. While it learns the driver holds 16 * FEATURES bytes a language.
    """
    table = Docs(docs.where(usable), id, text)
    rows = table.slim("text", table.column(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    total = sum(sizes.values())

    found = rows.select("text").mapInPandas(_document_counts, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    having = np.zeros(FEATURES)
    for r in found.collect():
        having[r["feature"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + having)) + 1.0

    chance = F.pmod(F.xxhash64("kid", "kt", F.lit("sample")), F.lit(2**30)) / F.lit(2.0**30)
    each = max(SAMPLE / len(languages), LEAST_ROWS)
    limits = docs.sparkSession.createDataFrame(
        [(name, min(1.0, each / n)) for name, n in sizes.items()], "lang string, limit double")
    sample = rows.withColumn("chance", chance).join(F.broadcast(limits), "lang").where(F.col("chance") < F.col("limit"))
    # A bound for the driver's memory even if ids and texts repeat without end.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "kid", "kt"))
    sample = sample.withColumn("rank", rank).where(F.col("rank") <= int(2 * each))
    taken = sample.select("lang", "chance", "text").mapInPandas(
        _features, "lang string, chance double, features binary, counts binary").toPandas()
    taken = taken.sort_values(["chance", "features", "lang"]).reset_index(drop=True)
    number = {name: i for i, name in enumerate(languages)}
    examples = [
        (np.frombuffer(f, np.int32), np.frombuffer(c, np.int32), number[name])
        for f, c, name in zip(taken["features"], taken["counts"], taken["lang"])]
    return trained(examples, languages, idf)


def trained(examples: list, languages: list[str], idf: np.ndarray, settings: Settings = Settings()) -> Model:
    """FTRL-proximal over the examples (features, counts, language), in an order of
    its own each pass, then the temperature from every fifth of them."""
    prepared = [(at, tfidf(at, counts, idf), y) for at, counts, y in examples]
    fifth = len(prepared) >= 5
    known = {e[2] for i, e in enumerate(prepared) if i % 5 or not fifth}
    # What would leave a language without any example is not held back.
    held = [e for e in prepared[::5] if e[2] in known] if fifth else []
    seen = [e for i, e in enumerate(prepared) if i % 5 or not fifth or e[2] not in known]
    shape = (FEATURES + 1, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    s, draw = settings, np.random.default_rng(7)
    for _ in range(s.passes):
        for i in draw.permutation(len(seen)):
            at, x, y = seen[i]
            # The last row is the bias, which is not pulled to zero by l1.
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = _weights(z[at], n[at], s)
            slope = softmax(x @ w)
            slope[y] -= 1.0
            g = x[:, None] * slope
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    bias = _weights(z[FEATURES:], n[FEATURES:], Settings(s.alpha, s.beta, 0.0, s.l2))[0]
    counts, language, weights = [], [], []
    for at in range(0, FEATURES, 1024):
        w = _weights(z[at:min(at + 1024, FEATURES)], n[at:min(at + 1024, FEATURES)], s).astype(np.float32)
        counts.append(np.count_nonzero(w, axis=1))
        language.append(np.nonzero(w)[1].astype(np.int32))
        weights.append(w[w != 0])
    model = Model(
        languages, np.append(0, np.cumsum(np.concatenate(counts))), np.concatenate(language), np.concatenate(weights), bias, idf, 1.0)
    if not held:
        return model
    logits = np.array([model.logits(at, x) for at, x, _ in held])
    right = np.array([y for _, _, y in held])
    steps = np.exp(np.linspace(np.log(0.25), np.log(20), 121))
    return replace(model, temperature=float(min(steps, key=lambda t: _loss(logits / t, right))))


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    pulled = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0.0)
    return -pulled / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def _loss(logits: np.ndarray, right: np.ndarray) -> float:
    shifted = logits - logits.max(1, keepdims=True)
    return float((np.log(np.exp(shifted).sum(1)) - shifted[np.arange(len(right)), right]).mean())


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many of a task's texts each feature occurs."""
    total = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for text in batch["text"]:
            total[grams(text)[0]] += 1
    at = np.flatnonzero(total)
    yield pd.DataFrame({"feature": at.astype(np.int32), "n": total[at]})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        both = [grams(text) for text in batch["text"]]
        yield pd.DataFrame({
            "lang": batch["lang"], "chance": batch["chance"],
            "features": [at.astype(np.int32).tobytes() for at, _ in both],
            "counts": [np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes() for _, counts in both]})


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The columns of `docs`, and lang_pred and score of the whole text.

    lang_pred is one of the model's languages, and score its calibrated probability;
    of equal probabilities the first language counts. Where the text is null or has
    no letter, or there is no model, lang_pred is "und" and score 0. Nothing but the
    text is looked at. Columns of the caller's of the new names are replaced.
    """
    at = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    readable = F.when(has_letter(F.col(f"c{at}")), F.col(f"c{at}"))
    asked = plain.withColumn("readable", readable)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in plain.schema.fields)}, lang_pred string, score double"

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [model.predict(t) if model and (t := x.as_py()) is not None else (UNKNOWN, 0.0) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    done = asked.mapInArrow(predicted, schema)
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n not in ("lang_pred", "score")]
    return done.select(*kept, "lang_pred", "score")


def held_out(id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))), F.lit(4)) == 2


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs, ~held_out()))
    return found.drop("text")
