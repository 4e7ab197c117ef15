"""Quality rules with thresholds from quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import Docs, small

WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# The sketch: values fall into buckets whose bounds grow by this factor, so that a
# quantile is right to one part in a hundred. Counts of buckets add up, in any order.
GROWTH = 1.02
ZERO = -1_000_000
# A group's sketch is added to so many documents spread as those of its language, and
# a language's to as many spread as all: the fewer a group has, the more it borrows.
PRIOR = 100
UNIT = 1 << 20
# A value is out if it lies beyond the outer deciles by more than REACH times their
# distance from the median, so up to a tenth of a group may be bad without moving its bounds.
REACH = 3.0
# Each value is a count by a number of words or lines, and out only if it is surely so: by more
# than SURE times the square root of the count. What counts together, as the words of a
# window and of its repeat do, is one event of CLUMP.
SURE = 3.0
SHARES = {
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}
MEAN = "word_length"
RATIOS = {MEAN: ("word_chars", "n_words"), **SHARES}
CLUMP = {"repeat_share": 2 * WINDOW}
TENTHS = {"q1": 1, "q5": 5, "q9": 9}


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of `docs`: kid, kt, id, lang, source, the counts of COUNTS, n_lines.

    n_words      words, runs of anything but six ASCII white-space characters
    word_chars   code points in words
    n_symbols    characters of SYMBOLS
    n_dup_lines  lines with a word, equal to an earlier line of the text
    n_repeat_words  words in windows of WINDOW words found twice or more in the text
    n_lines      lines with a word
    Null counts as empty: all are 0.
    """
    table = Docs(docs, id, text)
    rows = table.slim(
        "id", table.column(lang).cast("string").alias("lang"), table.column(source).cast("string").alias("source"), "text")
    names = [*COUNTS, "n_lines"]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in names]])

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            counts = np.array([counted(x.as_py()) for x in batch.columns[-1]], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *[pa.array(c) for c in counts.T]], names=[*batch.schema.names[:-1], *names])

    return rows.mapInArrow(batches, schema)


def counted(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, WHITE))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    return len(words), word_chars, n_symbols, n_dup, repeated(words), n_lines


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window found twice or more. Windows get exact numbers: a
    pair of equal numbers of two halves is a pair of equal halves."""
    if len(words) <= WINDOW:
        return 0
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(numbers) == len(words):
        return 0
    one = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    base = len(words) + 1
    two = np.unique(one[:-1] * base + one[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * base + two[2:], return_inverse=True)[1]
    five, counts = np.unique(four[:-1] * base + one[4:], return_inverse=True, return_counts=True)[1:]
    twice = np.flatnonzero(counts[five] > 1)
    if not len(twice):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judged(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of `docs` its counts, base_failed, the shares and their bounds, kept.

    base_failed: fewer than 10 words, or over 20% of them in repeated windows. All
    other rows are sketched: for each language and source, null being one of its
    own, each share has the counts of its buckets, which merge into those of the
    language and of all. Every bound comes from the deciles of a group's own sketch, smoothed by
    the merged ones; none is a constant, and the rule is the same for groups of all sizes.
    A row is kept unless base_failed, its words are surely longer or shorter
    than the bounds, or a share is surely over its bound. An empty table gives no rows; repeated rows all count.
    """
    rows = written(measured(docs, id, text, lang, source).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    rows = rows.withColumns({n: F.when(F.col("n_words") > 0, F.col(a) / F.col(b)) for n, (a, b) in RATIOS.items()})
    limits = bounds(sketched(rows.where(~F.col("base_failed"))))
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    found = rows.join(small(limits.withColumnsRenamed({"lang": "l", "source": "s"})), same, "left").drop("l", "s")
    inside = F.lit(True)
    for name, (count, of) in RATIOS.items():
        chance = SURE * F.sqrt(F.lit(float(CLUMP.get(name, 1))) * F.col(count))
        inside &= F.coalesce(F.col(count) - chance <= F.col(f"{name}_high") * F.col(of), F.lit(True))
        if name == MEAN:
            inside &= F.coalesce(F.col(count) + chance >= F.col(f"{name}_low") * F.col(of), F.lit(True))
    return found.withColumn("kept", ~F.col("base_failed") & inside)


def sketched(rows: DataFrame) -> DataFrame:
    """The sketches, as rows lang, source, share, bucket, n: a bucket b holds values
    up to GROWTH to the power b, and over GROWTH to the power b - 1."""
    each = rows.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(n).alias("share"), F.col(n).alias("value")) for n in RATIOS])).alias("x"))
    bucket = F.when(F.col("x.value") > 0, F.ceil(F.log("x.value") / F.lit(float(np.log(GROWTH))))).otherwise(ZERO)
    return each.groupBy("lang", "source", F.col("x.share").alias("share"), bucket.cast("int").alias("bucket")).agg(
        F.count("*").alias("n"))


def smoothed(sketch: DataFrame, keys: list[str], parent: DataFrame | None = None) -> DataFrame:
    """The sketches merged by `keys`, in UNITs of a document and with PRIOR documents spread as in
    the parent, which is keyed by the first of the keys, or by none: keys, share, bucket, w, and part, the
    portion of the group's documents. All are whole numbers, so sums do not depend on the order."""
    own = sketch.groupBy(*keys, "share", "bucket").agg((F.sum("n") * UNIT).alias("w"))
    if parent is not None:
        shared = keys[:-1]
        above = small(parent.drop("w").withColumnsRenamed({k: f"of_{k}" for k in [*shared, "share"]}))
        same = F.col("share") == F.col("of_share")
        for k in shared:
            same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
        lent = own.select(*keys, "share").distinct().join(above, same).select(
            *keys, "share", "bucket", F.floor(F.lit(float(PRIOR * UNIT)) * F.col("part")).alias("w"))
        own = own.unionByName(lent).groupBy(*keys, "share", "bucket").agg(F.sum("w").alias("w"))
    return own.withColumn("part", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "share")))


def deciles(merged: DataFrame, *of: str) -> DataFrame:
    """The deciles TENTHS of each share in merged sketches. A window holds the buckets of
    one group: some thousand, as a share lies between 1e-10 and 1e10."""
    group = Window.partitionBy(*of, "share")
    ranked = merged.withColumns({"upto": F.sum("w").over(group.orderBy("bucket")), "total": F.sum("w").over(group)})
    value = F.when(F.col("bucket") == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")))
    return ranked.groupBy(*of, "share").agg(*[
        F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), value)).alias(name) for name, tenths in TENTHS.items()])


def bounds(sketch: DataFrame) -> DataFrame:
    """Per language and source, a row with the bounds NAME_low and NAME_high of each share."""
    sketch = written(sketch)
    by_lang = smoothed(sketch, ["lang"], smoothed(sketch, []))
    found = deciles(smoothed(sketch, ["lang", "source"], by_lang), "lang", "source")
    # A decile is the upper end of its bucket; the lower one is a GROWTH below.
    ends = {"low": F.col("q1") / GROWTH - REACH * (F.col("q5") - F.col("q1")), "high": F.col("q9") + REACH * (F.col("q9") - F.col("q5"))}
    return found.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("share") == n, c)).alias(f"{n}_{end}") for n in RATIOS for end, c in ends.items()])


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept."""
    return judged(docs).select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    shares = "\n    UNION ALL ".join(
        f"SELECT lang, source, '{n}' AS share, {n} AS value FROM fine WHERE NOT base_failed" for n in RATIOS)

    def smooth(keys: str, name: str, parent: str, same: str) -> str:
        return f"""{name} AS (SELECT *, w / sum(w) OVER (PARTITION BY {keys}, share) AS part FROM (
    SELECT {keys}, share, bucket, sum(w)::BIGINT AS w FROM (
      SELECT {keys}, share, bucket, n * {UNIT} AS w FROM sketch
      UNION ALL SELECT {', '.join('g.' + k for k in keys.split(', '))}, g.share, p.bucket, floor({PRIOR * UNIT}::DOUBLE * p.part)::BIGINT
        FROM (SELECT DISTINCT {keys}, share FROM sketch) g JOIN {parent} p ON g.share = p.share{same}) GROUP BY ALL))"""

    tenths = ", ".join(f"min(CASE WHEN 10 * upto >= {t} * total THEN v END) AS {q}" for q, t in TENTHS.items())

    def end(name: str, which: str) -> str:
        return (f"(SELECT max({which}) FROM b WHERE b.share = '{name}' AND b.lang IS NOT DISTINCT FROM f.lang"
                " AND b.source IS NOT DISTINCT FROM f.source)")

    def chance(name: str) -> str:
        return f"{SURE}::DOUBLE * sqrt({float(CLUMP.get(name, 1))}::DOUBLE * {RATIOS[name][0]})"

    inside = " AND ".join([
        f"coalesce(word_chars + {chance(MEAN)} >= {end(MEAN, 'low')} * n_words, true)",
        *[f"coalesce({c} - {chance(n)} <= {end(n, 'high')} * {of}, true)" for n, (c, of) in RATIOS.items()]])
    return f"""
WITH texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
listed AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM texts),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM listed),
windows AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c,
    lead(word, 3) OVER d AS e, lead(word, 4) OVER d AS f FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM windows WHERE f IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c, e, f) > 1),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
full_lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(lines) AS line FROM listed)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
line_counts AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY doc_id),
raw AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, n_lines
  FROM listed LEFT JOIN line_counts USING (doc_id) LEFT JOIN again USING (doc_id)),
fine AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    word_chars / nullif(n_words, 0) AS word_length, n_symbols / nullif(n_words, 0) AS symbol_share,
    n_dup_lines / nullif(n_lines, 0) AS dup_line_share, n_repeat_words / nullif(n_words, 0) AS repeat_share FROM raw),
sketch AS (SELECT lang, source, share,
    CASE WHEN value > 0 THEN ceil(ln(value) / {float(np.log(GROWTH))!r}::DOUBLE)::INTEGER ELSE {ZERO} END AS bucket, count(*) AS n
  FROM ({shares}) GROUP BY ALL),
whole AS (SELECT share, bucket, w / sum(w) OVER (PARTITION BY share) AS part
  FROM (SELECT share, bucket, (sum(n) * {UNIT})::BIGINT AS w FROM sketch GROUP BY ALL)),
{smooth('lang', 'by_lang', 'whole', '')},
{smooth('lang, source', 'own', 'by_lang', ' AND g.lang IS NOT DISTINCT FROM p.lang')},
deciles AS (SELECT lang, source, share, {tenths}
  FROM (SELECT *, CASE WHEN bucket = {ZERO} THEN 0 ELSE pow({GROWTH}::DOUBLE, bucket) END AS v,
          sum(w) OVER (PARTITION BY lang, source, share ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, share) AS total
        FROM own) GROUP BY ALL),
b AS (SELECT lang, source, share, q1 / {GROWTH}::DOUBLE - {REACH} * (q5 - q1) AS low, q9 + {REACH} * (q9 - q5) AS high FROM deciles)
SELECT doc_id, {', '.join(COUNTS)}, base_failed, NOT base_failed AND {inside} AS kept FROM fine f"""


ORACLE_SQL = _oracle()
