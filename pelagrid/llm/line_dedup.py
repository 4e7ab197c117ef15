"""Line dedup: later copies of runs of lines go. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, Docs, has_id, hex_sha256, let

RUN = 3
GRAM = 2
# So many words are a run on fewer lines, too.
LONG = 50


def dedup_lines(
    docs: DataFrame, run: int = RUN, gram: int = GRAM, id: str = "doc_id", text: str = "text", words: int | None = None,
) -> DataFrame:
    """The documents without the lines of later repeated runs.

    A run is `run` or more consecutive lines of one document, lines without a word
    not counted; with `words`, fewer lines of so many words in all are one too. Of equal runs the first one, by document id and then by place,
    stays; the lines of every later one go. Lines compare exactly. A text in which
    nothing repeats is returned as it is, to the byte.

    Winnowing: each `gram` of consecutive lines has a hash; of every window of
    run - gram + 1 hashes the least (leftmost of ties) is a fingerprint, so equal
    runs share one at the same place. Fingerprints found once in the corpus end
    there. Around the others a match is extended to both sides, to all runs of
    `run` lines over the place, and a run is deleted where an equal one comes earlier.
    Longer repeats are unions of such runs. A run of fewer lines is its own fingerprint. No pairs are formed: each place meets
    only the first place of its group.

    Null or empty texts have no lines and stay as they are; null ids come first.
    Rows that repeat id and text count as one document. An empty table stays empty.
    Returns the columns of `docs`, the text replaced, and `n_lines`, `n_removed`
    (lines with a word); a column of the caller's with such a name is replaced.
    """
    if not 1 <= gram <= run:
        raise ValueError(f"need 1 <= gram <= run, got {gram}, {run}")
    table = Docs(docs, id, text)
    runs = written(table.slim(F.explode(_runs(F.col("text"), run, gram, words)).alias("r")).select("kid", "kt", "r.*"))
    place = F.struct(has_id().alias("has"), "kid", "kt", "mark")
    repeated = runs.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
    likely = runs.join(repeated.select("print"), "print", "left_semi")
    here = F.struct(has_id().alias("has"), "kid", "kt", "start")
    first = likely.groupBy("one", "two", "count").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last")
    later = likely.join(first, ["one", "two", "count"]).where(here > F.col("first"))
    gone = later.groupBy("kid", "kt").agg(F.collect_set(F.struct("start", "count")).alias("starts"))

    joined = table.frame.join(gone, ["kid", "kt"], "left")
    left = let(F.struct(F.split("text", "\n").alias("lines"), F.col("starts").alias("starts")), _left)
    done = joined.withColumn("left", left)
    return table.restored(
        done,
        **{text: F.when(F.col("starts").isNull(), table.column(text)).otherwise(F.col("left.text")),
           "n_lines": F.col("left.n_lines").cast("bigint"), "n_removed": F.col("left.n_removed").cast("bigint")})


def _runs(text: Column, run: int, gram: int, words: int | None) -> Column:
    """Every `run` consecutive lines with a word: `start` (number of its first line
    among those), `count` of lines, two hashes of the whole, and its fingerprint: the
    least hash of its grams and the number of the line that one starts at. Besides, all
    fewer lines of `words` or more words in all, their fingerprint a hash of the whole."""
    lines = F.transform(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        lambda x: F.struct(
            F.xxhash64(x).alias("one"), F.xxhash64(F.lit(1), x).alias("two"),
            *([F.regexp_count(x, F.lit(WORD)).alias("words")] if words else [])))

    def whole(x: Column, at: Column, count: int, name: str) -> Column:
        return F.xxhash64(*[x[at + k][name] for k in range(count)])

    def with_grams(x: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(x) - gram), lambda i: whole(x, i, gram, "one"))
        return let(F.struct(x.alias("lines"), grams.alias("grams")), at_each_start)

    def at_each_start(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x["lines"]) - run), lambda s: let(
            F.array_min(F.array(*[
                F.struct(x["grams"][s + k].alias("hash"), (s + k).alias("at")) for k in range(run - gram + 1)])),
            lambda least: F.struct(
                s.alias("start"), F.lit(run).alias("count"), least["hash"].alias("print"), least["at"].alias("mark"),
                whole(x["lines"], s, run, "one").alias("one"), whole(x["lines"], s, run, "two").alias("two"))))

    def of_words(x: Column, count: int) -> Column:
        """Nulls where `count` lines have too few words."""
        return F.when(F.size(x) >= count, F.transform(F.sequence(F.lit(0), F.size(x) - count), lambda s: F.when(
            sum((x[s + k]["words"] for k in range(1, count)), x[s]["words"]) >= words,
            F.struct(
                s.alias("start"), F.lit(count).alias("count"),
                F.xxhash64(F.lit(count), whole(x, s, count, "one")).alias("print"), s.alias("mark"),
                whole(x, s, count, "one").alias("one"), whole(x, s, count, "two").alias("two")))))

    def all_(x: Column) -> Column:
        runs = F.when(F.size(x) >= run, with_grams(x))
        if not words:
            return runs
        fewer = [F.coalesce(of_words(x, k), F.array()) for k in range(1, run)]
        return F.concat(F.coalesce(runs, F.array()), *[F.filter(f, lambda y: y.isNotNull()) for f in fewer])

    return let(lines, all_)


def _left(x: Column) -> Column:
    """What is left of the lines without the runs of `starts`, each a start and a
    count of lines, as a struct: text, and the numbers of lines with a word, in all and gone."""
    places = F.filter(
        F.transform(x["lines"], lambda line, i: F.when(line.rlike(WORD), i)), lambda i: i.isNotNull())

    def counted(y: Column) -> Column:
        gone = F.array_distinct(F.flatten(F.transform(y["starts"], lambda s: F.slice(y["places"], s["start"] + 1, s["count"]))))
        return let(F.struct(y["lines"].alias("lines"), y["places"].alias("places"), F.coalesce(gone, F.array().cast("array<int>")).alias("gone")), joined)

    def joined(z: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(z["lines"]) - 1), z["gone"])
        return F.struct(
            F.array_join(F.transform(stay, lambda i: z["lines"][i]), "\n").alias("text"),
            F.size(z["places"]).alias("n_lines"), F.size(z["gone"]).alias("n_removed"))

    return let(F.struct(x["lines"].alias("lines"), x["starts"].alias("starts"), places.alias("places")), counted)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 of what is left."""
    done = dedup_lines(docs, words=LONG)
    return done.select(
        "doc_id", "n_lines", "n_removed", hex_sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


def oracle_sql(run: int = RUN, words: int = LONG) -> str:
    """The same rows as `digest`, written without fingerprints."""
    leads = ", ".join(f"lead(line, {k}) OVER w AS l{k}, lead(n, {k}) OVER w AS n{k}" for k in range(1, run))
    each = []
    for count in range(1, run + 1):
        keys = ", ".join(["line", *[f"l{k}" for k in range(1, count)]])
        enough = " + ".join(["n", *[f"n{k}" for k in range(1, count)]]) + f" >= {words}"
        full = f"l{count - 1} IS NOT NULL" if count > 1 else "true"
        each.append(f"""SELECT doc_id, nr, {count} AS lines, row_number() OVER (PARTITION BY {keys} ORDER BY doc_id, nr) AS copy
  FROM runs WHERE {full if count == run else f"{full} AND {enough}"}""")
    ordered = "\n  UNION ALL ".join(each)
    return f"""
WITH all_lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nr,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM all_lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
runs AS (
  SELECT doc_id, nr, line, n, {leads}
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY nr)),
ordered AS (
  {ordered}),
gone AS (
  SELECT DISTINCT doc_id, nr + k AS nr FROM ordered, range(0, {run}) AS r(k) WHERE copy > 1 AND k < lines),
marked AS (
  SELECT a.doc_id, a.pos, a.line, f.nr, g.nr AS gone
  FROM all_lines a LEFT JOIN full_lines f ON a.doc_id = f.doc_id AND a.pos = f.pos
  LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.nr = g.nr)
SELECT doc_id, count(nr) AS n_lines, count(gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS text_sha256
FROM marked GROUP BY doc_id"""
