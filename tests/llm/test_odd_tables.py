"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pelagrid.llm import (
    bpe,
    catalogue,
    exact_dedup,
    language,
    license_scan,
    line_dedup,
    mixing,
    quality,
    sharding,
    simhash,
    substring_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHING = ["id", "kid", "kt", "c0", "c1", "kept", "size", "bucket", "made", "readable", "token_ids",
            "lang_pred", "score", "n_removed", "starts", "root", "position", "text_sha256", "a.b"]
LINES = "first line of it\nsecond line of it\n\nthird line of it"
LONG = "\n".join(f"line {i} has words {i * 7} and {i * 13}" for i in range(20_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None),
        (None, "", "en", "a", 0),
        (2, " \t\n", None, "a", 3),
        (3, "one", "en", None, 3),
        (4, LINES, "en", "b", 9),
        (4, LINES, "en", "b", 9),
        (5, LINES, "fr", "b", 9),
        (None, LINES, None, None, None),
        (6, LONG, "en", "b", 1),
        (7, "tail\n" + LONG + "\nend", "en", "c", 1),
        (8, "Released under the MIT License.\nthen más, 漢字 🙂 words", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({n: F.lit("mine") for n in CLASHING if "." not in n}).select(
        "*", F.lit("mine").alias("a.b")).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def by(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_line_dedup(odd, none):
    done = line_dedup.dedup_lines(odd)
    assert set(done.columns) == {*odd.columns, "n_lines"}
    found = {(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in done.collect()}
    # Null ids come first, so of the equal runs theirs stays.
    assert (None, 3, 0, LINES) in found
    assert (4, 3, 3, "") in found and (5, 3, 3, "") in found
    assert (1, 0, 0, None) in found and (2, 0, 0, " \t\n") in found
    assert (6, 20_000, 0, LONG) in found
    assert (7, 20_002, 20_000, "tail\nend") in found
    assert done.where("kept = 'mine' and `a.b` = 'mine'").count() == odd.count()
    assert line_dedup.dedup_lines(none).count() == 0


def test_repeated_rows_are_one_document_for_lines(spark):
    twice = spark.createDataFrame([(1, LINES), (1, LINES)], "doc_id long, text string")
    assert by(line_dedup.dedup_lines(twice), "n_removed", "text") == [(0, LINES)] * 2


def test_runs_longer_than_the_least_and_within_a_text(spark):
    docs = spark.createDataFrame([
        (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nq"), (4, "p\nq\nr\np\nq\nr\np\nq\nr")], "doc_id long, text string")
    assert by(line_dedup.dedup_lines(docs), "doc_id", "text") == [
        (1, "a\nb\nc\nd"), (2, "x\ny"), (3, "a\nb\nq"), (4, "p\nq\nr")]


def test_exact_dedup(odd, none):
    found = by(exact_dedup.dedup_exact(odd), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    expected = [
        (1, 1, 2, True, sha("")), (None, 1, 2, False, sha("")), (2, 2, 1, True, sha(" \t\n")), (3, 3, 1, True, sha("one")),
        *[(i, 5, 4, i == 5, sha(LINES)) for i in (4, 4, 5, None)],
        (6, 6, 1, True, sha(LONG)), (7, 7, 1, True, sha("tail\n" + LONG + "\nend")),
    ]
    assert [f for f in found if f[0] != 8] == sorted(expected, key=repr)
    assert exact_dedup.dedup_exact(none).count() == 0


def test_colliding_chunks_are_told_apart(spark, monkeypatch):
    """With identifiers that all collide the texts' own hashes decide."""
    docs = spark.createDataFrame([(1, "left"), (2, "right"), (3, "left")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    found = by(exact_dedup.dedup_exact(docs), "doc_id", "keep_id", "group_size")
    assert found == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def test_mixing(odd, none):
    found = mixing.mixture(odd).collect()
    assert len(found) == odd.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    assert sum(r["size"] for r in found if r["id"] == 4) == 2 * 12
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mixture(none).count() == 0 and mixing.mix(none).count() == 0


def test_sources_without_a_word(spark):
    docs = spark.createDataFrame([(1, "", "s"), (2, None, "s"), (3, " ", None)], "doc_id long, text string, source string")
    assert by(mixing.mixture(docs), "id", "size", "target", "taken") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)]


def test_bpe(odd, none):
    done = bpe.round_trip(odd, catalogue.VOCABULARY, catalogue.PATTERN)
    assert set(done.columns) == {*odd.columns, "decoded"}
    assert done.where("not (decoded <=> coalesce(text, '')) or (size(token_ids) > 0) = (coalesce(text, '') = '')").count() == 0
    twice = bpe.decode(bpe.encode(odd, catalogue.VOCABULARY, catalogue.PATTERN), catalogue.VOCABULARY)
    assert twice.where("not (decoded <=> coalesce(text, ''))").count() == 0
    assert bpe.encode(none, catalogue.VOCABULARY, catalogue.PATTERN).count() == 0


def test_language(odd, none):
    model = language.fit(odd, F.lit(True))
    assert model.languages == ["en", "fr"]
    done = language.identify(odd, model)
    assert set(done.columns) == set(odd.columns)
    found = by(done, "doc_id", "lang_pred", "score")
    assert (1, "und", 0.0) in found and (2, "und", 0.0) in found and (None, "und", 0.0) in found
    assert all(0 <= s <= 1 and p in ("en", "fr") for _, p, s in found if p != "und")
    assert language.fit(none, F.lit(True)) is None
    assert language.identify(none, model).count() == 0
    assert by(language.identify(odd.limit(1), None), "lang_pred", "score") == [("und", 0.0)]


def test_quality(odd, none):
    found = by(quality.judged(odd), "id", *quality.COUNTS, "base_failed", "kept")
    assert (1, 0, 0, 0, 0, 0, True, False) in found
    assert found.count((4, 12, 40, 0, 0, 0, False, True)) == 2
    assert len(found) == odd.count()
    assert quality.judged(none).count() == 0


def test_sharding(odd, none):
    found = sharding.sharded(odd, shards=4)
    assert sorted(r["n"] for r in found.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [2, 3, 3, 3]
    assert by(found.groupBy("shard").agg((F.max("slot") + 1 - F.count_distinct("slot")).alias("gap")), "gap") == [(0,)] * 4
    assert by(found.where("id = 1"), "size", "text_crc32") == [(16, 0)]
    assert sharding.sharded(none).count() == 0


def test_substring_dedup(odd, none):
    done = substring_dedup.dedup_substrings(odd)
    assert set(done.columns) == {*odd.columns, "n_words"}
    found = {(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in done.collect()}
    # Shorter than a window, although it repeats; the long texts repeat as a whole.
    assert (4, 12, 0, " ".join(LINES.split())) in found
    assert (1, 0, 0, None) in found and (None, 0, 0, "") in found
    n = len(LONG.split())
    assert (6, n, n, "") in found and (7, n + 2, n, "tail end") in found
    assert done.count() == odd.count()
    assert substring_dedup.dedup_substrings(none).count() == 0


def test_repeated_rows_repeat_their_windows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x " + text[:-5])], "doc_id long, text string")
    assert by(substring_dedup.dedup_substrings(docs), "doc_id", "n_removed") == [(1, 40), (1, 40), (2, 38)]


def test_simhash(odd, none):
    found = by(simhash.near(odd), "id", "fingerprint", "component_id")
    assert (1, 0, 1) in found and (2, 0, 1) in found and (None, 0, 1) in found
    assert len({f[1] for f in found if f[0] in (4, 5)}) == 1
    assert {f[2] for f in found if f[0] in (4, 5)} == {4}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    # Of the rows that repeat an id and its text one stays.
    assert [i for i, in by(kept, "doc_id")].count(4) == 1
    assert {1, 3, 4, 8} <= {i for i, in by(kept, "doc_id")} <= {1, 3, 4, 6, 7, 8}
    assert simhash.near(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_groups_without_any_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert by(simhash.near(docs), "component_id") == [(None,)] * 2
    assert simhash.one_of_each(docs).count() == 1


def test_license_scan(odd, none):
    assert by(license_scan.scanned(odd), "kid", "template", "first", "last", "dice") == [(8, "mit-line", 1, 5, 1.0)]
    assert by(license_scan.digest(odd).where("n_matches = 0"), "license", "dice", "first_word") == [(None, None, None)] * 10
    assert license_scan.digest(none).count() == 0
    assert license_scan.scanned(odd, {}).count() == 0 and license_scan.scanned(odd, {"one": "word"}).count() == 0
