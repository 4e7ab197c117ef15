"""Bounds of the quality rules follow their groups, and each rule can reject by itself."""

import pytest

from pelagrid.llm import quality


def plain(i, words=300, letters=4):
    """A text of different words, ten a line."""
    spelled = [f"{i:03d}{j:04d}".translate(str.maketrans("0123456789", "abcdefghij"))[-letters:] for j in range(words)]
    return "\n".join(" ".join(spelled[k:k + 10]) for k in range(0, words, 10))


def judged(spark, texts):
    rows = [(i, t, "en", s) for i, (t, s) in enumerate(texts)]
    return {r["id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}


ODD = {
    "word_length": " ".join(f"averyverylongword{i}" for i in range(300)),
    "symbol_share": " ".join(f"{w}{'#' if k % 9 == 0 else ''}" for k, w in enumerate(plain(1).split())),
    "dup_line_share": "\n".join(["one two", *[f"{w} x" for w in plain(2, 60).split()]] + ["one two"] * 14),
    "repeat_share": " ".join([*plain(3, 700).split(), *plain(3, 70).split()]),
}


@pytest.mark.parametrize("name", ODD)
def test_each_rule_rejects_alone(spark, name):
    found = judged(spark, [*((plain(i), "a") for i in range(40)), (ODD[name], "a")])
    odd = found.pop(40)
    assert all(r["kept"] for r in found.values())
    assert not odd["base_failed"] and not odd["kept"]
    over = set()
    for n, (count, of) in quality.RATIOS.items():
        chance = quality.SURE * (quality.CLUMP.get(n, 1) * odd[count]) ** 0.5
        if odd[count] - chance > odd[f"{n}_high"] * odd[of]:
            over.add(n)
    assert over == {name}


def test_sources_have_bounds_of_their_own(spark):
    """What is too much in one source is usual in another one of the same language."""
    coded = [" ".join(f"{w}{'#' * (k % 4 == i % 3)}" for k, w in enumerate(plain(i).split())) for i in range(600)]
    found = judged(spark, [*((plain(i), "prose") for i in range(600)), *((t, "code") for t in coded), (coded[0], "prose")])
    assert found[0]["symbol_share_high"] < found[600]["symbol_share_high"]
    assert found[600]["kept"] and not found[1200]["kept"] and found[1200]["n_symbols"] == found[600]["n_symbols"]


def test_small_groups_borrow(spark):
    """A group of one document has the bounds of its language, a large one its own."""
    for n, letters in ((1, 3), (3000, 7)):
        texts = [*((plain(i, 40, 3), "a") for i in range(400)), *((plain(i, 40, 7), "b") for i in range(n))]
        row = judged(spark, texts)[400]
        assert row["word_length_low"] <= letters <= row["word_length_high"]
        assert row["word_length_high"] / row["word_length_low"] < 1.05
