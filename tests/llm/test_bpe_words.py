"""Texts are encoded word by word where the pattern allows it, with the same ids."""

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from pelagrid.llm import bpe, catalogue

ODD = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", " ", " ", "　", "a", "Bc", "ab", "'s", "'", "1", "23", ".", ",", "!!", "?", "é", "中", "\U0001F600", "́"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(catalogue.VOCABULARY, catalogue.PATTERN)


def by_piece(coder, text):
    return [i for piece in regex.findall(catalogue.PATTERN, text) for i in coder.words.memory.transducer.encode(piece.encode())]


def test_the_pattern_is_known(coder):
    assert coder.by_word and not bpe.Encoder(catalogue.VOCABULARY, r"\S+|\s+").by_word


@given(st.lists(st.sampled_from(ODD), max_size=12).map("".join))
@settings(deadline=None, max_examples=3000)
def test_ids_are_those_of_the_pieces(coder, text):
    assert coder.encode(text).tolist() == by_piece(coder, text)


def test_words_seen_before_are_not_cut_again(coder):
    class Counting:
        scanned, pieces = 0, coder.words.pieces

        def findall(self, text):
            Counting.scanned += len(text)
            return self.pieces.findall(text)

    text = " ".join(["first", *["one", "two,", "three's"] * 1000])
    wanted = by_piece(coder, text)
    coder.words.pieces = Counting()
    assert coder.encode(text).tolist() == wanted and Counting.scanned < 100
    coder.words.pieces = Counting.pieces


def test_full_memories_change_nothing(coder, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "LONG", 5)
    draw = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(draw.choice(ODD, 30))
        assert coder.encode(text).tolist() == by_piece(coder, text)
