import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlake.llm import tokens
from spanlake.llm.queries import tokenizer_path

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
#: Letters with odd cases and compositions, marks, white space of many kinds, signs, digits, names of special tokens.
PARTS = ["a", "S", "İ", "ı", "ß", "é", "é", "́", "Σ", "ς", "Å", "K", "ﬁ", "漢", "²", "½", "7", "٣", "'", "'s", "'S", "’", ".", ",", "!!", "|", "_", "$$", "Ġ", "Ċ", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "​", "　", "﻿", "\0", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "Word", "don't"]


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = tokenizer_path(request.param)
    return Tokenizer.from_file(path), tokens.Encoder(path)


def same(both, texts):
    library, own = both
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6))
@example(["Sİ, ’", "Sİ,", "İ.", "x İ́ ’", " ", "\n", "a\n", "\na", "a \n b", "a\n\nb", "a\n b", "a.\n'tis", "a\n3", "", "foo,|bar | baz"])
def test_like_the_library(both, texts):
    same(both, texts)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(both, texts):
    same(both, texts)


def test_small_cache(both, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    monkeypatch.setattr(tokens, "LEARN", 2)
    for _ in range(3):
        same(both, ["one two, three.\nFour five", "two three  four", "Six 7 eight's one"])


def test_zero_byte_before_a_known_run(both):
    """Runs known without a space before them, and pieces that begin with a zero byte, aren't taken for each other."""
    for texts in (["x.zq"], ["a \0zq"], ["a \0qz"], ["x.qz"], ["  \0zq \0  qz \0 zq"]):
        same(both, texts)
