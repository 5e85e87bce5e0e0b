"""Ids are the library's even for words made to collide, and for very long texts."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from chiweave.llm import tokens
from chiweave.llm.queries import BPE
from chiweave.llm.tokens import Encoder

LIB = Tokenizer.from_file(BPE)


def library(texts):
    return [np.array(LIB.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def thue_morse(n):
    """A word of a and b and its complement: polynomials of any odd base modulo 2^64 agree
    on the two from 1024 letters on (often from 512)."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_colliding_words_keep_their_own_ids(n):
    a, b = thue_morse(n)
    texts = [f"x {a}", f"x {b}", f"x {a} y {b}.", f"{b} {a},", a, b]
    assert Encoder(BPE)(texts) == library(texts)  # all in one block
    apart = Encoder(BPE)
    assert [apart([t])[0] for t in texts] == library(texts)  # through the kept words


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_VALUE", np.zeros(256, np.uint64))  # now equal lengths collide
    texts = ["one two six", "two one six, ten.", "", "abcdefgh abcdefgi abcdefghi abcdefghj", "  x", "ten six"]
    assert Encoder(BPE)(texts) == library(texts)


def test_a_text_over_two_mebibytes():
    texts = ["short one", "w1 w22, " * 300_000 + "end.", "after it"]
    assert len(texts[1]) > tokens.MOST
    assert Encoder(BPE)(texts) == library(texts)


def test_ids_must_fit_the_type():
    with pytest.raises(ValueError, match="do not fit"):
        Encoder(BPE, "u1")
