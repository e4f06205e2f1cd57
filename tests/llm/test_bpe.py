"""The walk of the encoder: what it asks for again, and words that make it go back."""

import random

import numpy as np
import public_tokenizers
import pytest

from graphspark.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


class Asked(list):
    count = 0

    def __getitem__(self, i):
        self.count += 1
        return super().__getitem__(i)


def test_rivals_are_asked_for_once(vocabulary):
    codec, words = bpe.Codec(vocabulary), [" enpfberber", " lalementchè", " ofreeaenwh", " therlyat"]
    codec.shorter = Asked(codec.shorter)
    first = [codec.words[w] for w in words]
    asked = codec.shorter.count
    codec.words.clear()
    assert asked and [codec.words[w] for w in words] == first and codec.shorter.count - asked < asked / 4
    assert not [*codec.automaton.iter("zq\x00\xff")]


def test_follow_is_the_longest_that_fits(vocabulary):
    codec = bpe.Codec(vocabulary)
    for before, token in ((" the", "ation"), ("th", "erer"), ("e", "nce"), ("q", "u"), ("", " the")):
        if token in codec.ids:
            left = codec.ids[before] if before else bpe.NONE
            want = next((codec.ids[token[:n]] for n in range(len(token), 0, -1) if token[:n] in codec.ids and codec.merged(before + token[:n]) == [x for x in (before, token[:n]) if x]), bpe.NONE)
            assert codec.follow(left, codec.ids[token]) == want == codec.follow(left, codec.ids[token])


@pytest.mark.parametrize("room", [2, 100_000])
def test_made_up_words_equal_the_library(vocabulary, monkeypatch, room):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CACHE_WORDS", room)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", room)
    tokenizer, codec, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.Codec(vocabulary), random.Random(7)
    parts = ["th", "er", "en", "on", "an", "ation", "ez", "é", "ñ", "sch", "q", "wh", "ly", " ", " ", "'s", "12", "\n", "#", "日", "\x00", "aaa"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
