"""Disguises of any length and at any place of a word reach the lattice."""
import re

import pyarrow as pa
from test_classifiers import model_of

from contactlake.llm.textarrays import string_block
from contactlake.llm.toxicity import Restorer, restore_word

MODEL = model_of("a you are the idiot stupid loser trash clown and of moron shit ass hello sweet little letter such and then " * 50)


def read(*texts):
    data, at = Restorer(MODEL)(*string_block(pa.array(texts, pa.string())))
    raw = data.tobytes().decode()
    return [raw[a:b] for a, b in zip(at, at[1:])]


def test_signs_and_repeats_anywhere_in_a_word():
    seen = ("shi7", "a$$", "5h17", "iddiot", "hello", "little", "you hello!")
    meant = ("shit", "ass", "shit", "idiot", "hello", "little", "hello")
    assert all(m in re.split(r"\W+", t) for t, m in zip(read(*seen), meant, strict=True))
    assert read("hello little", "you. are", "the/idiot") == ["hello little", "you. are", "the/idiot"]


def test_words_longer_than_forty_bytes():
    assert read("st" + "u" * 60 + "pid", "i" * 5_000 + "diot") == ["stupid", "idiot"]
    joined = read("the/letter/and/sweet/little/hello/1d10t/you", "the.letter.and.sweet.little.hello.1d10t.you")
    assert all("idiot" in t.replace(".", "/").split("/") for t in joined)


def test_runs_of_single_letters():
    words = "you are such a stupid moron and then a little clown and the loser of the trash".split()
    assert len("".join(words)) > 40
    got = read(" ".join("".join(words)), "a s t u p i d")
    assert {"stupid", "moron", "clown", "loser", "trash"} <= set(got[0].split())
    assert "stupid" in got[1].split()


def test_a_very_long_word_ends():
    assert restore_word("x1" * 50_000, MODEL)
