"""All words at once are read as one by one; disguises beyond single bytes reach the lattice."""
import itertools

import numpy as np
import pyarrow as pa
from test_classifiers import model_of

from contactlake.llm.textarrays import string_block
from contactlake.llm.toxicity import (ALPHABET, DISGUISES, HIDDEN, REPEAT, SEPARATE, SEPARATORS, SIGN, Restorer, _code, disguised, restore_word,
                                      restore_words)

MODEL = model_of("a you are the idiot stupid loser trash clown and of moron evil hole ass hello sweet little letter such and then " * 50)


def random_words(n, letters, longest):
    rng = np.random.Generator(np.random.PCG64(3))
    return ["".join(rng.choice(list(letters), int(rng.integers(0, longest)))) for _ in range(n)]


def test_batches_read_as_single_words_do():
    words = random_words(4_000, "abdeilotu013$@!€.-* éаіA​", 14) + ["", " ", "x1" * 400, "thhe", "1d10t", "a s t u p i d"]
    for breaks in (True, False):
        got = restore_words(words, MODEL, breaks)
        assert got == [restore_word(w, MODEL, breaks) for w in words]
    assert restore_words([], MODEL) == []


def price(word, choice):
    """Cost of one reading given as a list of kept letter, None (dropped) or '' (stays), each summed plainly."""
    total, a, b = 0.0, 0, 0
    before = ""
    for ch, c in zip(word, choice):
        letter = ch.isalpha()
        if c is None:
            if ch in SEPARATORS:
                total += SEPARATE
            elif ch == before and letter:
                total += REPEAT
            else:
                return np.inf
        elif c == "":
            if letter:
                return np.inf
            total += MODEL.cost[a][b][0] if b else 0.0
            a = b = 0
        else:
            total += (0.0 if c == ch else SIGN) + MODEL.cost[a][b][_code(c)]
            a, b = b, _code(c)
        before = ch
    return total + (MODEL.cost[a][b][0] if b else 0.0)


def test_no_reading_is_cheaper():
    for word in ["1d10t", "st.u.p", "l0$er", "a$$", "iddi0t", "5h.17", "h0lle", "e.v!!l", *random_words(60, "aeilost10$.", 6)]:
        ways = [[*([ch] if ch.isalpha() else []), *DISGUISES.get(ch, ""), None, ""] for ch in word]
        prices = {}
        for choice in itertools.product(*ways):
            read = "".join(ch if c == "" else c or "" for ch, c in zip(word, choice))
            prices[read] = min(prices.get(read, np.inf), price(word, choice))
        got = restore_words([word], MODEL)[0]
        assert abs(prices[got] - min(prices.values())) < 1e-9, word


def read(*texts):
    data, at = Restorer(MODEL)(*string_block(pa.array(texts, pa.string())))
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(at, at[1:])]


def test_signs_of_several_bytes_wide_spaces_and_look_alikes():
    seen = ["£oser", "€vil", "you a s s hole", "s  t  u  p \t i  d", "st​up­id", "lоsеr", "1d10t"]
    meant = ["loser", "evil", "ass", "stupid", "stupid", "loser", "idiot"]
    assert [m in r.split() for r, m in zip(read(*seen), meant)] == [True] * 7
    assert read("пора", "a b", "plain word") == ["пора", "a b", "plain word"]
    assert disguised(*string_block(pa.array(["a", "b", "c", None, ""], pa.string()))) == []


def test_one_restorer_over_many_blocks_forgets_without_changes():
    texts = [" ".join(random_words(50, "abdeilotu013$.", 9)) for _ in range(3)] + [None, "", "x"]
    small, large = Restorer(MODEL, remember=5), Restorer(MODEL)
    for _ in range(3):
        for k in (texts, texts[::-1], texts[1:2]):
            one, two = small(*string_block(pa.array(k, pa.string()))), large(*string_block(pa.array(k, pa.string())))
            assert one[0].tobytes() == two[0].tobytes() and one[1].tolist() == two[1].tolist()
    assert ALPHABET == 32 and len(HIDDEN) == 6
