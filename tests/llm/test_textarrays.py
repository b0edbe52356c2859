"""Words, shingles and Arrow blocks against plain Python."""
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from contactlake.llm.textarrays import blocks, hash_word, shingle_sets, string_block, words


def plain_words(text):
    raw = re.sub(rb"[A-Z]+", lambda m: m.group().lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)


def run(texts):
    data, at = string_block(pa.array(texts, pa.string()))
    return words(data, at)


TEXTS = st.lists(st.none() | st.text(alphabet="aAbZé \t\n .,", max_size=40), max_size=12)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_match_plain_split(texts):
    w = run(texts)
    for i, t in enumerate(texts):
        got = w.hash[w.first[i]:w.first[i + 1]].tolist()
        assert got == [hash_word(x.decode()) for x in plain_words(t)]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_shingle_sets_have_the_size_of_plain_sets(texts):
    s = shingle_sets(run(texts))
    for i, t in enumerate(texts):
        w = plain_words(t)
        plain = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert s.first[i + 1] - s.first[i] == len(plain)


def test_same_words_same_set_wherever_they_stand():
    s = shingle_sets(run(["x y", "a b c d e f", "", "A  b\nc d e F", "a b c d e f g"]))
    sets = [set(s.member[a:b].tolist()) for a, b in zip(s.first, s.first[1:])]
    assert sets[1] == sets[3] and len(sets[1] & sets[4]) == 2 and not sets[2] and len(sets[0]) == 1


def test_blocks_keep_all_rows_of_slices_and_long_texts():
    texts = ["a" * n for n in (5 << 20, 0, 10, 3 << 20, 2 << 20)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"]).slice(0, 6)
    got = list(blocks(batch, "t"))
    assert [x for b in got for x in b.column("i").to_pylist()] == list(range(6)) and len(got) > 1
    data, at = string_block(batch.slice(1, 3).column("t"))
    assert np.diff(at).tolist() == [0, 10, 3 << 20] and len(data) == at[-1]
