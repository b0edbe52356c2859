"""Token counts and packed pieces against the tokenizers library."""
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import no_documents, odd_documents, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contactlake.llm.packing import OpenBins, first_fit_decreasing, pack, word_ids
from contactlake.llm.tokens import token_counts, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


TRICKY = ["", " ", "don't We'll I'D 'S x's ''s", "aaaa aaaaaaa bbbbbbbbb", "<|endoftext|>a<|startoftext|><|endoftext|>", "ΑΣ Σ ΣΑΣ",
          "İstanbul ǅ ﬁ", "é é ạ̇", "１２ ²³ Ⅷ ٣", "a\x1cb \x85c d​e", "日本語 ภาษาไทย 😀👩‍👩‍👧", "x" * 3000,
          "<|endoftext|", "a-b--c...d!!!'s", "\x00\x01a", "Ǆ ß ẞ"]


@pytest.mark.parametrize("text", TRICKY)
def test_counts_and_ids_of_tricky_texts(text):
    raw = text.encode()
    assert word_bpe(PATH).counts([raw]) == [len(ids(text))]
    assert np.frombuffer(word_ids(PATH).ids(pa.array([raw.decode("utf-8", "replace")]))[0], "<u4").tolist() == ids(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_and_ids_of_any_text(text):
    assert word_bpe(PATH).counts([text.encode()]) == [len(ids(text))]
    assert np.frombuffer(word_ids(PATH).ids(pa.array([text]))[0], "<u4").tolist() == ids(text)


def test_counts_of_odd_rows(spark):
    got = Counter(tuple(r) for r in token_counts(odd_documents(spark), PATH).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), len(ids(r[1]))) for r in odd_rows())
    assert token_counts(no_documents(spark), PATH).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=40))
def test_first_fit_is_the_plain_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = first_fit_decreasing(sizes, 16)
    room = []
    for s, b, o in zip(sizes, bins, offsets):
        want = next((i for i, r in enumerate(room) if r >= s), len(room))
        if want == len(room):
            room.append(16)
        assert (b, o) == (want, 16 - room[want])
        room[want] -= s


def test_tree_of_one_bin():
    t = OpenBins(1)
    assert t.first(1) == -1
    t.set(0, 5)
    assert (t.first(5), t.first(6)) == (0, -1)


@pytest.mark.parametrize("group_pieces", [4096, 3])
def test_every_id_lies_in_one_piece(spark, group_pieces):
    rows = [r.asDict() for r in pack(odd_documents(spark), PATH, 64, end_id=1, group_pieces=group_pieces).collect()]
    want = Counter()
    for r in odd_rows():
        whole = np.array([*ids(r[1]), 1], "<u4")
        for lo in range(0, len(whole), 64):
            part = whole[lo:lo + 64]
            want[(r[0], lo, len(part), zlib.crc32(part.tobytes()), len(whole))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_nothing_to_pack(spark):
    assert pack(no_documents(spark), PATH).collect() == []
