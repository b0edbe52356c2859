"""Byte-level ids against the rank file's own library, and the way back."""
import public_tokenizers
import pytest
import regex
import tiktoken
from helpers import no_documents, odd_documents, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from contactlake.llm import bytebpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bytebpe.rank_coder(PATH, PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


def check(coder, plain, texts):
    ids, first = coder.encode(texts)
    raw, begin, _ = coder.table.decode(ids, first)
    for k, t in enumerate(texts):
        mine = ids[first[k]:first[k + 1]].tolist()
        assert mine == plain.encode_ordinary(t), t
        assert raw[begin[k]:begin[k + 1]] == t.encode()


def test_texts_of_all_kinds(coder, plain):
    check(coder, plain, [
        "", " ", "  \n\n x", "it's we'll I'd 'tis '''s", "<|endoftext|> a<|endoftext|>", "z" * 5000, "   " * 900 + "a", "a b c d\x1c\x85e",
        "naïve café ñandú Straße", "日本語の文章です。１２３ ٣٤٥", "՘࢏\U00011de0 \U0001f600\U0001f468‍\U0001f469", "\u0000�﻿", "a" * 131 + "b" * 67,
        "ab" * 77 + "aab" * 33])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(coder, plain, texts):
    check(coder, plain, texts)


@settings(max_examples=300, deadline=None)
@given(st.text("ab '-\n1é՘", max_size=80))
def test_small_alphabet(coder, plain, text):
    check(coder, plain, [text])


def test_library_alone_agrees_on_ordinary_words(coder, plain):
    words = [w for r in odd_rows() if r[1] for w in set(coder.split(r[1]))]
    found = coder._library.encode_batch([w.encode().decode("latin-1").translate(coder._letter) for w in words])
    assert [f.ids for f in found] == [plain.encode_ordinary(w) for w in words]


def test_settled_letters_have_one_kind(coder):
    assert min(coder._stand_ins()) > 0x24F
    assert set(regex.findall(r"\s", "".join(map(chr, range(0x250))))) == {*" \t\n\r\x0b\x0c\x85\xa0"}


def test_memory_is_bounded(coder, plain, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 10)
    for k in range(6):
        check(coder, plain, [" ".join(f"w{i}" for i in range(k, k + 30)), "q" * 100])
    assert len(coder._young) + len(coder._old) < 200 and "q" * 100 not in {**coder._young, **coder._old}


def test_split_characters():
    ids_raw = "é日x".encode()
    import numpy as np

    assert bytebpe.token_texts(ids_raw, np.array([1, 1, 1, 1, 1, 1])) == ["", "é", "", "", "日", "x"]
    assert bytebpe.token_texts(ids_raw, np.array([3, 2, 1])) == ["é", "日", "x"]
    assert bytebpe.token_texts(ids_raw, np.array([0, 6, 0])) == ["", "é日x", ""]
    assert "".join(bytebpe.token_texts(b"a\xe6\x97", np.array([2, 1]))) == "a�"
    assert bytebpe.token_texts(b"\xffb", np.array([1, 1])) == ["�", "b"]
    assert bytebpe.token_texts(b"", np.array([], int)) == []


def test_odd_documents(spark, plain):
    docs = odd_documents(spark)
    out = bytebpe.decode(bytebpe.encode(docs, PATH, PATTERN, offsets=True), PATH, texts=True).collect()
    want = sorted((r[0] is None, r[0], plain.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in odd_rows())
    assert sorted((r.doc_id is None, r.doc_id, list(r.ids), bytes(r.bytes)) for r in out) == want
    for r in out:
        assert "".join(r.pieces) == bytes(r.bytes).decode() and len(r.pieces) == len(r.ids) == len(r.starts)
        for i, s in zip(r.ids, r.starts):
            token = plain.decode_single_token_bytes(i)
            assert bytes(r.bytes)[s:s + len(token)] == token
    assert bytebpe.decode(bytebpe.encode(no_documents(spark), PATH, PATTERN), PATH).count() == 0


def test_foreign_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, None, -5, 10**8, 65])], "bytes INT, ids ARRAY<INT>")
    out = bytebpe.decode(rows.withColumnRenamed("bytes", "k"), PATH, texts=True).orderBy("k").collect()
    assert [bytes(r.bytes) for r in out] == [b"", b"", b"ab"]
    assert [r.pieces for r in out] == [[], [], ["a", "", "", "", "b"]]


def test_query_on_a_given_table(spark, plain):
    import hashlib

    from contactlake.llm.queries import op13_byte_bpe
    from contactlake.llm.tables import read

    texts = {r.doc_id: r.text or "" for r in read(spark, "/root/testdata/sf0.001", "documents").collect()}
    out = op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == len(texts)
    for r in out:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_blocks_of_ids(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [64 + k % 3] * (k % 5)) for k in range(40)], "k INT, ids ARRAY<INT>").coalesce(1)
    monkeypatch.setattr(bytebpe, "BLOCK_IDS", 4)
    out = bytebpe.decode(rows, PATH).orderBy("k").collect()
    assert [bytes(r.bytes) for r in out] == [b"abc"[k % 3:k % 3 + 1] * (k % 5) for k in range(40)]
