import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm import byte_bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library():
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return byte_bpe.Codec(ranks, P.PATTERN)


def ids_of(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_perfect_hash_is_minimal(ranks):
    table = byte_bpe.PerfectHash(ranks)
    assert len(table.keys) == len(ranks) and set(table.keys) == set(ranks)
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"no such token, surely") == -1


def test_a_byte_without_a_rank_is_refused(ranks):
    with pytest.raises(ValueError):
        byte_bpe.Codec({k: v for k, v in ranks.items() if k != b"q"}, P.PATTERN)


def test_empty_ranks():
    assert byte_bpe.PerfectHash({}).get(b"a") == -1


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t\x0b\x85\xa0abAB1'.,é漢🙂std", max_size=60))
def test_encodes_as_the_library(codec, library, text):
    ids = codec.encode([text])[0]
    assert ids == ids_of(library, text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_the_two_heaps_agree(codec, data):
    assert codec.merge_many([data], 64) == [np.array(codec.merge(data), "<u4").tobytes()]


def test_forgetting_changes_nothing(ranks, library):
    codec = byte_bpe.Codec(ranks, P.PATTERN, remembered=3)
    for text in ("one two three four", "five six one", "one two three four"):
        assert codec.encode([text]) == [ids_of(library, text)]


def test_long_pre_token(codec, library):
    text = "ab" * 20_000
    assert codec.encode([text])[0] == ids_of(library, text)


def test_query_against_the_library(spark, sf, library, documents):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = queries.op8_byte_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, odd, none, library):
    from pyspark.sql import functions as F

    out = byte_bpe.encode_documents(odd.withColumn("Decoded", F.lit(1)), PATH, P.PATTERN, decode=True)
    assert out.columns == [*odd.columns, "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert bytes(r.ids) == ids_of(library, r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    again = byte_bpe.decode_documents(out.drop("decoded"), PATH).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted((r.text or "").encode() for r in rows)
    assert byte_bpe.encode_documents(none, PATH, P.PATTERN).count() == 0


def test_what_re_finds_is_what_regex_finds():
    slow, find = regex.compile(P.PATTERN).findall, byte_bpe.finder(P.PATTERN)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert find("".join(every)) == slow("".join(every))
    for a in range(0, 0x10000, 1 << 11):
        text = "x ".join(c for c in every[a : a + (1 << 11)] if c < "\uffff")
        assert find(text) == slow(text)
    r = random.Random(4)
    odd = "aé漢ǅ²٣Ⅷ '’stlvrem_-.\u0301\u200b\xa0\u3000\x1c\x1f\x85\n\t\r  \uffff"
    for more in ("", "🙂𝒳𑁦"):
        for _ in range(2000):
            text = "".join(r.choices(odd + more, k=r.randrange(30)))
            assert find(text) == slow(text)
    for pattern in (r"(?i)ab|\w+", r"\p{Lu}+|.", r"[\p{L}--a]+", r"a{2}|\s"):
        assert byte_bpe.finder(pattern)("AB aab 1") == regex.findall(pattern, "AB aab 1")


def test_regex_is_for_characters_that_re_is_slow_for(monkeypatch):
    class Slow:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(byte_bpe.regex, "compile", lambda pattern: Slow())
    codec = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN)
    assert codec.decode(codec.encode(["Naïve 漢字, it's 1 test"])[0]) == "Naïve 漢字, it's 1 test".encode()
    with pytest.raises(AssertionError):
        codec.encode(["new words 🙂"])
    monkeypatch.undo()
    # a call that failed leaves no pre-token without its ids
    again = byte_bpe.Codec(byte_bpe.read_ranks(PATH), P.PATTERN)
    assert codec.encode(["new words"]) == again.encode(["new words"])
