import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import language as L
from tagloom.llm import queries

PATH = P.path("piece_bpe_32k.model")
PIECES = ["▁a", "▁ab", "b", "ab", "c", "abc", "▁", "bc", "é"]


@pytest.fixture(scope="module")
def model():
    p = np.random.default_rng(0).random((len(PIECES), 2))
    return L.PieceModel(["x", "y"], L.Pieces(PIECES), p / p.sum(axis=0))


def all_ways(model, text, k):
    if not text:
        return 1.0
    row = {p: i for i, p in enumerate(PIECES)}
    return sum((model.p[row[text[:n]], k] if text[:n] in row else 1e-7 * (n == 1)) * all_ways(model, text[n:], k) for n in range(1, len(text) + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcéz", min_size=1, max_size=8), min_size=1, max_size=4))
def test_forward_sums_all_segmentations(model, words):
    got = model.forward(words)
    for w, row in zip(words, got):
        assert row == pytest.approx([math.log(all_ways(model, "▁" + w, k)) for k in range(2)])


def test_expected_uses_add_up(model):
    words = ["ab", "abc", "c", "zab"]
    counts = np.array([2.0, 1, 5, 1])
    uses = model.expected(words, counts, 0)
    lengths = np.array([len(p) for p in PIECES])
    # every character of every word is in exactly one piece, or is a letter that is no piece
    total = (counts * [len(w) + 1 for w in words]).sum()
    assert total - 1 - 1e-6 <= (uses * lengths).sum() <= total + 1e-6


def test_query_is_right_on_what_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_language(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.99


def test_words_end_where_letters_end():
    assert L.words_of("x² H₂O a1b Ünï_É 漢字") == ["x", "h", "o", "a", "b", "ünï", "é", "漢字"]


def test_a_long_run_of_letters_is_one_word(model):
    for length, chunk in ((100, 4096), (1000, 16), (5000, 4096)):
        word = "abcz" * (length // 4)
        old, L.CHUNK = L.CHUNK, chunk
        try:
            got = model.forward([word, "ab"])[0]
        finally:
            L.CHUNK = old
        # sums in logarithms, place by place
        text, row = "▁" + word, {p: i for i, p in enumerate(PIECES)}
        for k in range(2):
            best = [0.0] + [-math.inf] * len(text)
            for i in range(len(text)):
                for n in range(1, 5):
                    p = model.p[row[text[i : i + n]], k] if text[i : i + n] in row else 1e-7 * (n == 1)
                    if p and i + n <= len(text):
                        best[i + n] = np.logaddexp(best[i + n], best[i] + math.log(p))
            assert got[k] == pytest.approx(best[-1])
        uses = model.expected([word], np.array([1.0]), 0)
        assert np.isfinite(uses).all() and 0.5 * length < (uses * [len(p) for p in PIECES]).sum() <= length + 1


def test_no_language_is_left_out(spark):
    # a rare language whose words occur once beside one with many, and hundreds more
    rows = [("a b c d e f g h a b c", "de")] * 3 + [("x y", "fr")] + [("abc " * 3, f"l{i:04}") for i in range(520)]
    words = L.training_words(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    found = {}
    for r in words.collect():
        found.setdefault(r.lang, {})[r.word] = r.n
    assert found["fr"] == {"x": 1, "y": 1} and len(found) == 522
    model = L.fit(words, [*PIECES, "x", "y"])
    assert model.languages == sorted(found)
    assert L.Scorer(model).score(["x y x y", None, "²"])[0] == ["fr", "und", "und"]


def test_accuracy_against_brute_force(spark, documents):
    """Posteriors of whole texts by summing every word's segmentations one place at a time."""
    pieces = L.read_pieces(PATH)
    model = L.fit(L.training_words(documents, "text", "lang"), pieces)
    row = {p: i for i, p in enumerate(pieces)}
    texts = [r.text for r in documents.where("text IS NOT NULL").orderBy("doc_id").limit(15).collect()]
    names, scores = L.Scorer(model).score(texts)
    for text, name, score in zip(texts, names, scores):
        total = np.zeros(model.width)
        for w in L.words_of(text):
            w = "▁" + w
            alpha = np.zeros((len(w) + 1, model.width))
            alpha[0] = 1
            for i in range(len(w)):
                for j in range(i + 1, len(w) + 1):
                    alpha[j] += alpha[i] * (model.p[row[w[i:j]]] if w[i:j] in row else 1e-7 * (j == i + 1))
            total += np.log(alpha[-1])
        assert model.languages[int(total.argmax())] == name
        assert score == pytest.approx(1 / np.exp(total - total.max()).sum())


def test_odd_rows(spark, odd, none, documents):
    rows = L.identify(odd.withColumns({"Score": F.lit(1), "f0": F.lit(7), "out0": F.lit(7), "share": F.lit(7)}), documents, PATH).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert {r.lang_pred for r in L.identify(odd, none, PATH).collect()} == {"und"}
    assert L.identify(none, documents, PATH).count() == 0
