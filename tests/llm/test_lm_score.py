import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.lm_score import ORDER, score_texts


def brute(texts, order=ORDER, least=2, backoff=0.4):
    """(words, score) of each text, a word at a time."""
    found = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in found for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, found))

    def score(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else math.log(backoff) + score(gram[1:])

    return [(len(w), sum(score(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for w in found]


def same(rows, expected):
    assert len(rows) == len(expected)
    for r, (n, s) in zip(rows, expected):
        assert r.n_words == n and r.mean_score == pytest.approx(s / max(1, n), rel=1e-9, abs=1e-9)


def test_query_against_brute_force(spark, sf, documents):
    docs = documents.orderBy("doc_id").collect()
    same(sorted(queries.op5_lm_score(spark, sf).collect(), key=lambda r: r.doc_id), brute([d.text for d in docs]))


@pytest.mark.parametrize("order, block, least", [(1, 40, 2), (2, 40, 3), (3, 40, 2), (5, 1 << 20, 1)])
def test_odd_rows(spark, odd, none, order, block, least):
    names = ["block", "gram", "text_", "count", "f0", "N", "__text", "__block"]
    rows = score_texts(odd.unionByName(odd).withColumns({n: F.lit(7) for n in names}), order=order, block_bytes=block, table_bytes=1000, least=least).collect()
    same(rows, brute([r.text for r in rows], order, least))
    assert all(r[n] == 7 for r in rows for n in names)
    assert all(r.log_score == r.mean_score == 0 for r in rows if not r.n_words)
    assert score_texts(none).count() == 0


def test_texts_that_occur_twice_are_told_apart(spark, sf, documents):
    docs = {d.doc_id: d.text or "" for d in documents.collect()}
    count = Counter(docs.values())
    rows = queries.op5_lm_score(spark, sf).collect()
    long = [r for r in rows if r.n_words >= 50]
    twice = [r.mean_score for r in long if count[docs[r.doc_id]] > 1]
    once = sorted(r.mean_score for r in long if count[docs[r.doc_id]] == 1)
    assert twice and min(twice) > once[len(once) // 2]
