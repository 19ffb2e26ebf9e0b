import re

import pytest
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.line_dedup import dedup_lines, document_report, passages_of, removed_units, units_of


def words_of(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text).split()


def lines_of(text):
    at, out = 0, []
    for n, line in enumerate(text.split("\n") if text else []):
        if words_of(line):
            out.append((n, at, at + len(line), " ".join(words_of(line))))
        at += len(line) + 1
    return out


def brute_passages(text, least=20):
    """By a look at every character: sentences end before white space after a full stop, and at line ends."""
    sentences, start = [], 0
    for m in re.finditer(r"(?<=[.!?])\s+|\n", text or ""):
        sentences.append((start, m.start()))
        start = m.end()
    sentences.append((start, len(text or "")))
    sentences = [(n, a, b) for n, (a, b) in enumerate(sentences) if words_of((text or "")[a:b])]
    out = []
    for k, (n, a, _) in enumerate(sentences):
        for last in range(k, len(sentences)):
            words = [w for _, x, y in sentences[k : last + 1] for w in words_of(text[x:y])]
            if len(words) >= least:
                out.append((n, a, sentences[last][2], " ".join(words)))
                break
    return out


def brute(docs, cut=lines_of, least=1):
    """Removed (id, place, start, end, first id, first place, copies) by a look at every unit in order."""
    first, count, out = {}, {}, []
    for i, text in sorted(docs, key=lambda d: d[0]):
        for n, a, b, key in cut(text):
            if len(key.split()) < least:
                continue
            count[key] = count.get(key, 0) + 1
            if key in first:
                out.append((i, n, a, b, *first[key], key))
            else:
                first[key] = (i, n)
    return sorted((*r[:6], count[r[6]]) for r in out)


def rows_of(df):
    return sorted((r.doc_id, r.unit, r.start, r.end, r.keep_id, r.keep_unit, r.copies) for r in df.collect())


def test_query_against_brute_force(spark, sf, documents):
    docs = [(d.doc_id, d.text) for d in documents.collect()]
    lines, passages = brute(docs), brute(docs, brute_passages)
    assert lines and passages
    shared = {}
    for i, t in docs:
        for *_, key in brute_passages(t):
            shared.setdefault(key, []).append(i)
    rows = {r.doc_id: r for r in queries.op7_line_dedup(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, text in docs:
        r = rows[i]
        gone = sorted({(a, b) for d, _, a, b, *_ in lines + passages if d == i})
        covered = set().union(*[range(a, b) for a, b in gone])
        assert r.n_removed == len(covered) == sum(b - a for a, b in zip(r.starts, r.ends))
        assert covered == set().union(*[range(a, b) for a, b in zip(r.starts, r.ends)]) and all(b < a for b, a in zip(r.ends, r.starts[1:]))
        assert r.n_units == len(lines_of(text)) and r.n_units_removed == sum(x[0] == i for x in lines)
        keys = [x[3] for x in brute_passages(text)]
        assert r.n_passages == len(keys) and r.n_passages_removed == sum(x[0] == i for x in passages)
        assert r.n_passages_shared == sum(len(shared[k]) > 1 for k in keys)


def test_rows_of_units(spark, documents):
    docs = [(d.doc_id, d.text) for d in documents.collect()]
    assert rows_of(removed_units(documents)) == brute(docs)


def test_small_units(spark):
    docs = [(3, "A b\nc d e\n\nx"), (1, "c D  e\na b\na b"), (2, ""), (4, None), (5, "\ta b \n"), (6, "naïve ü 🙂\nnaïve ü 🙂")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for least in (1, 2, 3):
        assert rows_of(removed_units(df, min_words=least)) == brute(docs, least=least)
    kept = {r.doc_id: r.deduplicated for r in dedup_lines(df.withColumn("Unit", F.lit(1)), min_words=2).collect()}
    assert kept == {1: "c D  e\na b", 2: "", 3: "\nx", 4: None, 5: "", 6: "naïve ü 🙂"}


def test_passage_inside_lines(spark):
    passage = "One two three four five. Six seven eight nine ten eleven. Twelve thirteen fourteen fifteen. Sixteen seventeen eighteen nineteen twenty."
    docs = [(1, f"Before it. {passage} After it."), (2, f"Other words here! {passage} And others."), (3, "Nothing of it.")]
    rows = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), passage_words=20).collect()}
    assert rows[1].deduplicated == docs[0][1] and rows[3].deduplicated == docs[2][1]
    assert rows[2].deduplicated == "Other words here!  And others."


def test_cuts():
    text = "one\ntwo\n\nthree four\n \n\nfive"
    assert [text[a:b] for _, a, b, _, _ in units_of(text, "paragraph")] == ["one\ntwo", "three four", "five"]
    text = "A b. C d!\nE f g? H. " * 3
    assert [(p, a, b) for p, a, b, *_ in passages_of(text, 5)] == [(p, a, b) for p, a, b, _ in brute_passages(text, 5)]
    assert passages_of("a b c", 4) == [] and passages_of(None) == []


def test_rows_that_share_an_id(spark):
    docs = [(2, "keep me first\nsame line here"), (2, "unique a\nunique line b"), (3, "same line here"), (3, "same line here")]
    kept = sorted(r.deduplicated for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == ["", "", "keep me first\nsame line here", "unique a\nunique line b"]


@pytest.mark.parametrize("least", [1, 20])
def test_odd_rows(spark, odd, none, least):
    assert removed_units(none, min_words=least).count() == document_report(none).count() == 0
    rows = removed_units(odd, min_words=least).collect()
    if least == 1:
        # a null id comes first
        assert {(r.doc_id, r.keep_id) for r in rows if r.words == 3 and r.copies == 4} == {(9, None), (10, None)}
    names = ["id", "hash", "k1", "K2", "level", "place", "first", "copies", "id2", "spans", "f0", "out0", "__rows"]
    out = dedup_lines(odd.withColumns({n: F.lit(7) for n in names}))
    assert out.count() == odd.count()
    assert all(r[n] == 7 for r in out.collect() for n in names if n != "spans")
