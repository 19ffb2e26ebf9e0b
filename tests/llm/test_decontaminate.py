import hashlib
import re

from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.decontaminate import find_contamination, split_words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=13):
    """(n_words, n_hit, sorted items) by trying every window at every place."""
    w, hit, found = words(text), set(), set()
    for item, other in items:
        o = words(other)
        for i in range(max(1, len(o) - size + 1) if o else 0):
            window = o[i : i + size]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item)
    return len(w), len(hit), sorted({str(i) for i in found if i is not None})


def test_words():
    for text in ("It's 3.5, ÀÉ naïve-x", "", None, "\x80a　b C_d"):
        assert [x.decode() for x in split_words(text)] == words(text)


def test_query_against_brute_force(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            index.setdefault(tuple(w[i : i + 13]), set()).add(item)
    hits = 0
    got = {r.doc_id: r for r in queries.op3_decontaminate(spark, sf).collect()}
    for d in documents.collect():
        w, hit, found = words(d.text), set(), set()
        for size in {len(k) for k in index}:
            for at in range(len(w) - size + 1):
                if (k := tuple(w[at : at + size])) in index:
                    hit.update(range(at, at + size))
                    found |= index[k]
        r, names = got.pop(d.doc_id), ",".join(sorted(map(str, found)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest())
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        hits += r.contaminated
    assert not got and hits


def test_small_cases_in_one_and_several_passes(spark):
    long = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {long} y"), (2, "b A"), (3, "a, B! a b"), (4, None), (5, ""), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (7, "Ü"), (7, "Ü"), (None, "a b")]
    items = [(10, long), (2, "a b"), (30, "A-b"), (4, None), (5, "..."), (None, "ü"), (7, "b"), (8, " ".join(f"w{i}" for i in range(1, 13)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Items", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted((i or 0, *brute(t, items)) for i, t in docs)
    for limit in (1 << 20, 60):
        rows = find_contamination(d, b, max_block_chars=limit).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"])) for r in rows) == expected


def test_odd_rows_and_empty_tables(spark, odd, none):
    b = spark.createDataFrame([(1, "tie tie tie"), (None, None)], "item_id long, text string")
    rows = find_contamination(odd, b).collect()
    assert len(rows) == odd.count() and sum(r.contaminated for r in rows) == 2
    assert find_contamination(none, b).count() == 0
    assert not any(r.contaminated for r in find_contamination(odd, b.limit(0)).collect())
