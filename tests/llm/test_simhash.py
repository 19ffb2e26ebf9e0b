import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.components import components
from tagloom.llm.simhash import fingerprint, grid, links, near_duplicates


NAMES = ["fp", "id", "__fp", "root", "node", "least", "nulls", "point", "f0", "out0", "__rows"]


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    """Smallest reachable node by union-find over all linked pairs."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute_groups(fps):
    """component_id by id, comparing all pairs."""
    ids = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    return roots(ids, pairs)


def test_fingerprint():
    for text in (None, "", " \n", "One", "one TWO", "a b c", "a b c d e a b c", "naïve\x1cx É  ÀB c d", "x" * 9999):
        assert fingerprint(text) == brute_fingerprint(text), text


def test_query_against_brute_force(spark, sf, documents):
    fps = {d.doc_id: brute_fingerprint(d.text) for d in documents.collect()}
    groups = brute_groups(fps)
    rows = queries.op4_simhash(spark, sf).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {i: (fps[i], groups[i]) for i in fps}
    assert len(rows) == len(fps)


@pytest.mark.parametrize("crowd", [1, 4, 32])
def test_links_connect_what_all_pairs_connect(spark, crowd):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)] + [0, (1 << 64) - 1, 1 << 63]
    words = set(base)
    for b in base:
        for _ in range(12):
            for k in r.sample(range(64), r.choice((1, 2, 3))):
                b ^= 1 << k
            words.add(b)
    signed = {w: w - (w >> 63 << 64) for w in words}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = components(links(df, crowd=crowd)).collect()
    close = [(signed[a], signed[b]) for a in words for b in words if a < b and (a ^ b).bit_count() <= 2]
    expected = roots(signed.values(), close)
    linked = {x for p in close for x in p}
    assert {g.node: g.root for g in got} == {n: expected[n] for n in linked}


def test_grid_points(spark):
    word = 0b01_11_00_10
    rows = grid(spark.createDataFrame([(word,)], "fp long")).collect()
    digits = [1, 0, 2, 1] + [0] * 28
    near = [digits] + [digits[:k] + [digits[k] + d] + digits[k + 1 :] for k in range(32) for d in (1, -1) if 0 <= digits[k] + d <= 2]
    number = lambda p: sum(d * 3**k for k, d in enumerate(p))
    assert sorted(r.point for r in rows) == sorted(map(number, near)) and {r.fp for r in rows} == {word}


def test_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_odd_rows(spark, odd, none):
    rows = near_duplicates(odd.withColumns({n: F.lit(7) for n in NAMES} | {"Fingerprint": F.lit(1)})).collect()
    assert all(r[n] == 7 for r in rows for n in NAMES)
    assert len(rows) == odd.count()
    fps = [brute_fingerprint(r.text) for r in rows]
    for r, fp in zip(rows, fps):
        assert int(r.fingerprint, 16) == fp
        near = [x.doc_id for x, other in zip(rows, fps) if other == fp]
        assert r.component_id == (None if None in near else min(near))
    assert near_duplicates(none).count() == 0
