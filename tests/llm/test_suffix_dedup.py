import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import queries, substring_dedup, suffix_array
from tagloom.llm.substring_dedup import remove_repeats, stretches


def brute(texts, least):
    """Covered bytes of each text, by counting every string of `least` bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + least] for r in raw for i in range(len(r) - least + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - least + 1):
            if seen[r[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append(gone)
    return raw, out


def digest(raw, gone):
    kept = bytes(b for b, g in zip(raw, gone) if not g)
    runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
    return len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def brute_suffixes(numbers, cap):
    order = sorted(range(len(numbers)), key=lambda i: numbers[i:])
    common = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and numbers[a + k] == numbers[b + k]:
            k += 1
        common.append(k)
    return order, common


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80) | st.lists(st.integers(1, 200), max_size=60), st.integers(1, 3), st.sampled_from([3, 10, 400]), st.sampled_from([0, 8, suffix_array.BASE]))
def test_suffix_array(numbers, times, cap, base):
    numbers = numbers * times + [0]
    order, common = suffix_array.suffix_array(np.array(numbers), 201, cap, base=base)
    assert (order.tolist(), common.tolist()) == brute_suffixes(numbers, cap)


@pytest.mark.parametrize("room", [1, 7, 100])
def test_a_text_far_larger_than_its_room(tmp_path, room):
    """Arrays and runs of over `room` numbers are files; the text has 1,500."""
    r = random.Random(room)
    numbers = [r.randint(1, 3) for _ in range(500)] * 3 + [0]
    order, common = suffix_array.suffix_array(np.array(numbers), 4, 400, str(tmp_path), room)
    assert (order.tolist(), common.tolist()) == brute_suffixes(numbers, 400)


@pytest.mark.parametrize("chunk", [1, 5, 64])
def test_a_scan_by_chunks(monkeypatch, chunk):
    monkeypatch.setattr(suffix_array, "CHUNK", chunk)
    r = random.Random(chunk)
    for n, top in [(300, 2), (400, 9), (60, 1)]:
        numbers = [r.randint(1, top) for _ in range(n)] * 2 + [0]
        for base in (0, suffix_array.BASE):
            order, common = suffix_array.suffix_array(np.array(numbers), 201, 50, base=base)
            assert (order.tolist(), common.tolist()) == brute_suffixes(numbers, 50)


def test_names_that_fit_memory_are_not_induced(monkeypatch):
    """Induction over so few names takes many small steps."""
    r = np.random.default_rng(3)
    part = r.integers(1, 200, 250_000)
    text = np.concatenate([part, part[1000:200_000], [0]])
    sizes = []
    induce = suffix_array.induce
    monkeypatch.setattr(suffix_array, "induce", lambda text, *a, **more: sizes.append(len(text)) or induce(text, *a, **more))
    order, common = suffix_array.suffix_array(text, 201, 400)
    assert set(sizes) == {len(text)}
    assert (np.sort(order) == np.arange(len(text))).all()
    for a, b, n in zip(order[:-1:97].tolist(), order[1::97].tolist(), common[1::97].tolist()):
        x, y = text[a : a + 401].tolist(), text[b : b + 401].tolist()
        assert x[:n] == y[:n] and (n == 400 or x[n] < y[n])


def test_memory_of_a_sorted_block():
    """Bytes at most in use for each byte of stretches: a task of op6 sorts 4 MB at a time beside another task."""
    r = random.Random(11)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(3000)]
    passages = [" ".join(r.choices(words, k=70)).encode()[:450] for _ in range(300)]
    bodies = [p[:400] + " ".join(r.choices(words, k=20)).encode()[:100] for p in passages for _ in range(4)]
    tracemalloc.start()
    found = substring_dedup.repeated_windows(bodies, [0] * len(bodies), np.repeat(np.arange(300), 4))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(f and f[0][0] == 0 and f[0][1] >= 400 for f in found)
    assert most < 50 * sum(map(len, bodies))


def test_a_block_is_no_larger_than_its_bound(spark, monkeypatch, tmp_path):
    """An anchor's stretches are not added to a block that has no room for them."""
    seen = str(tmp_path / "seen")

    def noted(bodies, offsets, groups, least, folder):
        with open(seen, "a") as f:
            f.write(f"{sum(map(len, bodies))} {len(set(groups))}\n")
        return [[(0, least)] for _ in bodies]

    monkeypatch.setattr(substring_dedup, "repeated_windows", noted)
    rows = [(h, 0, 100 * h + i, True, bytes([65 + i]) * 50) for h, n in enumerate([11, 12, 3, 4, 5, 12, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "h long, offset int, body long, lone boolean, data binary").coalesce(1)
    out = substring_dedup._sorted_spans(df, 32, 640).collect()
    assert sorted((r.h, r.body) for r in out) == sorted((r[0], r[2]) for r in rows)
    blocks = [tuple(map(int, x.split())) for x in open(seen)]
    assert blocks == [(550, 1), (600, 1), (600, 3), (600, 1), (50, 1)]


def test_anchors_are_made_once(spark):
    texts = ["".join(random.Random(i // 2).choices("abcdef ", k=600)) + str(i) for i in range(6)]
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    # what is left to do at the end is to cut the texts
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in out.collect()} == {i: [(0, 600)] for i in range(6)}


def test_queue_in_order_of_arrival(tmp_path):
    r, queue, plain = random.Random(3), suffix_array.Queue(suffix_array.Disk(str(tmp_path), 20)), []
    low = arrived = 0
    for _ in range(400):
        keys = np.sort(np.array([r.randrange(low, low + 30) for _ in range(r.randrange(8))], np.int64))
        places = np.arange(arrived, arrived + len(keys))
        arrived += len(keys)
        queue.push(keys, places, places.astype(np.int16))
        plain += zip(keys.tolist(), places.tolist())
        plain.sort(key=lambda x: x[0])
        upto = low + r.randrange(3)
        got = queue.below(upto)
        assert list(zip(got[0].tolist(), got[1].tolist())) == [x for x in plain if x[0] < upto]
        queue.drop(upto)
        plain, low = [x for x in plain if x[0] >= upto], upto


def test_every_string_is_in_one_stretch():
    data = np.frombuffer(("ab" * 300 + "some other text, quite long " * 20).encode(), np.uint8)
    s, n, o, _ = stretches(data, 40, 12)
    places = [p for a, k in zip(s.tolist(), n.tolist()) for p in range(a, a + k - 39)]
    assert places == list(range(len(data) - 39)) and ((0 <= o) & (o <= 28 + n - 40)).all()


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_small_texts_against_brute_force(spark, block):
    r = random.Random(5)
    word = lambda: r.choice(["alpha ", "be ", "gamma-", "dé ", "x"])
    passage = ["".join(word() for _ in range(40)) for _ in range(6)]
    texts = ["".join(r.choice(passage) if r.random() < 0.4 else "".join(word() for _ in range(12)) for _ in range(5)) for _ in range(60)]
    texts += [texts[3], texts[3][:-20] + "zzz", None, "", "a" * 300, "a" * 31, "ab" * 100, passage[0] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Spans", F.lit(1)).repartition(3)
    raw, gone = brute(texts, 32)
    rows = remove_repeats(df, least=32, anchor=9, block_bytes=block).collect()
    assert len(rows) == len(texts)
    for row in rows:
        flags = bytearray(row.n_bytes)
        for s in row.spans:
            flags[s.start : s.end] = b"\1" * (s.end - s.start)
        assert flags == gone[row.doc_id], row.doc_id
        assert bytes(row.kept) == bytes(b for b, g in zip(raw[row.doc_id], flags) if not g)


def test_a_frequent_anchor_is_not_gathered(spark, monkeypatch):
    r = random.Random(7)
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = noise(60)
    texts = [noise(40) + passage + noise(40) for _ in range(80)]
    texts += [texts[0][:90] + noise(50), noise(40) + texts[1][35:], texts[2]]
    taken = []
    sorted_spans = substring_dedup._sorted_spans
    monkeypatch.setattr(substring_dedup, "_sorted_spans", lambda b, *a: taken.extend(x.h for x in b.select("h").collect()) or sorted_spans(b, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw, gone = brute(texts, 32)
    for row in remove_repeats(df, least=32, anchor=9, block_bytes=640).collect():
        flags = bytearray(row.n_bytes)
        for s in row.spans:
            flags[s.start : s.end] = b"\1" * (s.end - s.start)
        assert flags == gone[row.doc_id], row.doc_id
    # 640 bytes are ten stretches of up to 64
    assert max(Counter(taken).values(), default=0) <= 10


def check_passages(texts, passages, short, gram):
    """Every string of `short` bytes that another row has holds an anchor; every passage begins with an anchor that another row has."""
    raw = [(t or "").encode() for t in texts]
    has = lambda n: Counter(x for r in raw for x in {r[i : i + n] for i in range(len(r) - n + 1)})
    strings, grams = has(short), has(gram)
    for r, found in zip(raw, passages):
        for p in range(len(r) - short + 1):
            if strings[r[p : p + short]] > 1:
                assert any(min(p + short, b) - max(p, a) >= gram for a, b in found), (r, p)
        for a, b in found:
            assert grams[r[a : a + gram]] > 1 and grams[r[b - gram : b]] > 1 and b - a >= gram, (r, a, b)


def test_shorter_passages_are_reported_and_not_removed(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz é", k=n))
    passage = [noise(40) for _ in range(5)]
    texts = [noise(30) + passage[i % 5] + noise(30) for i in range(20)] + [noise(100) for _ in range(20)]
    # in one row only; a row twice; rows of nothing
    own = noise(40)
    texts += [own + noise(9) + own, "a" * 200, texts[20], None, "", passage[0][:31]]
    rows = [*enumerate(texts), (99, "z" + noise(90)), (99, None)]
    rows.append(rows[-2])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Passages", F.lit(1)).repartition(3)
    out = remove_repeats(df, least=64, anchor=9, short=32, gram=12).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "text", "n_bytes", "spans", "kept", "passages"]
    check_passages([x.text for x in out], [[(s.start, s.end) for s in x.passages] for x in out], 32, 12)
    found = {x.doc_id: len(x.passages) for x in out if x.text}
    assert [found[i] for i in range(20)] == [1] * 20 and found[20] and found[99] and found[42] and not found[40] and not found[41]
    removed = {x.doc_id for x in out if x.spans}
    assert removed == {20, 41, 42, 99}


def test_a_passage_that_all_rows_have(spark):
    r = random.Random(4)
    noise = lambda n: "".join(r.choices("abcdefghijklmnop ", k=n))
    common = noise(60)
    texts = [noise(50) + common + noise(50) if i % 4 else noise(150) for i in range(400)]
    out = remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least=90, anchor=9, short=32, gram=12).collect()
    assert all(len(x.passages) == (x.doc_id % 4 > 0) for x in out)


def test_query_reports_passages_of_fewer_bytes_than_it_removes(spark, sf, documents):
    docs = documents.select("doc_id", "text").collect()
    words = {d.doc_id: (d.text or "").split() for d in docs}
    runs = {i: {tuple(w[j : j + 50]) for j in range(len(w) - 49)} for i, w in words.items()}
    count = Counter(x for found in runs.values() for x in found)
    planted = {i for i, found in runs.items() if any(count[x] > 1 and len(" ".join(x)) >= substring_dedup.SHORT for x in found)}
    rows = {x.doc_id: x for x in queries.op6_suffix_dedup(spark, sf).collect()}
    assert planted and all(rows[i].n_passages_shared for i in planted)
    assert any(not rows[i].n_removed for i in planted)


def test_query_against_brute_force(spark, sf, documents):
    docs = documents.select("doc_id", "text").collect()
    raw, gone = brute([d.text for d in docs], 400)
    expected = {d.doc_id: digest(a, g) for d, a, g in zip(docs, raw, gone)}
    rows = queries.op6_suffix_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected
    assert any(r.n_removed for r in rows)


def test_odd_rows(spark, odd, none):
    rows = remove_repeats(odd).collect()
    raw, gone = brute([r.text for r in rows], 400)
    assert len(rows) == odd.count()
    for r, a, g in zip(rows, raw, gone):
        assert r.n_bytes == len(a) and sum(s.end - s.start for s in r.spans) == sum(g)
    twice = spark.createDataFrame([(1, "q" + "w" * 500, "en"), (1, "q" + "w" * 500, None), (None, "e" * 450, None)], "doc_id long, text string, lang string")
    assert sorted(sum(s.end - s.start for s in r.spans) for r in remove_repeats(twice).collect()) == [450, 501, 501]
    assert remove_repeats(none).count() == 0
