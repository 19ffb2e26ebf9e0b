"""Windows, matching and the choice of a barcode, against plain Python written from the definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions import sequence as S
from tagloom.operators import extraction as E
from tagloom.operators import matching as M
from tagloom.operators import windows as V


def windows(seq, start, end, jitter):
    size, n = end - start + 1, len(seq)
    out = [(seq[p - 1 : p - 1 + size], p) for p in range(max(1, start - jitter), min(n - size + 1, start + jitter) + 1)]
    if start - jitter < 1:
        out += [("N" * c + seq[start - 1 : start - 1 + size - c], start - c - 1) for c in range(1, jitter + 1)]
    if n < start - 1 + size + jitter:
        out += [(seq[start + c - 1 : start + size - 1] + "N" * c, start + c) for c in range(1, jitter + 1)]
    return out


def distance(a, b):
    return sum(x != y for x, y in zip(a, b))


def choose(seq, start, end, barcodes, jitter, mismatches, tie):
    size = end - start + 1
    none = ("N" * size, -1, "N")
    hits = []
    for cand, pos in windows(seq, start, end, jitter):
        for b in barcodes:
            if len(cand) == size and (n := distance(cand, b)) <= mismatches:
                hits.append((n, abs(pos + 1 - start) if n and pos < 1 else abs(pos - start), b, pos))
    if not hits:
        return none
    best = min(h[:2] for h in hits)
    top = [h for h in hits if h[:2] == best]
    if len({h[2] for h in top}) > 1 or (tie == "set" and best[0] == 0 and len(top) > 1):
        return none
    places = {h[3] for h in top}
    return top[0][2], best[0], str(places.pop()) if len(places) == 1 else "*"


@pytest.fixture(scope="module")
def cases():
    r = random.Random(11)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    barcodes = sorted({dna(6) for _ in range(24)} | {"AAAAAA", "AAAAAC", "ACACAC"})
    seqs = []
    for i in range(300):
        b = list(r.choice(barcodes))
        if i % 3 == 0:
            b[r.randrange(6)] = r.choice("ACGTN")
        seqs.append((dna(r.randrange(0, 6)) + "".join(b) + dna(r.randrange(0, 9)))[: r.choice((40, 40, 7, 9))])
    return barcodes, seqs + ["ACACACACACAC", "AAAAAAAAAAAA", "A", ""]


@pytest.mark.parametrize("start", [1, 2, 3, 5])
@pytest.mark.parametrize("jitter", [0, 2])
def test_windows(spark, cases, start, jitter):
    df = spark.createDataFrame(list(enumerate(cases[1])), "i long, seq string")
    got = df.select("i", V.jitter_windows("seq", start, start + 5, jitter).alias("w")).collect()
    for r in got:
        assert [(w.cand, w.pos) for w in r.w] == windows(cases[1][r.i], start, start + 5, jitter)


@pytest.mark.parametrize("strategy", ["neighbourhood", "seed", "kmer"])
@pytest.mark.parametrize("start,tie", [(1, "set"), (3, "index"), (5, "set")])
def test_choice(spark, cases, strategy, start, tie):
    barcodes, seqs = cases
    reads = spark.createDataFrame([(i, f"r{i}", "", [s], ["I" * len(s)]) for i, s in enumerate(seqs)], "read_idx long, read_name string, comment string, seqs array<string>, quals array<string>")
    white = spark.createDataFrame([(b,) for b in barcodes], "barcode string")
    out = E.match_barcodes(reads, [E.BarcodePlace(0, start, start + 5, "w")], {"w": white}, 2, 2, strategy=strategy, tie=tie)
    rows = out.select("read_idx", F.get("matched", F.lit(0)).alias("m")).collect()
    assert len(rows) == len(seqs)
    for r in rows:
        assert tuple(r.m) == choose(seqs[r.read_idx], start, start + 5, barcodes, 2, 2, tie), seqs[r.read_idx]


def test_a_missing_whitelist_matches_nothing(spark):
    reads = spark.createDataFrame([(1, "r", "", ["ACGT"], ["IIII"])], "read_idx long, read_name string, comment string, seqs array<string>, quals array<string>")
    row = E.match_barcodes(reads, [E.BarcodePlace(0, 1, 4, "w")], {}).first()
    assert tuple(row.matched[0]) == ("NNNN", -1, "N")


def test_strategy():
    assert M.choose_strategy(384, 9, 2) == "neighbourhood" and M.choose_strategy(7_000_000, 16, 2) == "seed"
    assert M.choose_strategy(7_000_000, 16, 0) == "neighbourhood"


def test_matched_quality(spark):
    places = ["3", "1", "0", "-1", "-2", "*", "N", "6"]
    df = spark.createDataFrame([("ABCDEFG", p) for p in places], "q string, p string")
    got = [r[0] for r in df.select(E.matched_quality("q", "p", 4)).collect()]
    assert got == ["CDEF", "ABCD", "!!!!", "!ABC", "!!AB", "!!!!", "!!!!", "FG!!"]


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.reverse_complement(F.lit("AACGTN"))) == "NACGTT"
    assert get(S.hamming(F.lit("ACGT"), F.lit("AGGA"))) == 2 and get(S.hamming(F.lit("A"), F.lit("AA"))) is None
    assert get(S.hamming_common(F.lit("AC"), F.lit("ATTT"))) == 1
    assert get(S.encode_bits(F.lit("ACGTN"))) == 0b0001101100 and get(S.encode_bits(F.lit(""))) == 0
    assert get(S.kmer_of(F.lit(27), 5)) == "AACGT"
    assert get(S.mask_low_quality(F.lit("ACGT"), F.lit("I#I#"), 10)) == "ANGN"
    assert get(S.header_barcode(F.lit("1:N:0:AC+GT"), 2)) == "GT" and get(S.header_barcode(F.lit("1:N:0:AC"), 1)) is None
    assert get(S.header_tags(F.lit("@r x CB=A_B XQ==I CB=C /1"))) == {"CB": "C", "XQ": "=I"}
    assert S.parse_range("11-18") == (10, 18) and S.parse_file_range("2:1-5") == (1, 0, 5)
    with pytest.raises(ValueError):
        S.parse_file_range("0:1-5")


def test_sidecar():
    side = E.sidecar([8, 8, 8], 10)
    assert [b["range"] for b in side["barcodes"]] == ["1:1-8", "1:9-16", "1:17-24"] and side["umi"] == [{"range": "1:25-34"}]
    assert "-x 0,0,8,0,8,16,0,16,24:0,24,34:1,0,0 " in side["kallisto-bustools"][0]["kb count"]
