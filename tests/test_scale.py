"""Plans and results that must hold as the tables grow."""

import gzip
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tagloom import sources as Z
from tagloom.functions import sequence as S
from tagloom.operators import counts as C
from tagloom.operators import discovery as D
from tagloom.operators import extraction as E
from tagloom.operators import peaks as P
from tagloom.operators import records as R
from tagloom.plans import fixtures as X
from tagloom.sources.scratch import part_files

READS = "read_idx long, read_name string, comment string, seqs array<string>, quals array<string>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_are_not_shuffled_for_a_small_whitelist(spark):
    reads = spark.createDataFrame([(1, "r", "", ["TTACGTACTTGGGGCC"], ["IIII##IIIIIIIIII"])] * 2, READS)
    white = spark.createDataFrame([("ACGTAC",), ("GGGGCC",)], "barcode string")
    places = [E.BarcodePlace(0, 3, 8, "w"), E.BarcodePlace(0, 11, 16, "w"), E.BarcodePlace(0, 3, 8, "none")]
    out = E.extract(reads, places, {"w": white}, E.Span(0, 1, 4))
    assert not any(x in plan(out) for x in ("SortMergeJoin", "collect_list", "hashpartitioning(read_idx"))
    rows = out.select("CB", "XM", "XP", "mismatches", "kept").collect()
    # two rows of one ordinal stay two rows
    assert [tuple(r) for r in rows] == [("ACGTAC_GGGGCC_NNNNNN", "0_0_-1", "3_11_N", -1, False)] * 2
    masked = E.extract(reads, places[:2], {"w": white}, E.Span(0, 1, 8), base_quality=10).select("CB", "XM", "seq").first()
    assert tuple(masked) == ("NNNNNN_GGGGCC", "-1_0", "TTACNNAC")


def test_many_windows_are_laid_out_as_rows(spark):
    reads = spark.createDataFrame([(1, "r", "", ["T" * 30 + "ACGTAC" + "T" * 30], ["I" * 66])], READS)
    white = spark.createDataFrame([("ACGTAC",)], "barcode string")
    for jitter in (2, 30):
        row = E.match_barcodes(reads, [E.BarcodePlace(0, 31 if jitter == 2 else 20, 36 if jitter == 2 else 25, "w")], {"w": white}, jitter, 1).first()
        assert tuple(row.matched[0]) == ("ACGTAC", 0, "31")


def test_quality_mask_of_odd_strings(spark):
    rows = [("ACGT", "I#I"), ("AC", "#III"), ("", "II"), ("AC", ""), (None, "II"), ("AC", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, q string").select(S.mask_low_quality("s", "q", 10)).collect()]
    assert got == ["ANG", "NC", "", "", None, None]
    for t in (-40, 0, 2, 41, 120, 300):
        text = "".join(map(chr, range(1, 400, 3)))
        row = spark.createDataFrame([("A" * len(text), text)], "s string, q string").select(S.mask_low_quality("s", "q", t)).first()
        assert row[0] == "".join("A" if ord(c) - 33 >= t else "N" for c in text)


def brute_nearest(points, queries, k):
    def key(p, q):
        terms = [(a - b) * (a - b) for a, b in zip(p or [], q or []) if a is not None and b is not None]
        d = None
        for t in terms:
            d = t if d is None else d + t
        return (d is None, d is not None and math.isnan(d), 0 if d is None or math.isnan(d) else d), d

    out = []
    for i, q in queries:
        near = sorted(((key(v, q), j) for j, v in points if j is not None and j != i), key=lambda x: (x[0][0], x[1]))[:k]
        out += [(i, j, str(d), r + 1) for r, ((_, d), j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("names", [int, "n{}".format])
def test_nearest(spark, monkeypatch, names):
    r = random.Random(3)
    vector = lambda: [r.choice((0.0, 0.25, 1 / 3, 1e-9, 1e8 + 0.1)) + r.random() * r.choice((0, 1, 1e-8)) for _ in range(6)]
    points = [(names(i), vector()) for i in range(150)] + [(names(150 + i), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) for i in range(60)]
    points += [(names(300), None), (names(301), []), (names(302), [None, 0.2, 0.3, 0.4, 0.5, 0.6]), (names(303), [0.1, 0.2]), (names(304), [0.1] * 8), (names(305), [math.inf] * 6), (names(306), [math.nan] * 6), (None, [0.1] * 6)]
    monkeypatch.setattr(C, "KNN_BLOCK", 100)
    df = spark.createDataFrame(points, f"id {'long' if names is int else 'string'}, vector array<double>")
    out = C.nearest(df, df.where("id IS NOT NULL"), 4)
    assert "NestedLoopJoin" not in plan(out) and "CartesianProduct" not in plan(out)
    got = sorted((x.query, x.neighbour, str(x.distance), x.rank) for x in out.collect())
    assert got == brute_nearest(points, [p for p in points if p[0] is not None], 4)
    assert C.nearest(df, df.limit(0), 4).count() == 0


@pytest.mark.parametrize("size", [13, 100, 1 << 20])
def test_a_file_in_parts(spark, tmp_path, size):
    record = lambda i, m: f"@r{i} c/{m}\nACGT{'ACGT'[i % 4]}\n+\n@III{'#' * 1}\n"
    one, two = [], []
    for part, (a, b) in enumerate([(0, 7), (7, 7), (7, 20)]):
        one.append(tmp_path / f"1-{part}.fastq")
        one[-1].write_text("".join(record(i, 1) for i in range(a, b)).rstrip("\n"))
    for part, (a, b) in enumerate([(0, 3), (3, 19)]):
        two.append(tmp_path / f"2-{part}.fastq.gz")
        two[-1].write_bytes(gzip.compress("".join(record(i, 2) for i in range(a, b)).encode()))
    rows = Z.read_fastq(spark, [str(p) for p in one], [str(p) for p in two], range_bytes=size)
    assert sorted((r.file_index, r.read_idx, r.read_name) for r in rows.collect()) == [(f, i, f"r{i}") for f, n in ((0, 20), (1, 19)) for i in range(n)]
    pairs = sorted(Z.zip_reads(rows, 2).collect())
    assert [(r.read_idx, r.read_name, r.comment, r.seqs[1]) for r in pairs] == [(i, f"r{i}", "c/1", f"ACGT{'ACGT'[i % 4]}") for i in range(19)]
    assert Z.zip_reads(rows.where("file_index = 0"), 1).count() == 20


def test_interleaved_parts_are_read_in_one_plan(spark, tmp_path):
    record = lambda i, m: f"@r{i} CB=A{i} /{m}\nACGT\n+\nIIII\n"
    paths = [tmp_path / "a.fastq", tmp_path / "b.fastq"]
    paths[0].write_text("".join(record(i, m) for i in range(5) for m in (1, 2)))
    paths[1].write_text("".join(record(i, m) for i in range(5, 8) for m in (1, 2)) + record(8, 1))
    out = Z.read_interleaved(spark, *map(str, paths))
    assert "Exchange" not in plan(out) and "Union" not in plan(out)
    # a last read without a mate is left out
    assert [(r.read_idx, r.header, r.header2) for r in sorted(out.collect())] == [(i, f"@r{i} CB=A{i} /1", f"@r{i} CB=A{i} /2") for i in range(8)]


def test_text_of_records_is_sorted_where_it_is_made(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    records = E.extract(X.reads(spark, sf, ordered=True), X.PLACES, {"BC:v1": X.barcodes(spark, sf)}, X.CDNA, X.UMI)
    for lines in (E.sam_lines(records), E.interleaved(records)):
        shown = plan(lines.orderBy("read_idx"))
        assert "rangepartitioning(read_idx" not in shown and shown.count("rangepartitioning(") == 1
    Z.write_sam(E.sam_lines(records), str(tmp_path / "sam"), "cmd")
    text = [open(f).read().splitlines() for f in part_files(str(tmp_path / "sam"))]
    assert [x[:3] for x in text[0]] == ["@HD", "@PG"]
    numbers = [int(line.split("\t")[0][1:]) for part in text[1:] for line in part]
    assert numbers == sorted(numbers) and len(numbers) == records.count()


def test_header_tags_take_no_lambda_each(spark):
    headers = ["@r x CB=A_B XQ==I CB=C /1", "@r\tCB=  XM=1/2 XCB=no", " CB=lead/3", "@r CB", "@r XX=CB=1", "", None]
    df = spark.createDataFrame([(h,) for h in headers], "header string")
    want = [{"CB": "C", "XQ": "=I"}, {"CB": "", "XM": "1"}, {"CB": "lead"}, {}, {}, {}, None]
    rows = df.select(S.header_words("header").alias("w")).select(*[S.header_tag("w", t).alias(t) for t in ("CB", "XQ", "XM")])
    assert "lambda" not in plan(rows)
    assert [{k: v for k, v in r.asDict().items() if v is not None} for r in rows.collect()] == [w or {} for w in want]
    assert [r[0] or {} for r in df.select(S.header_tags("header")).collect()] == [w or {} for w in want]
    out = R.interleaved_to_records(df.select("header", F.lit("A").alias("r2_seq"), F.lit("I").alias("r2_qual")).limit(2))
    assert [[tuple(t) for t in r.tags] for r in out.collect()] == [[("CB", "Z", "C"), ("XQ", "Z", "=I")], [("CB", "Z", ""), ("XM", "Z", "1")]]


def scans(df):
    return plan(df).count("Scan ExistingRDD") + plan(df).count("LocalTableScan")


def test_peaks_go_through_the_hits_once(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        start = r.choice((3, 4, 4, 5, 9, 9, 10, 20))
        rows.append((0, "R1", r.choice((None, "a", "b", f"r{i}")), 50, r.choice(("w", "v")), r.choice(("AC", "GT", "TT")), r.choice(("forward", "reverse")), start, start + 1, 0))
    hits = spark.createDataFrame(rows, Z.files.HITS)
    want = {}
    for g in {(x[4], x[6]) for x in rows}:
        own = [x for x in rows if (x[4], x[6]) == g]
        reads, kinds = len({x[2] for x in own} - {None}), len({x[5] for x in own})
        for s in {x[7] for x in own}:
            here = [x for x in own if x[7] == s]
            # a read without a name is a row, but no read, as in the SQL
            named = len({x[2] for x in here} - {None})
            want[(*g, s)] = (s + 1, len(here), named, round(named / reads + 1e-12, 2), round(kinds / len(own), 4))
    found = P.peak_statistics(hits)
    assert scans(found) == 1 and "Expand" not in plan(found) and scans(P.find_peaks(hits)) == 1
    assert {(x.barcode_whitelist, x.orientation, x.start): (x.end, x["count"], x.read_count, x.read_fraction, x.barcode_diversity) for x in found.collect()} == want
    peaks = {(x.barcode_whitelist, x.orientation, x.start) for x in P.find_peaks(hits).collect()}
    for g in {k[:2] for k in want}:
        starts = sorted(k[2] for k in want if k[:2] == g)
        counts = [0, *(want[(*g, s)][1] for s in starts), 0]
        runs = [(k, len(list(v))) for k, v in itertools.groupby(counts)]
        at, tops = 0, set()
        for before, (level, n), after in zip(runs, runs[1:], runs[2:]):
            if level > before[0] and level > after[0]:
                tops.add((*g, starts[at + (n - 1) // 2]))
            at += n
        assert {p for p in peaks if p[:2] == g} == tops


def test_conserved_regions_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    hits = spark.createDataFrame([(0, "R1", "a", 50, "w", "AC", "forward", s, s + 1, 0) for s in (3, 9, 9, 12)], Z.files.HITS)
    regions = spark.createDataFrame([(0, 8, 9)], "file_index int, start int, end int").mapInArrow(count, "file_index int, start int, end int")
    assert P.find_peaks(hits, regions).count() == 0
    assert seen.value == 1


def test_base_frequencies_take_one_pass(spark):
    df = spark.createDataFrame([(0, "ACX"), (0, ""), (0, None), (0, "AG"), (1, "N"), (2, "")], "file_index int, seq string")
    out = D.base_frequencies(df)
    assert scans(out) == 1
    got = {(r.file_index, r.position): (r.A, r.C, r.G, r["T"], r.N) for r in out.collect()}
    assert got == {(0, 1): (0.5, 0, 0, 0, 0), (0, 2): (0, 0.25, 0.25, 0, 0), (0, 3): (0, 0, 0, 0, 0), (1, 1): (0, 0, 0, 0, 1)}


def test_exact_hits_try_each_window_once(spark):
    r = random.Random(9)
    reads = [(0, "R1", f"r{i}", "".join(r.choice("ACGTNa") for _ in range(r.randrange(0, 14)))) for i in range(200)] + [(0, "R1", "null", None)]
    lists = [("w", b) for b in ("ACGT", "AAC", "GTT", "NAN", "aCG", "CG")] + [("v", "ACGT"), ("v", "AAC"), ("v", "AAC")]
    rc = lambda s: s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    want = []
    for _, _, name, seq in reads[:-1]:
        for w, b in sorted(set(lists)):
            for strand, s in (("forward", seq), ("reverse", rc(seq))):
                for p in range(len(s) - len(b) + 1):
                    if s[p : p + len(b)] == b:
                        start = p + 1 if strand == "forward" else len(s) - p - len(b) + 1
                        want.append((name, len(s), w, b, strand, start, start + len(b) - 1))
    out = D.exact_hits(spark.createDataFrame(reads, "file_index int, file string, read_name string, seq string"), spark.createDataFrame(lists, "whitelist string, barcode string"))
    assert "lambda" not in plan(out) and "transform(" not in plan(out)
    assert sorted((x.read_name, x.seqlen, x.barcode_whitelist, x.barcode, x.orientation, x.start, x.end) for x in out.collect()) == sorted(want)


def test_appended_header_barcodes_by_few_and_many_names(spark, monkeypatch):
    names = [f"r{i}" for i in range(30)] + ["hot"] * 40 + [None] * 9 + ["lone"]
    records = spark.createDataFrame([(i, n, "AC", "II", "AA", "AA", "0", "1", "U") for i, n in enumerate(names)], "line long, qname string, seq string, qual string, CR string, CB string, XM string, XP string, UR string")
    raws = {**{f"r{i}": ["ACGT", "TTTT", None, "ACGA", "CCCC"][i % 5] for i in range(28)}, "hot": "ACGT", "none": "ACGT"}
    headers = spark.createDataFrame([(n, "1:N:0:1" if b is None else f"1:N:0:GG+{b}") for n, b in raws.items()], "read_name string, description string")
    white = spark.createDataFrame([("ACGT",), ("AAAA",)], "barcode string")
    # TTTT is AAAA reversed
    found = {"ACGT": ("ACGT", "0"), "TTTT": ("AAAA", "0"), "ACGA": ("ACGT", "1"), "CCCC": ("NNNN", "-1"), None: ("NN", "")}

    def shown():
        out = R.append_header_barcode(X.tagged(records), headers, 2, white, 4)
        return out, sorted((r.line, r.cb, r.xm) for r in out.select("line", R.tag("CB").alias("cb"), R.tag("XM").alias("xm")).collect())

    want = [(i, *((f"AA_{found[raws[n]][0]}", f"0_{found[raws[n]][1]}") if n in raws else ("AA", "0"))) for i, n in enumerate(names)]
    out, got = shown()
    assert got == want and "SortMergeJoin" not in plan(out)
    monkeypatch.setattr(R, "MAX_NAMES", 5)
    for most in (1000, 20, 5):
        monkeypatch.setattr(R, "RECORDS_PER_TASK", most)
        out, got = shown()
        assert got == want and "hashpartitioning(qname" in plan(out)


def test_counts_of_a_matrix_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f"c{i % 7}", f"g{i % 5}", i) for i in range(35)]
    counts = spark.createDataFrame(rows, "cell string, gene string, count long").mapInArrow(count, "cell string, gene string, count long")
    out = C.counts_to_coo(counts)
    assert sorted(tuple(r) for r in out.collect()) == sorted((int(c[1:]) + 1, int(g[1:]) + 1, n) for c, g, n in rows if n)
    assert seen.value == 35
