"""Readers and writers, on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tagloom import sources as X
from tagloom.operators import counts, extraction, peaks, records
from tagloom.streaming import stream_tag_counts


def fastq(n, mate=1):
    # a quality line may begin with @
    return "".join(f"@r{i} 1:N:0:AC+GT length=6/{mate}\nACGTN{'ACGT'[i % 4]}\n+\n@III#{'I' * 1}\n" for i in range(n))


@pytest.mark.parametrize("size", [17, 64, 1 << 20])
def test_fastq_in_ranges(spark, tmp_path, size):
    (tmp_path / "a.fastq").write_text(fastq(40))
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(fastq(30, 2))
    rows = X.read_fastq(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz"), range_bytes=size)
    got = sorted((r.file_index, r.read_idx, r.read_name, r.seq) for r in rows.collect())
    assert got == [(f, i, f"r{i}", "ACGTN" + "ACGT"[i % 4]) for f, n in ((0, 40), (1, 30)) for i in range(n)]
    pairs = X.zip_reads(rows, 2).collect()
    assert sorted(r.read_idx for r in pairs) == list(range(30)) and all(len(r.seqs) == 2 for r in pairs)
    assert X.read_fastq(spark, str(tmp_path / "a.fastq"), last=4, range_bytes=size).count() == 5


def test_bad_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="no FASTQ record"):
        X.read_fastq(spark, str(tmp_path / "a.fastq")).collect()


def test_whitelists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("ACGT\n\n TTTT \nACGT\n")
    lists = X.read_whitelists(spark, [f"BC1:v1:{tmp_path}/w.txt"])
    assert sorted(r.barcode for r in lists["BC1:v1"].collect()) == ["ACGT", "TTTT"]
    with pytest.raises(ValueError):
        X.read_whitelists(spark, ["BC1"])
    with pytest.warns(UserWarning):
        assert X.read_whitelists(spark, ["BC1"], strict=False) == {}


def test_records_there_and_back(spark, tmp_path):
    place = extraction.BarcodePlace(0, 1, 4, "w")
    reads = spark.createDataFrame([(0, "a", "length=9", ["ACGTGG", "TTTTT"], ["IIIIFF", "##III"]), (1, "b", "x/1", ["GGGGCC", "AAAAA"], ["IIIIFF", "IIIII"])], "read_idx long, read_name string, comment string, seqs array<string>, quals array<string>")
    white = spark.createDataFrame([("ACGT",)], "barcode string")
    out = extraction.extract(reads, [place], {"w": white}, extraction.Span(1, 1, 5), extraction.Span(0, 5, 6), jitter=1, mismatches=1, base_quality=10)
    X.write_sam(extraction.sam_lines(out), str(tmp_path / "sam"), "cmd")
    back = {r.qname: r for r in X.read_sam(spark, str(tmp_path / "sam")).collect()}
    assert set(back) == {"a", "b"} and back["a"].seq == "NNTTT" and back["a"].flag == 4
    assert [t.tag for t in back["a"].tags] == ["CR", "CY", "CB", "XQ", "XP", "XM", "UR", "UY"]
    assert [t.value for t in back["a"].tags][2:6] == ["ACGT", "IIII", "1", "0"] and [t.value for t in back["b"].tags][2:6] == ["NNNN", "!!!!", "N", "-1"]
    X.write_lines(extraction.interleaved(out), str(tmp_path / "fq"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "fq")).collect()]
    assert "@a length=6 CR=ACGT CY=IIII CB=ACGT XQ=IIII XP=1 XM=0 UR=GG UY=FF /1" in lines and "@b x CR=GGGG CY=IIII CB=NNNN XQ=!!!! XP=N XM=-1 UR=CC UY=FF /2" in lines
    assert records.sift_records(X.read_sam(spark, str(tmp_path / "sam"))).count() == 1
    X.write_tag_counts(counts.tag_counts(X.read_sam(spark, str(tmp_path / "sam")).select(records.tag("CB").alias("CB")), "CB"), str(tmp_path / "cb"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "cb")).collect()) == ["Index 0\tACGT\t1", "Index 0\tNNNN\t1"]


def test_tables_and_matrix(spark, tmp_path):
    (tmp_path / "p.csv").write_text("barcode_whitelist,file_index,file,orientation,start,end,read_count,read_fraction\nBC1:v1,0,R1,forward,11,18,5,0.5\nBC2:v1,0,R1,forward,49,56,4,0.4\n")
    places = X.read_places(spark, str(tmp_path / "p.csv"))
    assert [(p.start, p.size, p.whitelist) for p in places] == [(11, 8, "BC1:v1"), (49, 8, "BC2:v1")]
    assert X.read_places(spark, str(tmp_path / "p.csv"), reverse=True) == places[::-1]
    coo = spark.createDataFrame([(1, 2, 3), (2, 1, 4)], "row long, col long, val long")
    X.write_matrix_market(coo, 2, 2, str(tmp_path / "m"))
    text = [r.value for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert "2 2 2" in text and {"1 2 3", "2 1 4"} < set(text)
    (tmp_path / "c.fasta").write_text(">one\nACGT\n>two\nACGT\n>three\nGG\n")
    first = counts.first_by_sequence(X.read_fasta(spark, str(tmp_path / "c.fasta"))).collect()
    assert sorted((r.name, r.seq) for r in first) == [("one", "ACGT"), ("three", "GG")]
    side = spark.createDataFrame([(json.dumps(extraction.sidecar([8], 0)),)], "value string")
    assert counts.kb_option(side).first().x == "0,0,8:1,0,0"


def test_peaks_by_hand(spark):
    def hits(counts, kind="v1"):
        return [(0, "R1", f"{kind}{s}.{i}", 50, kind, "ACGT", "forward", s, s + 3, 0) for s, n in counts.items() for i in range(n)]

    schema = "file_index int, file string, read_name string, seqlen int, barcode_whitelist string, barcode string, orientation string, start int, end int, mismatches int"
    df = spark.createDataFrame(hits({1: 2, 2: 5, 3: 5, 4: 5, 5: 1, 20: 9, 21: 3}) + hits({7: 4}, "v2") + hits({20: 8, 30: 6, 31: 6}, "v3"), schema)
    found = sorted((r.barcode_whitelist, r.start, r.read_count, r.read_fraction) for r in peaks.find_peaks(df).collect())
    assert found == [("v1", 3, 5, 0.17), ("v1", 20, 9, 0.3), ("v2", 7, 4, 1.0), ("v3", 20, 8, 0.4)]
    masked = peaks.find_peaks(df, spark.createDataFrame([(0, 7, 8), (0, 19, 22)], "file_index int, start int, end int"))
    assert sorted((r.barcode_whitelist, r.start) for r in masked.collect()) == [("v1", 3), ("v2", 7)]
    chosen = peaks.select_places(peaks.find_peaks(df)).collect()
    assert sorted((r.barcode_whitelist, r.start) for r in chosen) == [("v1", 20), ("v2", 7)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "r{}\t4\t*\t0\t255\t*\t*\t0\t0\tAC\tII\tCB:Z:{}\n"
    (tmp_path / "in/a.sam").write_text("@HD\tVN:1.6\n" + line.format(1, "A_B") + line.format(2, "A_C"))
    query = stream_tag_counts(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("tags").start()
    query.processAllAvailable()
    (tmp_path / "in/b.sam").write_text(line.format(3, "A_B"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.idx, r.value, r["count"]) for r in spark.table("tags").collect()) == [(0, "A", 3), (1, "B", 2), (1, "C", 1)]
