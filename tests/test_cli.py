"""The steps one after the other on small files."""

import random

import pytest

from tagloom import sources as X
from tagloom.cli import main


def text(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_from_reads_to_counts(spark, tmp_path):
    r = random.Random(4)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    barcodes = sorted({dna(8) for _ in range(12)})
    (tmp_path / "w.txt").write_text("\n".join(barcodes) + "\n")
    with open(tmp_path / "a.fastq", "w") as a, open(tmp_path / "b.fastq", "w") as b:
        for i in range(120):
            seq = dna(10 + (i % 7 == 0)) + barcodes[i % len(barcodes)] + dna(12)
            a.write(f"@r{i} 1:N:0:AC+{barcodes[i % 5]}\n{seq}\n+\n{'I' * len(seq)}\n")
            b.write(f"@r{i} 2:N:0\n{dna(20)}\n+\n{'F' * 20}\n")
    run = lambda *args: main([str(x) for x in args], spark)
    white = f"BC:v1:{tmp_path}/w.txt"
    files = [tmp_path / "a.fastq", tmp_path / "b.fastq"]
    run("seed", "--fastqs", *files, "--barcodes", white, "-o", tmp_path / "seed", "-n", 0)
    run("harvest", tmp_path / "seed/hits", "-o", tmp_path / "places", "-c", tmp_path / "seed/conserved")
    rows = spark.read.csv(str(tmp_path / "places"), header=True, inferSchema=True).collect()
    assert [(p.barcode_whitelist, p.file_index, p.start, p.end) for p in rows] == [("BC:v1", 0, 11, 18)]
    for kind in ("sam", "fastq"):
        run("reap", "--fastqs", *files, "--barcodes", white, "-p", tmp_path / "places", "-x", "2:1-15", "-u", "1:20-25", "-j", 1, "--format", kind, "-o", tmp_path / kind)
    records = [x for x in text(spark, tmp_path / "sam.sam") if not x.startswith("@")]
    assert len(records) == 120 and len(text(spark, tmp_path / "fastq.fastq")) == 960
    assert spark.read.csv(str(tmp_path / "sam_mismatch_stats"), header=True, inferSchema=True).where("mismatches = 0").first()["count"] == 120
    run("sift", "-i", tmp_path / "sam.sam", "-o", tmp_path / "sifted")
    assert sorted(text(spark, tmp_path / "sifted")) == sorted(records)
    run("stats", "-i", tmp_path / "sam.sam", "-o", tmp_path / "st")
    assert sum(int(x.split("\t")[2]) for x in text(spark, tmp_path / "st.CB")) == 120
    run("weed", "-f", tmp_path / "a.fastq", "-x", 2, 1, "-c", white, white, "-l", 8, 8, "-i", tmp_path / "sam.sam", "-o", tmp_path / "weeded")
    found = {x.split("\t")[0]: dict(t.split(":Z:") for t in x.split("\t")[11:])["CB"] for x in text(spark, tmp_path / "weeded")}
    assert all(found[f"r{i}"].split("_")[1] == barcodes[i % 5] for i in range(120))
    run("rake", "-s", tmp_path / "sam.sam", "-f", tmp_path / "b.fastq", "-l", 8, "-p", 3, "-o", tmp_path / "raked")
    reads = text(spark, tmp_path / "raked")
    seqs = {reads[i].split(" ")[0][1:]: reads[i + 1] for i in range(0, len(reads), 4)}
    assert all(seqs[f"r{i}"][2:10] == barcodes[i % len(barcodes)] for i in range(120))
    run("recast", "-i", tmp_path / "sam.sam", "-o", tmp_path / "recast")
    assert len(text(spark, tmp_path / "recast")) == 960
    side = X.read_sidecar(spark, str(tmp_path / "recast.json"))
    assert X.sidecar_ranges(side) == [(1, 8)] and side["umi"] == [{"range": "1:9-14"}]
    # interleaved reads: one file, as the tools write it
    reads = text(spark, tmp_path / "fastq.fastq")
    spoilt = reads[1][:2] + "N" + reads[1][3:]
    (tmp_path / "one.fastq").write_text("\n".join([reads[0], spoilt, *reads[2:]]) + "\n")
    run("json", "-i", tmp_path / "one.fastq", "-o", tmp_path / "one.json")
    assert X.read_sidecar(spark, str(tmp_path / "one.json"))["kallisto-bustools"] == side["kallisto-bustools"]
    run("sift", "-i", tmp_path / "one.fastq", "-j", tmp_path / "one.json", "-o", tmp_path / "sifted_reads")
    assert sorted(text(spark, tmp_path / "sifted_reads")) == sorted(reads[8:])
    run("stats", "-i", tmp_path / "one.fastq", "-o", tmp_path / "stf")
    for t in ("CB", "XM", "UR"):
        assert sorted(text(spark, tmp_path / f"stf.{t}")) == sorted(text(spark, tmp_path / f"st.{t}"))
    run("tally", "-i", tmp_path / "sam.sam", "-o", tmp_path / "ta")
    assert spark.read.csv(str(tmp_path / "ta.mismatches.csv"), header=True, inferSchema=True).first() == (0, 120)
    assert spark.read.csv(str(tmp_path / "ta.barcodes.csv"), header=True, inferSchema=True).agg({"Count": "sum"}).first()[0] == 120
    run("sam2fastq", "-s", tmp_path / "sam.sam", "-o", tmp_path / "old")
    old = text(spark, tmp_path / "old")
    assert len(old) == 960 and {x[-2:] for x in old[::4]} == {"/1", "/2"}
    run("store", "-b", white, "-i", "kmer", "-o", tmp_path / "ix")
    run("reap", "--fastqs", *files, "--barcodes", white, "-p", tmp_path / "places", "-x", "2:1-15", "-u", "1:20-25", "-j", 1, "-m", 2, "-i", tmp_path / "ix", "-o", tmp_path / "by_index")
    run("reap", "--fastqs", *files, "--barcodes", white, "-p", tmp_path / "places", "-x", "2:1-15", "-u", "1:20-25", "-j", 1, "-m", 2, "-o", tmp_path / "without")
    assert text(spark, tmp_path / "by_index.sam")[1:] == text(spark, tmp_path / "without.sam")[1:]


def test_index(spark, tmp_path, capsys):
    (tmp_path / "w.txt").write_text("ACGT\nACGA\nTTTT\n")
    for kind in ("seed", "kmer", "neighbourhood"):
        main(["store", "-b", f"BC:v1:{tmp_path}/w.txt", "-i", kind, "-o", str(tmp_path / kind)], spark)
        main(["inspect", "-i", str(tmp_path / kind)], spark)
        out = capsys.readouterr().out
        assert f"BC:v1: {kind}, 1 mismatches" in out and "[ACGA, ACGT, TTTT]" in out
    from tagloom.operators import index

    assert index.load_index(spark, str(tmp_path / "seed"))[3].count() == 6
    white = spark.createDataFrame([("ACGT",), ("ACGA",)], "barcode string")
    assert index.load_index(spark, str(tmp_path / "seed"), white, 0)[2] == 0
    with pytest.raises(ValueError):
        index.load_index(spark, str(tmp_path / "kmer"), None, 3)
