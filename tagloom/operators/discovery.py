"""Finding barcodes in unknown reads: base frequencies, conserved runs, exact hits on both strands, read samples."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from .matching import _side, neighbourhood

#: Sampled ordinals are sent to all executors up to this many.
MAX_SAMPLE = 2_000_000


def base_frequencies(reads: DataFrame) -> DataFrame:
    """Rows (file_index, position, A, C, G, T, N) for reads (file_index, seq): shares of all reads of the file; places from 1."""
    # place 0 stands for the read itself, so that shares and their total come of one pass
    places = reads.select("file_index", "seq", F.explode(F.sequence(F.lit(0), F.coalesce(F.length("seq"), F.lit(0)))).alias("position"))
    bases = places.select("file_index", "position", F.when(F.col("position") > 0, F.substring("seq", F.col("position"), F.lit(1))).alias("base"))
    counts = bases.groupBy("file_index", "position").agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col("base") == b).alias(b) for b in "ACGTN"])
    total = F.max(F.when(F.col("position") == 0, F.col("__n"))).over(W.partitionBy("file_index"))
    return counts.withColumn("__total", total).where("position > 0").select("file_index", "position", *[(F.col(b) / F.col("__total")).alias(b) for b in "ACGTN"])


def conserved_runs(frequencies: DataFrame, least: float = 0.75, length: int = 10) -> DataFrame:
    """Rows (file_index, start, end, length, sequence, median_frequency): runs where one base is frequent enough.

    Of equally frequent bases the first of A, C, G, T, N counts; the median is the upper one.
    """
    top = F.greatest("A", "C", "G", "T", "N")
    base = F.when(F.col("A") == top, "A").when(F.col("C") == top, "C").when(F.col("G") == top, "G").when(F.col("T") == top, "T").otherwise("N")
    by_place = W.partitionBy("file_index").orderBy("position")
    high = frequencies.select("file_index", "position", base.alias("base"), top.alias("f")).where(F.col("f") >= least)
    runs = high.withColumn("run", F.col("position") - F.row_number().over(by_place))
    grouped = runs.groupBy("file_index", "run").agg(
        F.min("position").alias("start"),
        F.max("position").alias("end"),
        F.count(F.lit(1)).cast("int").alias("length"),
        F.sort_array(F.collect_list(F.struct("position", "base"))).alias("b"),
        F.sort_array(F.collect_list("f")).alias("fs"),
    )
    return grouped.where(F.col("length") >= length).select(
        "file_index", "start", "end", "length", F.array_join(F.transform("b", lambda x: x["base"]), "").alias("sequence"), F.get("fs", (F.col("length") / 2).cast("int")).alias("median_frequency")
    )


def exact_hits(reads: DataFrame, whitelists: DataFrame, unique_names: bool = True) -> DataFrame:
    """Hits of every whitelist (whitelist, barcode) in every window of both strands of reads (file_index, file, read_name, seq).

    Places are of the forward strand, from 1, both ends included. Whitelists may have barcodes of several lengths. A
    hit is found once, so nothing is shuffled; if names repeat within a file, `unique_names` False keeps one of equals.
    """
    counts = {r.n: r.c for r in whitelists.groupBy(F.length("barcode").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    lengths = sorted(counts)
    table = whitelists.select(F.col("whitelist").alias("barcode_whitelist"), "barcode").distinct()
    out = None
    for n in lengths:
        # a window of the reverse strand is a barcode if its own bases are that barcode's reverse complement
        strands = F.array(F.struct(F.lit("forward").alias("orientation"), F.col("barcode").alias("key")), F.struct(F.lit("reverse").alias("orientation"), reverse_complement("barcode").alias("key")))
        keys = table.where(F.length("barcode") == n).select("barcode_whitelist", "barcode", F.explode(strands).alias("o")).select("barcode_whitelist", "barcode", "o.*")
        long = reads.select("file_index", "file", "read_name", "seq", F.length("seq").alias("seqlen")).where(F.col("seqlen") >= n)
        windows = long.select("*", F.explode(F.sequence(F.lit(1), F.col("seqlen") - n + 1)).alias("start"))
        own = _side(keys, 2 * counts[n], n)
        hits = windows.join(own, F.substring("seq", F.col("start"), F.lit(n)) == F.col("key"))
        start = F.col("start")
        part = hits.select("file_index", "file", "read_name", "seqlen", "barcode_whitelist", "barcode", "orientation", start.alias("start"), (start + n - 1).alias("end"), F.lit(0).alias("mismatches"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the whitelists are empty")
    return out if unique_names else out.dropDuplicates(["file_index", "read_name", "barcode_whitelist", "orientation", "start", "barcode"])


def hit_order(hits: DataFrame) -> DataFrame:
    """`hits` with `place`, from 1: their order by start within a read's strand, then by whitelist and barcode."""
    along = W.partitionBy("file_index", "read_name", "orientation").orderBy("start", "barcode_whitelist", "barcode")
    return hits.withColumn("place", F.row_number().over(along))


def first_lookup(whitelists: DataFrame) -> DataFrame:
    """Rows (variant, barcode, n): strings at one mismatch at most, each with the first barcode (order, barcode) that has it; exact ones win."""
    near = neighbourhood(whitelists.select("barcode"), 1)
    ranked = near.join(whitelists, "barcode").groupBy("variant").agg(F.min_by(F.struct("barcode", "n"), F.struct(F.least("n", F.lit(1)), "order")).alias("f"))
    return ranked.select("variant", "f.barcode", "f.n")


def sample_ordinals(n: int, upper: int, seed: int = 1234) -> list[int]:
    """The ordinals below `upper` that Python's generator draws for this seed."""
    return random.Random(seed).sample(range(upper), min(n, upper))


def sample_reads(reads: DataFrame, n: int = 100_000, upper: int = 10_000_000, seed: int = 1234) -> DataFrame:
    """Reads whose ordinal read_idx is drawn; upper 0: as many as there are, n 0: all reads."""
    if n == 0:
        return reads
    if n > MAX_SAMPLE:
        raise ValueError(f"at most {MAX_SAMPLE} reads can be drawn")
    upper = upper or reads.agg(F.max("read_idx")).first()[0] + 1
    drawn = reads.sparkSession.createDataFrame([(i,) for i in sample_ordinals(n, upper, seed)], "read_idx long")
    return reads.join(F.broadcast(drawn), "read_idx", "left_semi")
