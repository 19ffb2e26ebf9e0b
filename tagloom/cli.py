"""Command line: python -m tagloom.cli COMMAND ... runs one step on files that all executors can read."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sources as X
from .functions.sequence import STATS_TAGS
from .operators import counts, discovery, extraction, index, peaks, records

COMMANDS = {}


def command(*arguments):
    """Register a step with its arguments (names, options)."""

    def add(f):
        COMMANDS[f.__name__] = (f, arguments)
        return f

    return add


def _span(text: str) -> extraction.Span:
    from .functions.sequence import parse_file_range

    file, start, end = parse_file_range(text)
    return extraction.Span(file, start + 1, end)


def _not_negative(text: str) -> int:
    if (n := int(text)) < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


FASTQS = (["--fastqs"], {"nargs": "+", "required": True})
BARCODES = (["--barcodes"], {"nargs": "+", "required": True, "help": "NAME:LABEL:FILE"})
OUT = (["-o", "--out"], {"required": True})


@command(FASTQS, BARCODES, OUT, (["-n", "--sample"], {"type": _not_negative, "default": 100_000}), (["-u", "--upper"], {"type": _not_negative, "default": 10_000_000}), (["-r", "--seed"], {"type": int, "default": 1234}), (["-l", "--least"], {"type": float, "default": 0.75}), (["-m", "--length"], {"type": _not_negative, "default": 10}))
def seed(spark, a):
    """Exact barcode hits, base frequencies and conserved runs of sampled reads."""
    if not 0 <= a.least <= 1:
        raise ValueError("a frequency lies between 0 and 1")
    lists = X.read_whitelists(spark, a.barcodes, strict=False)
    if not lists:
        raise ValueError("no whitelist could be read")
    white = None
    for name, df in lists.items():
        part = df.withColumn("whitelist", F.lit(name))
        white = part if white is None else white.unionByName(part)
    reads = discovery.sample_reads(X.read_fastq(spark, *a.fastqs), a.sample, a.upper, a.seed)
    X.write_csv(discovery.exact_hits(reads, white), f"{a.out}/hits", "\t", ["file_index", "read_name", "orientation", "start", "barcode"])
    frequencies = discovery.base_frequencies(reads)
    shown = frequencies.select(F.concat(F.lit("file"), F.col("file_index").cast("string")).alias("read"), "position", *[F.format_string("%.4f", b).alias(b) for b in "ACGTN"])
    X.write_csv(shown, f"{a.out}/frequencies", "\t", ["read", "position"])
    runs = discovery.conserved_runs(frequencies, a.least, a.length).withColumn("median_frequency", F.format_string("%.4f", "median_frequency"))
    X.write_csv(runs, f"{a.out}/conserved", "\t", ["file_index", "start"])


@command((["hits"], {"nargs": "+"}), OUT, (["-c", "--conserved"], {}))
def harvest(spark, a):
    """Barcode places from hits."""
    conserved = X.read_conserved(spark, a.conserved) if a.conserved else None
    chosen = peaks.select_places(peaks.find_peaks(X.read_hits(spark, *a.hits), conserved))
    columns = ["barcode_whitelist", "file_index", "file", "orientation", "start", "end", "read_count", "read_fraction"]
    X.write_csv(chosen.select(*columns), a.out, order=[F.desc("read_count"), "start"])


@command(
    FASTQS, BARCODES, OUT, (["-p", "--positions"], {"required": True}), (["-x", "--extract"], {"required": True, "help": "FILE:a-b, from 1"}), (["-u", "--umi"], {}), (["-j", "--jitter"], {"type": _not_negative, "default": 2}),
    (["-m", "--mismatches"], {"type": _not_negative, "default": 1}), (["-q", "--base_quality"], {"type": int}), (["--format"], {"choices": ["sam", "fastq"], "default": "sam"}), (["-r", "--reverse"], {"action": "store_true"}), (["-z", "--gzip"], {"action": "store_true"}),
    (["-s", "--sift"], {"action": "store_true"}), (["--preset"], {"choices": sorted(extraction.PRESETS)}), (["-i", "--index"], {"nargs": "+", "default": [], "help": "stored indices; made anew for other mismatches"}),
)
def reap(spark, a):
    """Match, correct and extract reads; statistics are of all reads, sifted or not."""
    places = X.read_places(spark, a.positions, a.reverse)
    umi = _span(a.umi) if a.umi else None
    reads = X.zip_reads(X.read_fastq(spark, *a.fastqs), len(a.fastqs))
    lists = X.read_whitelists(spark, a.barcodes)
    mismatches = extraction.PRESETS[a.preset][1] if a.preset else a.mismatches
    indices = {}
    for path in a.index:
        name = index.load_index(spark, path)[0]
        _, kind, _, rows = index.load_index(spark, path, lists.get(name), mismatches)
        indices[name] = (kind, rows)
    out = extraction.extract(reads, places, lists, _span(a.extract), umi, a.jitter, a.mismatches, a.base_quality, a.preset, indices=indices).persist()
    X.write_csv(extraction.mismatch_counts(out), f"{a.out}_mismatch_stats", order=["mismatches"])
    X.write_csv(extraction.position_counts(out), f"{a.out}_position_stats", order=["position"])
    kept = out.where("kept") if a.sift else out
    if a.format == "sam":
        X.write_sam(extraction.sam_lines(kept), f"{a.out}.sam")
    else:
        X.write_lines(extraction.interleaved(kept), f"{a.out}.fastq", compression="gzip" if a.gzip else None)
        side = extraction.sidecar([p.size for p in places], umi.end - umi.start + 1 if umi else 0, [p.whitelist for p in places])
        X.write_sidecar(spark, side, f"{a.out}.json")
    out.unpersist()


def _record_lines(df):
    """Records (as read) as lines, in no order."""
    tags = F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"]))
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns if c != "tags"], F.array_join(tags, "\t")).alias("value"))


def _is_fastq(path: str) -> bool:
    return path.removesuffix(".gz").endswith((".fastq", ".fq"))


def _pair_lines(pairs):
    """Interleaved pairs (as read) as eight lines each."""
    mates = [F.concat_ws("\n", f"header{n}", f"r{n}_seq", F.lit("+"), f"r{n}_qual") for n in (1, 2)]
    return pairs.withColumnRenamed("header", "header1").select("read_idx", F.concat_ws("\n", *mates).alias("value"))


@command((["-i", "--input"], {"required": True}), OUT, (["-j", "--json"], {"help": "description of interleaved reads"}))
def sift(spark, a):
    """Records without an N in their barcodes; or interleaved reads, by the ranges of their description."""
    if _is_fastq(a.input):
        if not a.json:
            raise ValueError("interleaved reads need their description (-j)")
        side = X.read_sidecar(spark, a.json)
        X.write_lines(_pair_lines(records.sift_reads(X.read_interleaved(spark, a.input), X.sidecar_ranges(side))), a.out)
        return
    X.write_lines(_record_lines(records.sift_records(X.read_sam(spark, a.input))), a.out, order=None)


@command((["-f", "--fastq"], {"required": True}), (["-x", "--index"], {"type": int, "nargs": "+", "required": True}), (["-c", "--barcode"], {"nargs": "+", "required": True}), (["-l", "--length"], {"type": int, "nargs": "+", "required": True}), (["-i", "--input"], {"required": True}), OUT, (["-m", "--mismatches"], {"type": _not_negative, "default": 1}), (["-j", "--jitter"], {"type": _not_negative, "default": 1}))
def weed(spark, a):
    """Append barcodes of the reads' headers to the records, in the order given."""
    if not len(a.index) == len(a.barcode) == len(a.length):
        raise ValueError("as many indices as whitelists and lengths")
    barcodes = [(i, X.read_whitelist(spark, X.whitelist_argument(b)[1]), n) for i, b, n in zip(a.index, a.barcode, a.length)]
    headers = records.unique_headers(X.read_fastq(spark, a.fastq).select("read_name", F.col("comment").alias("description")))
    out = records.append_header_barcodes(X.read_sam(spark, a.input), headers, barcodes, a.mismatches, a.jitter)
    X.write_lines(_record_lines(out), a.out, order=None)


@command((["-s", "--sam"], {"required": True}), (["-f", "--fastq"], {"required": True}), OUT, (["-p", "--position"], {"type": int, "default": 1}), (["-l", "--length"], {"type": int, "default": 16}))
def rake(spark, a):
    """Write the records' corrected barcodes into reads."""
    found = X.read_sam(spark, a.sam).withColumn("line", F.monotonically_increasing_id()).select("line", "qname", records.tag("CB").alias("cb"))
    out = records.inject_barcodes(X.read_fastq(spark, a.fastq), found, a.position, a.length)
    header = F.concat_ws(" ", F.concat(F.lit("@"), F.col("read_name")), F.when(F.col("comment") != "", F.col("comment")))
    X.write_lines(out.select("read_idx", F.concat_ws("\n", header, "seq", F.lit("+"), "qual").alias("value")), a.out, compression="gzip")


def _tagged(spark, path):
    """The tags that are counted, a column each, of records or interleaved reads."""
    if _is_fastq(path):
        return records.header_records(X.read_interleaved(spark, path))
    return X.read_sam(spark, path).select(*[records.tag(t).alias(t) for t in STATS_TAGS])


@command((["-i", "--input"], {"required": True}), OUT)
def tally(spark, a):
    """Tables of mismatches, places, barcodes and their combinations."""
    rows = _tagged(spark, a.input).persist()
    for suffix, df in counts.tally_tables(rows).items():
        X.write_csv(df, f"{a.out}.{suffix}.csv", order=df.columns)
    counts.tally_summary(rows).show()
    rows.unpersist()


@command((["-i", "--input"], {"required": True}), OUT)
def stats(spark, a):
    """Counts of the values of CR, CB, XP, XM and UR, of records or of interleaved reads (whose UR is one value)."""
    fastq = _is_fastq(a.input)
    rows = _tagged(spark, a.input).persist()
    for t in STATS_TAGS:
        X.write_tag_counts(counts.tag_counts(rows, t, split=not (fastq and t == "UR")), f"{a.out}.{t}")
    for t in ("CR", "CB"):
        X.write_tag_counts(counts.value_counts(rows, t), f"{a.out}.{t}_combined")
    rows.unpersist()


@command((["-i", "--input"], {"required": True}), OUT)
def recast(spark, a):
    """Records to interleaved reads, or (from .fastq) interleaved reads to records."""
    if _is_fastq(a.input):
        X.write_lines(_record_lines(records.interleaved_to_records(X.read_interleaved(spark, a.input))), a.out, order=None)
        return
    pairs = records.records_to_interleaved(X.read_sam(spark, a.input))

    def mate(n):
        return F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("@"), F.col("read_name")), "tags_text", F.lit(f"/{n}")), f"r{n}_seq", F.lit("+"), f"r{n}_qual")

    X.write_lines(pairs.select(F.concat_ws("\n", mate(1), mate(2)).alias("value")), a.out, order=None)
    _describe(spark, X.read_sam(spark, a.input), f"{a.out}.json")


def _describe(spark, sam, path):
    """The description of the reads that these records make."""
    rows = sam.select(F.monotonically_increasing_id().alias("line"), records.tag("CB").alias("CB"), records.tag("UR").alias("UR"))
    X.write_sidecar(spark, extraction.sidecar(*records.sidecar_lengths(rows)), path)


@command((["-s", "--sam"], {"required": True}), OUT)
def sam2fastq(spark, a):
    """Records to interleaved reads of the older form, with their description."""
    sam = X.read_sam(spark, a.sam)
    X.write_lines(records.records_to_plain_interleaved(sam).select("value"), a.out, order=None)
    _describe(spark, sam, f"{a.out}.json")


@command((["-i", "--input"], {"required": True}), OUT)
def describe(spark, a):
    """The description (JSON) of interleaved reads, from the tags of the first one; also called `json`."""
    first = records.header_records(X.read_interleaved(spark, a.input).orderBy("read_idx").limit(1)).withColumnRenamed("read_idx", "line")
    X.write_sidecar(spark, extraction.sidecar(*records.sidecar_lengths(first)), a.out)


COMMANDS["json"] = COMMANDS["describe"]


@command((["-b", "--barcode"], {"required": True}), OUT, (["-i", "--index"], {"choices": index.KINDS, "default": "seed"}), (["-m", "--mismatches"], {"type": _not_negative, "default": 1}), (["-f", "--force"], {"action": "store_true"}))
def store(spark, a):
    """Build and store a whitelist's index."""
    ((name, white),) = X.read_whitelists(spark, [a.barcode]).items()
    index.save_index(white, name, a.out, a.index, a.mismatches, a.force)


@command((["-i", "--input"], {"required": True}))
def inspect(spark, a):
    """Summary of a stored index."""
    name, kind, mismatches, rows = index.load_index(spark, a.input)
    print(f"{name}: {kind}, {mismatches} mismatches")
    index.summarise_index(rows).show()
    index.preview_index(rows).show(truncate=False)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tagloom", description=__doc__)
    steps = parser.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        step = steps.add_parser(name, help=f.__doc__)
        for names, options in arguments:
            step.add_argument(*names, **options)
    a = parser.parse_args(argv)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("tagloom").getOrCreate(), a)


if __name__ == "__main__":
    main()
