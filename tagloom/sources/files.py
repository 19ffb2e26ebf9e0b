"""Whitelists, records as text, and the tables that the steps exchange."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import parse_file_range
from ..operators.extraction import BarcodePlace

HITS = "file_index int, file string, read_name string, seqlen int, barcode_whitelist string, barcode string, orientation string, start int, end int, mismatches int"
CONSERVED = "file_index int, start int, end int, length int, sequence string, median_frequency double"
PLACES = "barcode_whitelist string, file_index int, file string, orientation string, start int, end int, read_count long, read_fraction double"
FREQUENCIES = "read string, position int, A double, C double, G double, T double, N double"

#: Columns of an alignment record.
FIXED = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_NUMBERS = ("flag", "pos", "mapq", "pnext", "tlen")


def whitelist_argument(text: str) -> tuple[str, str]:
    """`NAME:LABEL:FILE` as (`NAME:LABEL`, file)."""
    parts = text.split(":", 2)
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"not NAME:LABEL:FILE: {text!r}")
    return ":".join(parts[:2]), parts[2]


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct barcodes of a file of one a line, blanks left out."""
    out = spark.read.text(path).select(F.trim("value").alias("barcode")).where("barcode <> ''").distinct()
    if out.isEmpty():
        warnings.warn(f"{path} has no barcodes", stacklevel=2)
    return out


def read_whitelists(spark: SparkSession, arguments: list[str], strict: bool = True) -> dict[str, DataFrame]:
    """Whitelists by `NAME:LABEL`; bad arguments are an error, or left out with a warning if not strict."""
    out = {}
    for text in arguments:
        try:
            name, path = whitelist_argument(text)
        except ValueError:
            if strict:
                raise
            warnings.warn(f"left out: {text!r}", stacklevel=2)
            continue
        out[name] = read_whitelist(spark, path)
    return out


def parse_sam(lines: DataFrame) -> DataFrame:
    """Records of SAM lines (value); header lines begin with `@` and a two-letter type."""
    rows = lines.where(~F.col("value").rlike(r"^@[A-Za-z]{2}(\t|$)") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    fixed = [(F.get("f", F.lit(i)).cast("int") if n in _NUMBERS else F.get("f", F.lit(i))).alias(n) for i, n in enumerate(FIXED)]
    tags = F.transform(F.slice("f", 12, 2**20), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), F.substr(t, F.lit(6)).alias("value")))
    return rows.select(*fixed, tags.alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def read_hits(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.csv(list(paths), schema=HITS, sep="\t", header=True)


def read_conserved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=CONSERVED, sep="\t", header=True)


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=FREQUENCIES, sep="\t", header=True)


def read_places(spark: SparkSession, path: str, reverse: bool = False) -> list[BarcodePlace]:
    """Barcode places (a row a barcode) in the file's order, or in reverse."""
    rows = spark.read.csv(path, schema=PLACES, header=True).coalesce(1).collect()  # a row a barcode of a read
    out = [BarcodePlace(r.file_index, r.start, r.end, r.barcode_whitelist, r.orientation) for r in rows]
    return out[::-1] if reverse else out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, seq) of a file of two lines a record; a small file, read whole by one task."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value"))
    pairs = lines.groupBy(F.expr("at div 2").alias("line")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("at") % 2 == 1, F.col("value"))).alias("seq"))
    return pairs.where("name LIKE '>%'").select(F.col("line").cast("int").alias("line"), F.substr("name", F.lit(2)).alias("name"), "seq")


def write_lines(lines: DataFrame, path: str, order: str | None = "read_idx", compression: str | None = None) -> None:
    """Text files of `value` (which may span lines), sorted over all files by `order`."""
    rows = lines.orderBy(order) if order else lines
    writer = rows.select("value").write.mode("errorifexists")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_sam(lines: DataFrame, path: str, command: str = "", version: str = "0") -> None:
    """Records with the two header lines in a file that sorts before the others."""
    header = lines.sparkSession.createDataFrame([(f"@HD\tVN:1.6\n@PG\tID:tagloom\tPN:tagloom\tVN:{version}\tCL:{command}",)], "value string").coalesce(1)
    # a union keeps its inputs' order, so the records are sorted by themselves, and not at all if they are in order
    write_lines(header.union(lines.orderBy("read_idx").select("value")), path, order=None)


def write_csv(df: DataFrame, path: str, sep: str = ",", order: list | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("errorifexists").csv(path, header=True, sep=sep)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The description of interleaved reads, a small JSON file."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def sidecar_ranges(side: dict) -> list[tuple[int, int]]:
    """Barcode ranges of a description: places from 1, both ends included."""
    return [(start + 1, end) for _, start, end in (parse_file_range(b["range"]) for b in side["barcodes"])]


def write_sidecar(spark: SparkSession, side: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_tag_counts(counts: DataFrame, path: str) -> None:
    """Lines `Index i<tab>value<tab>count`, or `value<tab>count` for counts without an index."""
    keys = ["idx", "value"] if "idx" in counts.columns else ["value"]
    first = [F.concat(F.lit("Index "), F.col("idx").cast("string"))] if "idx" in keys else []
    counts.orderBy(*keys).select(F.concat_ws("\t", *first, "value", F.col("count").cast("string")).alias("value")).write.mode("errorifexists").text(path)


def write_matrix_market(coo: DataFrame, rows: int, columns: int, path: str) -> None:
    spark = coo.sparkSession
    head = spark.createDataFrame([(-2, 0, "%%MatrixMarket matrix coordinate integer general"), (-1, 0, f"{rows} {columns} {coo.count()}")], "row long, col long, value string")
    entry = F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("val").cast("string"))
    body = coo.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), entry.alias("value"))
    # dealt out by row and column, so that the files have the entries in order and no task has all
    head.unionByName(body).orderBy("row", "col").select("value").write.mode("errorifexists").text(path)


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Entries (row, col, val); the line of sizes is the first of the first file that is no comment, and is left out."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("%"))).select(F.split("value", " ").alias("f"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    size = lines.agg(F.min_by("at", F.struct("file", "at")).alias("size"))
    rows = lines.join(F.broadcast(size), F.col("at") != F.col("size"))  # one row
    return rows.select(*[F.get("f", F.lit(i)).cast("long").alias(n) for i, n in enumerate(("row", "col", "val"))])
