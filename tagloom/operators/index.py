"""Stored whitelist indices: seeds, k-mers or the neighbourhood as Parquet, with a row that says how they were made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .matching import kmer_index, neighbourhood, seed_index

KINDS = ("seed", "kmer", "neighbourhood")


def build_index(whitelist: DataFrame, kind: str = "seed", mismatches: int = 1) -> DataFrame:
    """Index rows of every barcode length of `whitelist` (barcode), with a column `len`."""
    if kind not in KINDS:
        raise ValueError(f"an index is one of {', '.join(KINDS)}")
    if mismatches < 0:
        raise ValueError("mismatches must not be negative")
    barcodes = whitelist.select("barcode").distinct()
    if kind == "neighbourhood":
        return neighbourhood(barcodes, mismatches).withColumn("len", F.length("barcode"))
    lengths = sorted(r.n for r in barcodes.select(F.length("barcode").alias("n")).distinct().collect())
    if kind == "kmer" and len(lengths) > 1:
        raise ValueError("a k-mer index needs barcodes of one length")
    make = seed_index if kind == "seed" else kmer_index
    out = None
    for n in lengths:
        part = make(barcodes, n, mismatches).withColumn("len", F.lit(n))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the whitelist is empty")
    return out


def save_index(whitelist: DataFrame, name: str, path: str, kind: str = "seed", mismatches: int = 1, force: bool = False) -> None:
    """Write the index and its description below `path`; one that is there stays unless forced."""
    spark = whitelist.sparkSession
    if not force and _description(spark, path) is not None:
        return
    build_index(whitelist, kind, mismatches).write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(name, kind, mismatches)], "whitelist string, kind string, mismatches int").write.mode("overwrite").json(f"{path}/description")


def _description(spark: SparkSession, path: str):
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("whitelist string, kind string, mismatches int").json(f"{path}/description").first()
    except AnalysisException:
        return None


def load_index(spark: SparkSession, path: str, whitelist: DataFrame | None = None, mismatches: int | None = None) -> tuple[str, str, int, DataFrame]:
    """(whitelist name, kind, mismatches, rows); made anew from `whitelist` if other mismatches are asked for."""
    found = _description(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    if mismatches is not None and mismatches != found.mismatches:
        if whitelist is None:
            raise ValueError(f"{path} is for {found.mismatches} mismatches")
        save_index(whitelist, found.whitelist, path, found.kind, mismatches, force=True)
        found = _description(spark, path)
    return found.whitelist, found.kind, found.mismatches, spark.read.parquet(f"{path}/rows")


def preview_index(rows: DataFrame, examples: int = 3) -> DataFrame:
    """Of each barcode length the first barcodes and the first keys (seeds, k-mers or variants), as arrays."""
    key = next(c for c in ("seed", "kmer", "variant") if c in rows.columns)
    first = None
    for name in ("barcode", key):
        ranked = rows.select("len", F.col(name).alias("x")).distinct().withColumn("r", F.row_number().over(W.partitionBy("len").orderBy("x"))).where(F.col("r") <= examples)
        part = ranked.groupBy("len").agg(F.sort_array(F.collect_list("x")).alias("barcodes" if name == "barcode" else "keys"))
        first = part if first is None else first.join(part, "len")
    return first


def summarise_index(rows: DataFrame) -> DataFrame:
    """Barcodes and index rows by barcode length."""
    return rows.groupBy("len").agg(F.count_distinct("barcode").alias("barcodes"), F.count(F.lit(1)).alias("rows"))
