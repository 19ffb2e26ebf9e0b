"""Counts and statistics over tagged records, and tables for what comes after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .neighbours import best_of, pack_vectors

#: Cells on the query side of the nearest-neighbour search that are compared with all others at a time.
KNN_BLOCK = 2_000

#: Drawn cells that may be broadcast; more are joined by a shuffle.
MAX_CELLS = 1_000_000


def _counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def tag_counts(records: DataFrame, tag: str, split: bool = True) -> DataFrame:
    """Rows (idx, value, count) over the `_`-separated parts of a tag, or over the whole value at index 0."""
    rows = records.where(F.col(tag).isNotNull())
    parts = F.posexplode(F.split(tag, "_")) if split else F.posexplode(F.array(tag))
    return _counted(rows.select(parts.alias("idx", "value")), "idx", "value")


def value_counts(records: DataFrame, tag: str) -> DataFrame:
    return _counted(records.where(F.col(tag).isNotNull()).select(F.col(tag).alias("value")), "value")


def tally_mismatches(records: DataFrame) -> DataFrame:
    """Single mismatch numbers and how often they occur; what is no number counts under null."""
    return _counted(records.where("XM IS NOT NULL").select(F.explode(F.transform(F.split("XM", "_"), lambda x: x.try_cast("int"))).alias("mismatches")), "mismatches")


def tally_positions(records: DataFrame) -> DataFrame:
    """Places by barcode index; `N` and `*` count under null."""
    return _counted(records.where("XP IS NOT NULL").select(F.posexplode(F.transform(F.split("XP", "_"), lambda x: x.try_cast("int"))).alias("idx", "position")), "idx", "position")


def tally_summary(records: DataFrame) -> DataFrame:
    """One row: reads, valid ones (with a CB without N), perfect ones (no mismatch at all), barcode combinations."""
    total = F.aggregate(F.transform(F.split("XM", "_"), lambda x: x.try_cast("int")), F.lit(0), lambda s, x: s + x)
    return records.agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(F.col("CB").isNotNull() & ~F.contains("CB", F.lit("N"))).alias("valid"),
        F.count_if(total == 0).alias("perfect"),
        F.count_distinct("CB").alias("combinations"),
    )


def tally_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a tally of records (CB, XM, XP), by the suffix of their files; indices count from 1."""
    shown = lambda df, **names: df.select(*[F.col(c).alias(n) for c, n in names.items()])
    one = lambda df: df.withColumn("idx", F.col("idx") + 1)
    whole = records.where("CB IS NOT NULL")
    return {
        "mismatches": shown(tally_mismatches(records), mismatches="BarcodeMismatches", count="Count"),
        "positions": shown(one(tally_positions(records)), idx="Index", position="Position", count="Count"),
        "barcodes": shown(one(tag_counts(whole, "CB")), idx="Index", value="Barcode", count="Count"),
        "barcode.combinations": shown(value_counts(whole, "CB"), value="BarcodeCombination", count="Count"),
    }


def barcode_tally(lines: DataFrame) -> DataFrame:
    """Counts of the barcode combinations named `CB=` in header lines (value)."""
    found = F.regexp_extract("value", r"CB=([\w_]+)", 1)
    return _counted(lines.select(found.alias("CB")).where("CB <> ''"), "CB")


def valid_total(mismatch_counts: DataFrame) -> DataFrame:
    return mismatch_counts.where("mismatches >= 0").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("valid"))


def missing_barcodes(records: DataFrame) -> DataFrame:
    """One row: reads without CB, and those whose CB without its `-n` suffix is not CR."""
    plain = F.regexp_replace("CB", r"-\d+$", "")
    return records.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("CB").isNull()).alias("missing_cb"), F.count_if(plain != F.col("CR")).alias("corrected"))


def umi_counts(records: DataFrame) -> DataFrame:
    """Distinct UMIs by (cell, gene)."""
    return records.groupBy("cell", "gene").agg(F.count_distinct("umi").alias("count"))


def wide_counts(counts: DataFrame, cells: list[str]) -> DataFrame:
    """Counts as a matrix: a row a gene, a column for each of the named cells."""
    return counts.groupBy("gene").pivot("cell", cells).agg(F.sum("count")).na.fill(0)


def counts_to_coo(counts: DataFrame) -> DataFrame:
    """Coordinates (row, col, val) of the transposed matrix, from 1: cells and genes in the order of their names.

    Names are numbered by sampled ranges and counts by range, so no task sees all of them. The counts are worked out
    once and stored (see sources/scratch.py), as numbering reads them several times.
    """
    counts = stored(counts.select("cell", "gene", "count"), "counts")
    cells, genes = number_names(counts, "cell"), number_names(counts, "gene")
    return counts.where("count <> 0").join(cells, "cell").join(genes, "gene").select(F.col("cell_no").alias("row"), F.col("gene_no").alias("col"), F.col("count").alias("val"))


def number_names(df: DataFrame, name: str, buckets: int = 256) -> DataFrame:
    """Distinct values of a column with their place in order, from 1 (`<name>_no`).

    The values are ranked within ranges of their own; the ranges' sizes, at most `buckets` numbers, are added up.
    """
    names = df.select(name).distinct().where(F.col(name).isNotNull())
    edges = sorted(r[0] for r in names.select(name).orderBy(F.xxhash64(name)).limit(buckets - 1).collect())
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(name))) if edges else F.lit(0)
    ranged = names.withColumn("__bucket", bucket)
    sizes = ranged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.broadcast(sizes.select("__bucket", (F.sum("__n").over(W.orderBy("__bucket")) - F.col("__n")).alias("__before")))
    rank = F.row_number().over(W.partitionBy("__bucket").orderBy(name))
    return ranged.withColumn("__rank", rank).join(before, "__bucket").select(name, (F.col("__before") + F.col("__rank")).cast("long").alias(f"{name}_no"))


def filter_totals(counts: DataFrame, least: int = 100) -> DataFrame:
    """Counts of the genes and of the cells whose totals are at least `least`, both over all counts."""
    genes = counts.groupBy("gene").agg(F.sum("count").alias("t")).where(F.col("t") >= least).select("gene")
    cells = counts.groupBy("cell").agg(F.sum("count").alias("t")).where(F.col("t") >= least).select("cell")
    return counts.join(genes, "gene", "left_semi").join(cells, "cell", "left_semi")


def common_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    return a.select(name).intersect(b.select(name))


def reads_of_cells(records: DataFrame, others: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """Rows of `others` whose read belongs to one of n cells of `records` (qname, CB), chosen by a hash of the barcode."""
    cells = records.select("CB").where("CB IS NOT NULL").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "CB")), "CB").limit(n)
    names = records.join(F.broadcast(cells) if n <= MAX_CELLS else cells, "CB", "left_semi").select("qname")
    return others.join(names, "qname", "left_semi")


def nearest(points: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k nearest points (squared Euclidean distance, then id) of each query, itself excepted: (query, neighbour, distance, rank).

    All pairs are compared (see neighbours.py), in tiles of bounded size: queries are sent to all executors in blocks,
    and each task passes on its own best k of a query. Vectors are compared over the entries that both have; a pair
    without any has a null distance and comes last. Rows without an id are left out.
    """
    id_type = points.schema[id_col].dataType
    parts = points.sparkSession.sparkContext.defaultParallelism
    own = points.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).repartition(parts, "id")
    schema = T.StructType([T.StructField("query", id_type), T.StructField("neighbour", id_type), T.StructField("distance", T.DoubleType())])
    found, block = None, []

    def search(block):
        sent = points.sparkSession.sparkContext.broadcast(([i for i, _ in block], pack_vectors([v for _, v in block])))
        near = own.mapInArrow(lambda batches: best_of(batches, *sent.value, k), schema)
        by_query = W.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
        return near.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)

    for row in queries.where(F.col(id_col).isNotNull()).select(id_col, F.col(vector_col).cast("array<double>")).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == KNN_BLOCK:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block:
        found = search(block) if found is None else found.unionByName(search(block))
    if found is None:
        return points.sparkSession.createDataFrame([], T.StructType([*schema, T.StructField("rank", T.IntegerType())]))
    return found.select("query", "neighbour", "distance", "rank")


def reads_without_barcode(reads: DataFrame, records: DataFrame) -> DataFrame:
    """`reads` (read_name, ...) whose record (qname, CB) has no CB."""
    missing = records.where("CB IS NULL").select(F.col("qname").alias("read_name"))
    return reads.join(missing, "read_name", "left_semi")


def first_by_sequence(named: DataFrame) -> DataFrame:
    """The first row (line) of each distinct sequence: (line, name, seq)."""
    return named.groupBy("seq").agg(F.min_by(F.struct("line", "name"), "line").alias("f")).select("f.line", "f.name", "seq")


def kb_option(sidecars: DataFrame) -> DataFrame:
    """The `-x` option in the sidecar's command text (value: JSON)."""
    command = F.get_json_object("value", "$['kallisto-bustools'][0]['kb count']")
    return sidecars.select(F.regexp_extract(command, r"-x ([^ ]+)", 1).alias("x"))
