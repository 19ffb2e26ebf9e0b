"""Reads, whitelists and records derived from the driver's tables, as DataFrames and as the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import BarcodePlace, Span
from ..operators.records import TAGS

LINKER = "ACGTTGCAAGCTTGCATC"
PLACES = [BarcodePlace(0, 11, 18, "BC:v1"), BarcodePlace(0, 37, 44, "BC:v1")]
UMI = Span(0, 45, 54)
CDNA = Span(1, 1, 40)


def dna(text: str) -> str:
    return f"translate(md5({text}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def quality(text: str) -> str:
    return f"translate(md5({text}), '0123456789abcdef', 'IIIIIIFFFF::,,##')"


def _key(letter: str, column: str = "o_orderkey") -> str:
    return f"concat('{letter}', cast({column} AS varchar(20)))"


_SEQ1 = f"""concat(substr({dna(_key('p'))}, 1, cast(10 + o_custkey % 3 - 1 AS int)),
  CASE WHEN o_orderkey % 5 = 0 THEN concat(substr(a.bc, 1, 2), 'N', substr(a.bc, 4, 5)) ELSE a.bc END, '{LINKER}',
  CASE WHEN o_orderkey % 11 = 0 THEN concat(substr(b.bc, 1, 6), 'A', substr(b.bc, 8, 1)) ELSE b.bc END,
  substr({dna(_key('u'))}, 1, 10), substr({dna(_key('t'))}, 1, 12))"""

#: Common table expressions: whitelist wl(bc), first reads rd(read_idx, seq, qual, ...), second reads r2, both in DuckDB and Spark.
BASE = f"""
wl AS (SELECT cast(p_partkey - 1 AS bigint) AS id, substr({dna(_key('w', 'p_partkey'))}, 1, 8) AS bc FROM part WHERE p_partkey BETWEEN 1 AND 96),
rd AS (SELECT o_orderkey AS read_idx, concat('r', cast(o_orderkey AS varchar(20))) AS read_name,
   concat('1:N:0:', substr({dna(_key('i'))}, 1, 6), '+', b.bc, ' length=0') AS comment, {_SEQ1} AS seq,
   concat({quality(_key('q'))}, {quality(_key('v'))}, {quality(_key('x'))}) AS q0, concat({dna(_key('c'))}, {dna(_key('d'))}) AS seq2, concat({quality(_key('y'))}, {quality(_key('z'))}) AS qual2
 FROM orders JOIN wl a ON o_orderkey % 96 = a.id JOIN wl b ON (o_orderkey * 7 + 3) % 96 = b.id),
reads AS (SELECT read_idx, read_name, comment, seq, substr(q0, 1, cast(length(seq) AS int)) AS qual, seq2, qual2 FROM rd)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """96 barcodes of 8 bases (bc, id)."""
    part = table(spark, sf_dir, "part").where("p_partkey BETWEEN 1 AND 96")
    return part.select((F.col("p_partkey") - 1).cast("long").alias("id"), F.expr(f"substr({dna(_key('w', 'p_partkey'))}, 1, 8)").alias("bc"))


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitelist(spark, sf_dir).select(F.col("bc").alias("barcode"))


#: Reads that one task derives, about.
READS_PER_TASK = 200_000


def _dealt(df: DataFrame, key: str, ordered: bool) -> DataFrame:
    """Slim rows dealt out before long ones are derived from them, whatever the file's row groups; `ordered`: by ranges of the key."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // READS_PER_TASK + 1)
    return df.repartitionByRange(parts, key) if ordered else df.repartition(parts, key)


def flat_reads(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """First and second reads of a pair side by side: read_idx, read_name, comment, seq, qual, seq2, qual2.

    ordered: partitions are ranges of read_idx, so that sorting by it takes no shuffle.
    """
    wl = F.broadcast(whitelist(spark, sf_dir))  # 96 rows
    orders = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", ordered)
    both = orders.join(wl.alias("a"), F.expr("o_orderkey % 96 = a.id")).join(wl.alias("b"), F.expr("(o_orderkey * 7 + 3) % 96 = b.id"))
    q0 = F.expr(f"concat({quality(_key('q'))}, {quality(_key('v'))}, {quality(_key('x'))})")
    rows = both.select(
        F.col("o_orderkey").alias("read_idx"),
        F.expr(_key("r")).alias("read_name"),
        F.expr(f"concat('1:N:0:', substr({dna(_key('i'))}, 1, 6), '+', b.bc, ' length=0')").alias("comment"),
        F.expr(_SEQ1).alias("seq"),
        q0.alias("q0"),
        F.expr(f"concat({dna(_key('c'))}, {dna(_key('d'))})").alias("seq2"),
        F.expr(f"concat({quality(_key('y'))}, {quality(_key('z'))})").alias("qual2"),
    )
    return rows.select("read_idx", "read_name", "comment", "seq", F.expr("substring(q0, 1, length(seq))").alias("qual"), "seq2", "qual2")


def reads(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Read tuples (read_idx, read_name, comment, seqs, quals)."""
    return flat_reads(spark, sf_dir, ordered).select("read_idx", "read_name", "comment", F.array("seq", "seq2").alias("seqs"), F.array("qual", "qual2").alias("quals"))


#: Records as other tools leave them: cb may be missing, carry a suffix, or hold an N; derived from orders alone.
RECORDS = f"""
rec AS (SELECT o_orderkey AS line, concat('r', cast(o_orderkey % 997 AS varchar(20))) AS qname, substr({dna(_key('s'))}, 1, 30) AS seq, substr({quality(_key('k'))}, 1, 30) AS qual,
   concat(substr({dna(_key('g'))}, 1, 8), '_', substr({dna(_key('h'))}, 1, 8)) AS CR,
   CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat('NNNNNNNN_', substr({dna(_key('h'))}, 1, 8)) ELSE concat(substr({dna("concat('g', cast(o_custkey % 50 AS varchar(20)))")}, 1, 8), '_', substr({dna(_key('h'))}, 1, 8)) END AS CB,
   CASE WHEN o_orderkey % 5 = 0 THEN '-1_0' ELSE concat('0_', cast(o_orderkey % 3 AS varchar(20))) END AS XM,
   CASE WHEN o_orderkey % 5 = 0 THEN 'N_*' ELSE concat('11_', cast(36 + o_orderkey % 3 AS varchar(20))) END AS XP, substr({dna(_key('m'))}, 1, 3) AS UR FROM orders)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, qname, seq, qual, CR, CB, XM, XP, UR) as in RECORDS."""
    body = RECORDS.strip().removeprefix("rec AS (SELECT").rsplit(" FROM orders)", 1)[0]
    orders = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", False)
    return orders.select(F.expr(f"struct({body})").alias("s")).select("s.*")




def tagged(df: DataFrame, names=("CR", "CB", "XM", "XP", "UR")) -> DataFrame:
    """Records with an array of tags, null ones left out."""
    tags = F.filter(F.array(*[F.struct(F.lit(n).alias("tag"), F.lit("Z").alias("type"), F.col(n).alias("value")) for n in names]), lambda t: t["value"].isNotNull()).cast(TAGS)
    zero, star = F.lit(0), F.lit("*")
    return df.select("line", "qname", F.lit(4).alias("flag"), star.alias("rname"), zero.alias("pos"), zero.alias("mapq"), star.alias("cigar"), star.alias("rnext"), zero.alias("pnext"), zero.alias("tlen"), "seq", "qual", tags.alias("tags"))
