"""Exact deduplication by a content sort, in DataFrame operations only.

Rows are dealt out by sampled splitters over the normalised text and sorted externally within each partition, which
puts equal texts side by side. Neighbours are compared in full, whole text with whole text: a run of equal texts
has a size and a largest id, and the row with that id stays. A splitter is an address, not a comparison: it holds
the text's beginning and a 64-bit hash of all of it, so the driver's sample stays small however long texts are.

A group of copies may hold most of the rows. Rows are counted first by the 64-bit hash, with partial sums before
the shuffle; a hash with over 1/(4 x partitions) of the rows is hot, so at most 4 x partitions are, and the rows of a
hot text are dealt out under salts as well, which cuts its run into several. The runs of one text are then put
together: their sizes are added up and the largest id is taken, of at most 4 x partitions texts. The count decides
where a row goes and nothing else; sizes and the rows that stay come from neighbours for all rows alike.

Defined results: null counts as the empty text; equal means identical after lower-casing A-Z only; a null id is
smaller than any other; of rows with equal text and id one is kept, which one is open as they are equal in both;
other columns are carried along whatever their names, except those named like outputs. A table without rows gives
none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import Shelf, cut, lower_ascii, quoted

OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")

#: Characters of the text's beginning in a splitter's address.
SPLITTER_CHARS = 24


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """`df` with keep_id, group_size, kept and text_sha256 (of the normalised text)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shelf = Shelf(df.columns if carry is None else carry, OUTPUTS)
    rows = df.select(*shelf.put, quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    # a carried text is dealt out once
    text = shelf.keys[shelf.names.index(text_col)] if text_col in shelf.names else "text"
    norm = lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.select(*shelf.keys, "id", *(["text"] if text == "text" else []), F.xxhash64(norm).alias("hash"))

    counts = cut(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    hot = cut(counts.where(F.col("rows") > max(1, total // (4 * n))).select("hash", F.lit(True).alias("hot")))

    salted = rows.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(1 << 20))).otherwise(F.lit(0)))
    dealt = salted.withColumn("begin", F.substring(norm, 1, SPLITTER_CHARS)).repartitionByRange(n, "begin", "hash", "salt").withColumn("norm", norm)
    run = W.partitionBy("begin", "hash", "salt", "norm")
    first = run.orderBy(F.col("id").desc_nulls_last())
    whole = first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    marked = dealt.select(
        *shelf.keys,
        "id",
        F.coalesce("hot", F.lit(False)).alias("hot"),
        F.first("id").over(whole).alias("keep_id"),
        F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(first) == 1).alias("first"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    if hot.head(1):
        # the runs of each hot text, put together; the number of these texts is bounded as said
        marked = cut(marked)
        runs = marked.where("hot AND first").groupBy("text_sha256").agg(F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
        marked = marked.join(F.broadcast(runs), "text_sha256", "left")
        marked = marked.withColumns({"keep_id": F.when(F.col("all_size").isNull(), F.col("keep_id")).otherwise(F.col("all_keep")), "group_size": F.coalesce("all_size", "group_size")})
    kept = F.col("first") & F.col("id").eqNullSafe(F.col("keep_id"))
    return marked.select(*shelf.back, "keep_id", "group_size", kept.alias("kept"), "text_sha256")
