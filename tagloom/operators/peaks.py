"""Barcode places from hits: histograms of starts, peaks, and one place for each whitelist."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GROUP = ["file_index", "file", "barcode_whitelist", "orientation"]

#: Rows of conserved regions that may be broadcast to be compared with every peak.
MAX_REGIONS = 100_000


def start_histogram(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*GROUP, "start").agg(F.count(F.lit(1)).alias("count"))


def peak_statistics(hits: DataFrame) -> DataFrame:
    """For each group and start: rows, distinct reads, their share of the group's reads, the end, and the diversity of the group."""
    # hits are dealt out and sorted by read once; a place that every read has is summed before it is shuffled
    by_read = W.partitionBy(*GROUP, "read_name").orderBy("start")
    named, before = F.col("read_name").isNotNull(), F.lag("start").over(by_read)
    slim = hits.select(*GROUP, "start", "end", "barcode", "read_name")
    flagged = slim.select(*GROUP, "start", "end", "barcode", (named & before.isNull()).cast("int").alias("__read"), (named & ~before.eqNullSafe(F.col("start"))).cast("int").alias("__here"))
    by_barcode = flagged.groupBy(*GROUP, "start", "barcode").agg(F.count(F.lit(1)).alias("count"), F.min("end").alias("end"), F.sum("__read").alias("__read"), F.sum("__here").alias("__here"))
    kind = F.col("barcode").isNotNull() & F.lag("start").over(W.partitionBy(*GROUP, "barcode").orderBy("start")).isNull()
    sums = [F.sum(c).alias(c) for c in ("count", "__read", "__here", "__kind")]
    starts = by_barcode.withColumn("__kind", kind.cast("int")).groupBy(*GROUP, "start").agg(F.min("end").alias("end"), *sums)
    whole = {c: F.sum(c).over(W.partitionBy(*GROUP)) for c in ("count", "__read", "__kind")}
    out = starts.withColumns({"__rows": whole["count"], "__reads": whole["__read"], "__kinds": whole["__kind"]})
    return out.select(
        *GROUP, "start", "end", "count", F.col("__here").alias("read_count"), F.round(F.try_divide("__here", "__reads"), 2).alias("read_fraction"), F.round(F.try_divide("__kinds", "__rows"), 4).alias("barcode_diversity")
    )


def find_peaks(hits: DataFrame, conserved: DataFrame | None = None) -> DataFrame:
    """Peaks of each group's histogram over the starts that occur.

    A start is a peak if its count is above both neighbours', those beyond the ends being zero; of a plateau that is
    above both sides the lower middle counts. A group with one start has that as its peak, counted in rows with a
    share of one. Peaks that overlap a conserved region (file_index, start, end) of their file are left out, lone
    starts excepted.
    """
    order, group = W.partitionBy(*GROUP).orderBy("start"), W.partitionBy(*GROUP)
    ranked = peak_statistics(hits).withColumns({"rank": F.row_number().over(order), "before": F.lag("count").over(order), "after": F.lead("count").over(order), "starts": F.count(F.lit(1)).over(group)})
    ranked = ranked.withColumns({"new": ~F.col("before").eqNullSafe(F.col("count")), "ends": ~F.col("after").eqNullSafe(F.col("count"))})
    ranked = ranked.withColumn("island", F.sum(F.col("new").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy(*GROUP, "island")
    edge = lambda at, level: F.max(F.when(F.col(at), F.coalesce(level, F.lit(0)))).over(island)
    peaks = ranked.withColumns({"first": F.min("rank").over(island), "last": F.max("rank").over(island), "before": edge("new", "before"), "after": edge("ends", "after")})
    peaks = peaks.where("count > before AND count > after AND rank = (first + last) div 2")
    lone = F.col("starts") == 1
    peaks = peaks.select(
        *GROUP, "start", "end", F.when(lone, F.col("count")).otherwise(F.col("read_count")).alias("read_count"), F.when(lone, F.lit(1.0)).otherwise(F.col("read_fraction")).alias("read_fraction"), "barcode_diversity", lone.alias("lone")
    )
    if conserved is None:
        return peaks.drop("lone")
    regions = conserved.select(F.col("file_index").alias("__file"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    # worked out once, as few as they may be
    found = regions.limit(MAX_REGIONS + 1).collect()
    if len(found) > MAX_REGIONS:
        raise ValueError(f"more than {MAX_REGIONS} conserved regions")
    regions = hits.sparkSession.createDataFrame(found, regions.schema)
    overlap = (F.col("__file") == F.col("file_index")) & (F.col("__start") <= F.col("end")) & (F.col("__end") >= F.col("start")) & ~F.col("lone")
    return peaks.join(F.broadcast(regions), overlap, "left_anti").drop("lone")


def select_places(peaks: DataFrame) -> DataFrame:
    """At most one peak for each whitelist: by read count, then start; one that overlaps a chosen one of its file is passed over.

    The peaks are few (a histogram's tops for each whitelist, file and strand), so one task goes through them in order.
    """
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["read_count", "start", *GROUP], ascending=[False, True, True, True, True, True], kind="stable")
        taken, seen = [], set()
        for r in rows.itertuples():
            if r.barcode_whitelist in seen or any(f == r.file_index and not (r.end < a or r.start > b) for f, a, b in taken):
                continue
            seen.add(r.barcode_whitelist)
            taken.append((r.file_index, r.start, r.end))
            yield r.Index

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[list(choose(rows))]

    wanted = peaks.select(*GROUP, "start", "end", "read_count", "read_fraction")
    return wanted.groupBy(F.lit(1).alias("__all")).applyInPandas(lambda rows: run(rows.drop(columns="__all", errors="ignore")), wanted.schema)


def histogram_bins(hits: DataFrame, width: float = 0.5) -> DataFrame:
    """Counts of starts in bins of `width`, for a plot: the group's columns, bin and count."""
    return hits.groupBy(*GROUP, (F.floor(F.col("start") / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
