"""Filters, joins and reshaping of tagged records.

Records are rows (qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags), tags an array of
(tag, type, value) in the order of the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import RECORD_TAGS, STATS_TAGS, header_barcode, header_tag, header_words, repeat_char
from .matching import approximate_matches, distance, resolve
from .windows import jitter_windows

TAGS = "array<struct<tag:string,type:string,value:string>>"


def tag(name: str, tags="tags") -> Column:
    """Value of the record's first tag of this name; null if it has none."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.get(tags, F.array_position(tags["tag"], F.lit(name)).cast("int") - 1)["value"]


def set_tag(tags, name: str, value) -> Column:
    """`tags` with the tag's value replaced where it stands, or the tag added at the end."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    own = F.struct(F.lit(name).alias("tag"), F.lit("Z").alias("type"), value.alias("value"))
    there = F.exists(tags, lambda t: t["tag"] == name)
    return F.when(there, F.transform(tags, lambda t: F.when(t["tag"] == name, own).otherwise(t))).otherwise(F.concat(tags, F.array(own)))


def set_tags(tags, values: dict[str, Column]) -> Column:
    """As set_tag() for several tags (name: value) in one pass over `tags`; `values` in the order in which new ones are added."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    new = F.array(*[F.struct(F.lit(n).alias("tag"), F.lit("Z").alias("type"), v.alias("value")) for n, v in values.items()])

    def put(new):
        there = F.transform(tags, lambda t: t["tag"])
        own = F.map_from_entries(F.transform(new, lambda t: F.struct(t["tag"], t["value"])))
        old = F.transform(tags, lambda t: F.when(F.array_contains(F.array(*map(F.lit, values)), t["tag"]), F.struct(t["tag"].alias("tag"), F.lit("Z").alias("type"), F.element_at(own, t["tag"]).alias("value"))).otherwise(t))
        return F.concat(old, F.filter(new, lambda t: ~F.array_contains(there, t["tag"])))

    # a lambda's variable, so that the new values are worked out once
    return F.get(F.transform(F.array(new), put), F.lit(0))


def sift_records(records: DataFrame) -> DataFrame:
    """Records whose CB has no N; records without a CB stay."""
    return records.where(~F.contains(F.coalesce(tag("CB"), F.lit("")), F.lit("N")))


def sift_reads(pairs: DataFrame, ranges: list[tuple[int, int]], compat: bool = False) -> DataFrame:
    """Interleaved pairs whose first sequence has no N in any range (from 1, both ends included).

    compat: ranges are shifted by one place to the right, for results as of older tools.
    """
    bad = F.lit(False)
    for a, b in ranges:
        part = F.substring("r1_seq", a + 1, b - a + 1) if compat else F.substring("r1_seq", a, b - a + 1)
        bad = bad | F.contains(part, F.lit("N"))
    return pairs.where(~bad)


#: Names that may be broadcast; with more, records and headers are dealt out by name, about so many records to a task.
MAX_NAMES = 100_000
RECORDS_PER_TASK = 200_000


def _names(records: DataFrame) -> tuple[int, DataFrame | None, list]:
    """The number of records, their distinct names (__name) if these are few, and the names that alone fill a task, if they are not."""
    names = records.groupBy(F.col("qname").alias("__name")).agg(F.count(F.lit(1)).alias("__n"))
    total, kinds, most = names.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1)), F.max("__n")).first()
    if kinds <= MAX_NAMES:
        return total, names.select("__name"), []
    return total, None, [r[0] for r in names.where(F.col("__n") > RECORDS_PER_TASK).collect()] if most > RECORDS_PER_TASK else []


def _with_headers(records: DataFrame, own: DataFrame, total: int, few: bool, hot: list) -> DataFrame:
    """`records` with the columns of their header, if any, by name."""
    same = F.col("qname") == F.col("read_name")
    if few:
        return records.join(F.broadcast(own), same, "left")
    parts = max(records.sparkSession.sparkContext.defaultParallelism, total // RECORDS_PER_TASK + 1)
    dealt = lambda df: df.repartition(parts, "qname").join(own.repartition(parts, "read_name"), same, "left")
    if not hot:
        return dealt(records)
    often = F.coalesce(F.col("qname").isin([h for h in hot if h is not None]), F.lit(None in hot))
    of_hot = own.where(F.col("read_name").isin([h for h in hot if h is not None]))
    return dealt(records.where(~often)).unionByName(records.where(often).join(F.broadcast(of_hot), same, "left"))


def append_header_barcode(records: DataFrame, headers: DataFrame, index: int, whitelist: DataFrame, size: int, mismatches: int = 1, jitter: int = 1) -> DataFrame:
    """Records with a barcode of the read's header appended, joined by `_`, to CR, XQ, CY, CB, XM and XP.

    `headers` is (read_name, description) with unique names; records without a header stay as they are. The barcode
    is matched forward from place 1, then reversed if that gives none. Without a barcode in the header the raw value
    is empty, the match `NN` and the mismatches empty.
    """
    from ..functions.sequence import reverse_complement

    # the match joins the slim header first, so that records meet one table, by names, and not one more by a few raw values
    total, few, hot = _names(records)
    named = headers.select("read_name", "description")
    if few is not None:
        named = named.join(F.broadcast(few), F.col("read_name") == F.col("__name"), "left_semi")
    raw = named.select("read_name", header_barcode("description", index).alias("raw"))
    kinds = raw.where("raw IS NOT NULL").select("raw").distinct()
    strands = F.array(F.struct(F.lit(0).alias("strand"), F.col("raw").alias("s")), F.struct(F.lit(1).alias("strand"), reverse_complement("raw").alias("s")))
    windows = kinds.select("raw", F.explode(strands).alias("o")).select("raw", "o.strand", F.explode(jitter_windows(F.col("o.s"), 1, size, jitter)).alias("w")).select("raw", "strand", "w.*")
    hits = approximate_matches(windows, whitelist, size, mismatches)
    hits = hits.select("raw", "strand", F.struct("n", distance(F.col("pos"), 1, F.col("n")).alias("dist"), "barcode", "pos").alias("hit"))
    lists = hits.groupBy("raw").agg(F.collect_list(F.when(F.col("strand") == 0, F.col("hit"))).alias("f"), F.collect_list(F.when(F.col("strand") == 1, F.col("hit"))).alias("r"))
    forward, reverse = resolve(F.col("f"), size), resolve(F.col("r"), size)
    matched = lists.select(F.col("raw").alias("__raw"), F.when(F.contains(forward["barcode"], F.lit("NN")), reverse).otherwise(forward).alias("m"))
    matched = F.broadcast(matched) if kinds.count() <= MAX_NAMES else matched
    # headers without a barcode stay out of the join, where they would all be of one task
    own = raw.where("raw IS NOT NULL").join(matched, F.col("raw") == F.col("__raw"), "left").drop("__raw")
    own = own.unionByName(raw.where("raw IS NULL"), allowMissingColumns=True).withColumn("__there", F.lit(True))
    out = _with_headers(records, own, total, few is not None, hot)
    value = F.coalesce(F.col("raw"), F.lit(""))
    quality = repeat_char("!", F.length(value))
    barcode = F.when(F.col("raw").isNull(), F.lit("NN")).otherwise(F.coalesce("m.barcode", F.lit("N" * size)))
    number = F.when(F.col("raw").isNull(), F.lit("")).otherwise(F.coalesce("m.n", F.lit(-1)).cast("string"))
    more = {"CR": value, "CY": quality, "XQ": quality, "CB": barcode, "XM": number, "XP": F.lit("0")}
    tags = set_tags("tags", {n: F.concat(F.coalesce(tag(n), F.lit("")), F.lit("_"), v) for n, v in more.items()})
    return out.withColumn("tags", F.when(F.col("__there"), tags).otherwise(F.col("tags"))).drop("read_name", "raw", "m", "__there")


def append_header_barcodes(records: DataFrame, headers: DataFrame, barcodes: list[tuple[int, DataFrame, int]], mismatches: int = 1, jitter: int = 1) -> DataFrame:
    """append_header_barcode() for several (index, whitelist, size) in turn."""
    for index, whitelist, size in barcodes:
        records = append_header_barcode(records, headers, index, whitelist, size, mismatches, jitter)
    return records


def unique_headers(headers: DataFrame) -> DataFrame:
    """`headers`, or an error if a read's name occurs twice: a record would be multiplied."""
    if not headers.groupBy("read_name").count().where("count > 1").isEmpty():
        raise ValueError("a read's name occurs twice")
    return headers


def inject_barcodes(reads: DataFrame, records: DataFrame, place: int = 1, size: int = 16) -> DataFrame:
    """Reads (read_name, seq, ...) with the CB of the last record of that name written over place..place+size-1.

    Only barcodes of the given size that are not all N count, and only reads that are long enough change; qualities
    stay as they are. `records` is (line, qname, cb), line their order.
    """
    if place < 1:
        raise ValueError("places count from 1")
    valid = records.where((F.length("cb") == size) & (F.translate("cb", "N", "") != ""))
    last = valid.groupBy("qname").agg(F.max_by("cb", "line").alias("__cb"))
    joined = reads.join(last, reads["read_name"] == last["qname"], "left").drop("qname")
    fits = F.col("__cb").isNotNull() & (F.length("seq") >= place - 1 + size)
    changed = F.concat(F.substring("seq", 1, place - 1), F.col("__cb"), F.expr(f"substring(seq, {place + size})"))
    return joined.withColumn("seq", F.when(fits, changed).otherwise(F.col("seq"))).drop("__cb")


def records_to_interleaved(records: DataFrame) -> DataFrame:
    """Pairs (read_name, tags_text, r1_seq, r1_qual, r2_seq, r2_qual) of tagged records; missing qualities become F."""
    cb, ur = F.regexp_replace(F.coalesce(tag("CB"), F.lit("")), "_", ""), F.coalesce(tag("UR"), F.lit(""))
    cq = F.coalesce(F.regexp_replace(tag("XQ"), "_", ""), repeat_char("F", F.length(cb)))
    uq = F.coalesce(tag("UY"), repeat_char("F", F.length(ur)))
    names = F.array_join(F.transform("tags", lambda t: F.concat(t["tag"], F.lit("="), t["value"])), " ")
    return records.select(F.col("qname").alias("read_name"), names.alias("tags_text"), F.concat(cb, ur).alias("r1_seq"), F.concat(cq, uq).alias("r1_qual"), F.col("seq").alias("r2_seq"), F.col("qual").alias("r2_qual"))


def records_to_plain_interleaved(records: DataFrame) -> DataFrame:
    """Rows (value) of the older form: headers `@name/1` and `@name/2` without tags, qualities of CY, parts of CB joined by commas."""
    bare = lambda t: F.replace(tag(t), F.lit(","), F.lit(""))
    cb, ur = F.coalesce(bare("CB"), F.lit("")), F.coalesce(tag("UR"), F.lit(""))
    cq = F.coalesce(bare("CY"), repeat_char("F", F.length(cb)))
    uq = F.when(ur == "", F.lit("")).otherwise(F.coalesce(bare("UY"), repeat_char("F", F.length(ur))))
    mate = lambda n, seq, qual: F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname"), F.lit(f"/{n}")), seq, F.lit("+"), qual)
    return records.select("qname", F.concat_ws("\n", mate(1, F.concat(cb, ur), F.concat(cq, uq)), mate(2, F.col("seq"), F.col("qual"))).alias("value"))


def sidecar_lengths(records: DataFrame) -> tuple[list[int], int]:
    """Lengths of the parts (at `_`) of the first record's CB that has one, and of the first UR; 0 without any. `records` is (line, CB, UR)."""
    row = records.agg(F.min_by("CB", F.when(F.coalesce("CB", F.lit("")) != "", F.col("line"))).alias("cb"), F.min_by("UR", F.when(F.coalesce("UR", F.lit("")) != "", F.col("line"))).alias("ur")).first()
    return [len(x) for x in (row.cb or "").split("_") if x], len(row.ur or "")


def header_records(pairs: DataFrame, names=STATS_TAGS) -> DataFrame:
    """The known tags of interleaved pairs' first headers, a column each; values as they stand."""
    rows = pairs.select("read_idx", header_words("header").alias("__words"))
    return rows.select("read_idx", *[header_tag("__words", n, strip_suffix=False).alias(n) for n in names])


def interleaved_to_records(pairs: DataFrame) -> DataFrame:
    """Unmapped records of interleaved pairs (header, r2_seq, r2_qual): the header's known tags become the record's."""
    rows = pairs.select("header", "r2_seq", "r2_qual", header_words("header").alias("__words"))
    own = rows.select("*", *[header_tag("__words", t).alias(f"__{t}") for t in RECORD_TAGS])
    tags = F.array_compact(F.array(*[F.when(F.col(f"__{t}").isNotNull(), F.struct(F.lit(t).alias("tag"), F.lit("Z").alias("type"), F.col(f"__{t}").alias("value"))) for t in RECORD_TAGS])).cast(TAGS)
    name = F.expr("substring(split(header, '\\\\s+', 2)[0], 2)")
    zero = F.lit(0)
    return own.select(name.alias("qname"), F.lit(4).alias("flag"), F.lit("*").alias("rname"), zero.alias("pos"), zero.alias("mapq"), F.lit("*").alias("cigar"), F.lit("*").alias("rnext"), zero.alias("pnext"), zero.alias("tlen"), F.col("r2_seq").alias("seq"), F.col("r2_qual").alias("qual"), tags.alias("tags"))


def last_by_name(records: DataFrame, name: str = "qname", order: str = "line") -> DataFrame:
    """The last row of each name."""
    return records.withColumn("__rank", F.row_number().over(W.partitionBy(name).orderBy(F.desc(order)))).where("__rank = 1").drop("__rank")
