"""Correction and extraction: from raw reads and barcode places to one corrected record a read.

Reads are rows (read_idx, read_name, comment, seqs, quals), the arrays by file. Where the whitelists' neighbourhoods
fit all executors, each window of a read is looked up in them in turn and nothing is shuffled. Otherwise the reads are
dealt out by read_idx once; windows, matches and the final assembly all keep that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import mask_low_quality, repeat_char, reverse_complement
from .matching import approximate_matches, choose_strategy, distance, fits_neighbourhood, lookup_table, resolve, resolve_windows
from .windows import jitter_windows, window_list

#: Jitter and mismatches of the two kits that have a preset.
PRESETS = {"scale_rna": (1, 2), "evercode_wtv2": (2, 2)}


#: Windows of a read, over all its places, that are looked up one after the other; more are laid out as rows.
MAX_LOOKUPS = 48


@dataclass(frozen=True)
class BarcodePlace:
    """Where a barcode is expected: file counts from 0, start and end from 1, both included."""

    file: int
    start: int
    end: int
    whitelist: str
    orientation: str = "forward"

    @property
    def size(self) -> int:
        return self.end - self.start + 1


@dataclass(frozen=True)
class Span:
    """Part of a read: file from 0, start and end from 1, both included."""

    file: int
    start: int
    end: int


def _read(part: str, file: int) -> Column:
    return F.get(F.col(part), F.lit(file))


def _strand(place: BarcodePlace) -> Column:
    seq = _read("__seqs", place.file)
    return reverse_complement(seq) if place.orientation == "reverse" else seq


def _place_windows(index: int, place: BarcodePlace, jitter: int) -> Column:
    """Array of (bc_idx, start, cand, pos): the windows of one barcode place."""
    windows = jitter_windows(_strand(place), place.start, place.end, jitter)
    return F.transform(windows, lambda w: F.struct(F.lit(index).alias("bc_idx"), F.lit(place.start).alias("start"), w["cand"].alias("cand"), w["pos"].alias("pos")))


def _lookups(reads: DataFrame, places: list[BarcodePlace], tables: dict[tuple[str, int], DataFrame], jitter: int, base_quality: int | None, tie: str) -> DataFrame:
    """`reads` with `matched`, by a broadcast join for each window; rows keep their place and their partition."""
    strands = list(dict.fromkeys((p.file, p.orientation) for p in places))

    def strand(file: int, orientation: str) -> Column:
        seq = _read("seqs", file)
        seq = seq if base_quality is None else mask_low_quality(seq, _read("quals", file), base_quality)
        return reverse_complement(seq) if orientation == "reverse" else seq

    own = [F.col(c) for c in reads.columns]
    out = reads.select(*own, *[strand(*k).alias(f"__s{i}") for i, k in enumerate(strands)])
    sequences, found = [F.col(f"__s{i}") for i in range(len(strands))], []
    for i, p in enumerate(places):
        table = tables.get((p.whitelist, p.size))
        if table is not None:
            windows = window_list(sequences[strands.index((p.file, p.orientation))], p.start, p.end, jitter)
            for k, (cand, _) in enumerate(windows):
                one = F.broadcast(table.select(F.col("variant").alias(f"__v{k}"), F.col("hit").alias(f"__h{k}")))  # counted by fits_neighbourhood()
                out = out.join(one, cand == F.col(f"__v{k}"), "left")
            hits = [(F.col(f"__h{k}"), pos) for k, (_, pos) in enumerate(windows)]
            out = out.select(*own, *sequences, *found, *[c.alias(f"__{n}{i}") for n, c in resolve_windows(hits, p.start, tie).items()])
            good = F.col(f"__good{i}")
            m = {"barcode": F.when(good, F.col(f"__barcode{i}")).otherwise("N" * p.size), "n": F.when(good, F.col(f"__n{i}")).otherwise(-1), "pos": F.when(good, F.col(f"__pos{i}")).otherwise("N")}
        else:
            m = {"barcode": F.lit("N" * p.size), "n": F.lit(-1), "pos": F.lit("N")}
        out = out.select(*own, *sequences, *found, F.struct(*[c.alias(n) for n, c in m.items()]).alias(f"__m{i}"))
        found.append(F.col(f"__m{i}"))
    return out.select(*own, F.array(*found).alias("matched"))


def match_barcodes(
    reads: DataFrame,
    places: list[BarcodePlace],
    whitelists: dict[str, DataFrame],
    jitter: int = 2,
    mismatches: int = 1,
    base_quality: int | None = None,
    strategy: str | None = None,
    tie: str = "set",
    indices: dict[str, tuple[str, DataFrame]] | None = None,
) -> DataFrame:
    """`reads` with `matched`, an array of (barcode, n, pos) by place.

    A reverse place is searched on the reverse complement of the whole read, at the coordinates as they stand.
    A whitelist that is not given leaves its places without a match; one with a stored index (kind, rows) is matched
    through that.
    """
    kinds = list({(p.whitelist, p.size): None for p in places if p.whitelist in whitelists})
    lookups = sum(len(window_list(F.lit(""), p.start, p.end, jitter)) for p in places if p.whitelist in whitelists)
    if strategy in (None, "neighbourhood") and lookups <= MAX_LOOKUPS and not any(w in (indices or {}) for w, _ in kinds):
        sizes = {w: whitelists[w].count() for w in {w: None for w, _ in kinds}}
        if all(fits_neighbourhood(sizes[w], n, mismatches) and choose_strategy(sizes[w], n, mismatches) == "neighbourhood" for w, n in kinds):
            tables = {(w, n): lookup_table(whitelists[w], n, mismatches) for w, n in kinds}
            return _lookups(reads, places, tables, jitter, base_quality, tie)
    reads = reads.repartition("read_idx")
    masked = F.col("seqs") if base_quality is None else F.transform(F.arrays_zip("seqs", "quals"), lambda p: mask_low_quality(p["seqs"], p["quals"], base_quality))
    source = reads.select("read_idx", masked.alias("__seqs"))
    hits = None
    for name, size in {(p.whitelist, p.size): None for p in places}:
        if name not in whitelists:
            continue
        own = [(i, p) for i, p in enumerate(places) if (p.whitelist, p.size) == (name, size)]
        parts = [_place_windows(i, p, jitter) for i, p in own]
        windows = source.select("read_idx", F.explode(F.concat(*parts)).alias("w")).select("read_idx", "w.*")
        found = approximate_matches(windows, whitelists[name], size, mismatches, strategy, index=(indices or {}).get(name))
        found = found.select("read_idx", "bc_idx", F.struct("n", distance(F.col("pos"), F.col("start"), F.col("n")).alias("dist"), "barcode", "pos").alias("hit"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return reads.withColumn("matched", F.array(*[F.struct(F.lit("N" * p.size).alias("barcode"), F.lit(-1).alias("n"), F.lit("N").alias("pos")) for p in places]))
    grouped = hits.groupBy("read_idx").agg(F.collect_list(F.struct("bc_idx", "hit")).alias("__hits"))
    joined = reads.join(grouped, "read_idx", "left")

    def one(i: int, p: BarcodePlace) -> Column:
        own = F.transform(F.filter(F.coalesce("__hits", F.array().cast("array<struct<bc_idx:int,hit:struct<n:int,dist:int,barcode:string,pos:int>>>")), lambda h: h["bc_idx"] == i), lambda h: h["hit"])
        return resolve(own, p.size, tie)

    return joined.withColumn("matched", F.array(*[one(i, p) for i, p in enumerate(places)])).drop("__hits")


def matched_quality(qual, pos, size) -> Column:
    """Qualities of the matched window: `!` for what lies outside the read, and all `!` without a place."""
    qual = F.col(qual) if isinstance(qual, str) else qual
    pos = F.col(pos) if isinstance(pos, str) else pos
    size = F.lit(size) if isinstance(size, int) else size
    p = pos.try_cast("int")
    inside = F.rpad(F.substring(qual, F.greatest(p, F.lit(1)), size), size, F.lit("!"))
    before = F.concat(repeat_char("!", F.least(-p, size)), F.substring(qual, F.lit(1), F.greatest(size + p, F.lit(0))))
    return F.when(p.isNull() | (p == 0), repeat_char("!", size)).when(p > 0, inside).otherwise(before)


def mismatch_sum(numbers: list[Column]) -> Column:
    """As mismatch_total(), for numbers that are columns of their own."""
    negative = reduce(or_, [n < 0 for n in numbers])
    return F.when(negative, reduce(add, [F.least(n, F.lit(0)) for n in numbers])).otherwise(reduce(add, numbers))


def mismatch_total(numbers) -> Column:
    """Sum of a read's mismatches; with any unmatched barcode the sum of the negatives only."""
    numbers = F.col(numbers) if isinstance(numbers, str) else numbers
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    negative = F.filter(numbers, lambda x: x < 0)
    return F.when(F.size(negative) > 0, add(negative)).otherwise(add(numbers))


def extract_records(matched: DataFrame, places: list[BarcodePlace], extract: Span, umi: Span | None = None, base_quality: int | None = None) -> DataFrame:
    """Corrected records: read_idx, read_name, comment, seq, qual, CR, CY, CB, XQ, XP, XM, (UR, UY), mismatches, kept.

    Barcodes are joined by `_` in the order of `places`; `kept` is false if a matched barcode has an N.
    """
    cut = lambda part, s: F.substring(_read(part, s.file), s.start, s.end - s.start + 1)
    spans = [Span(p.file, p.start, p.end) for p in places]
    found = [F.get("matched", F.lit(i)) for i in range(len(places))]
    seq = cut("seqs", extract)
    columns = {
        "seq": seq if base_quality is None else mask_low_quality(seq, cut("quals", extract), base_quality),
        "qual": cut("quals", extract),
        "CR": F.concat_ws("_", *[cut("seqs", s) for s in spans]),
        "CY": F.concat_ws("_", *[cut("quals", s) for s in spans]),
        "CB": F.concat_ws("_", *[m["barcode"] for m in found]),
        "XQ": F.concat_ws("_", *[matched_quality(_read("quals", p.file), m["pos"], p.size) for p, m in zip(places, found)]),
        "XP": F.concat_ws("_", *[m["pos"] for m in found]),
        "XM": F.concat_ws("_", *[m["n"].cast("string") for m in found]),
    }
    if umi:
        columns |= {"UR": cut("seqs", umi), "UY": cut("quals", umi)}
    columns |= {
        "mismatches": mismatch_sum([m["n"] for m in found]),
        "kept": ~reduce(or_, [F.contains(m["barcode"], F.lit("N")) for m in found]),
    }
    return matched.select("read_idx", "read_name", "comment", *[c.alias(n) for n, c in columns.items()])


def extract(
    reads: DataFrame,
    places: list[BarcodePlace],
    whitelists: dict[str, DataFrame],
    span: Span,
    umi: Span | None = None,
    jitter: int = 2,
    mismatches: int = 1,
    base_quality: int | None = None,
    preset: str | None = None,
    sift: bool = False,
    strategy: str | None = None,
    tie: str = "set",
    indices: dict[str, tuple[str, DataFrame]] | None = None,
) -> DataFrame:
    """Match, correct and extract in one plan; `sift` keeps only reads whose barcodes all matched."""
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        jitter, mismatches = PRESETS[preset]
    if min(jitter, mismatches) < 0:
        raise ValueError("jitter and mismatches must not be negative")
    matched = match_barcodes(reads, places, whitelists, jitter, mismatches, base_quality, strategy, tie, indices)
    out = extract_records(matched, places, span, umi, base_quality)
    return out.where("kept") if sift else out


def mismatch_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("mismatches").agg(F.count(F.lit(1)).alias("count"))


def position_counts(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.split("XP", "_")).alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("count"))


def sam_lines(records: DataFrame) -> DataFrame:
    """Rows (read_idx, value): unmapped records as text, tags in the order CR CY CB XQ XP XM UR UY."""
    tags = [t for t in ("CR", "CY", "CB", "XQ", "XP", "XM", "UR", "UY") if t in records.columns]
    fixed = [F.col("read_name"), F.lit("4"), F.lit("*"), F.lit("0"), F.lit("255"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), F.col("qual")]
    return records.select("read_idx", F.concat_ws("\t", *fixed, *[F.concat(F.lit(f"{t}:Z:"), F.col(t)) for t in tags]).alias("value"))


def interleaved(records: DataFrame) -> DataFrame:
    """Rows (read_idx, value): eight lines a read, first the corrected barcodes with the UMI, then the extracted sequence."""
    from ..functions.sequence import strip_mate_suffix, update_length

    umi = "UR" in records.columns
    first = F.concat(F.regexp_replace("CB", "_", ""), F.col("UR") if umi else F.lit(""))
    quality = F.concat(F.regexp_replace("XQ", "_", ""), F.col("UY") if umi else F.lit(""))
    tags = F.concat_ws(" ", *[F.concat(F.lit(f"{t}="), F.col(t)) for t in ("CR", "CY", "CB", "XQ", "XP", "XM", "UR", "UY") if t in records.columns])
    comment = strip_mate_suffix(F.coalesce("comment", F.lit("")))

    def part(mate, seq, qual):
        header = F.concat_ws(" ", F.concat(F.lit("@"), F.col("read_name")), update_length(comment, F.length(seq)), F.concat(tags, F.lit(f" /{mate}")))
        return F.concat_ws("\n", header, seq, F.lit("+"), qual)

    return records.select("read_idx", F.concat_ws("\n", part(1, first, quality), part(2, F.col("seq"), F.col("qual"))).alias("value"))


def sidecar(lengths: list[int], umi: int = 0, whitelists: list[str] | None = None, name: str = "") -> dict:
    """Description of interleaved reads: barcode and UMI ranges of the first read, and the option of the counting tool."""
    at, ranges, option = 0, [], []
    for i, n in enumerate(lengths):
        ranges.append({"range": f"1:{at + 1}-{at + n}", "whitelist": whitelists[i] if whitelists else ""})
        option.append(f"0,{at},{at + n}")
        at += n
    x = ",".join(option)
    out: dict = {"description": name, "barcodes": ranges}
    if umi:
        out["umi"] = [{"range": f"1:{at + 1}-{at + umi}"}]
        x += f":0,{at},{at + umi}"
    x += ":1,0,0"
    out["kallisto-bustools"] = [{"kb count": f"-i </path/to/transcriptome.idx> -g </path/to/transcripts_to_genes> -x {x} -w NONE --h5ad --inleaved -o <outdir> <fastq>"}]
    return out
