"""Candidate windows of a read around the place where a barcode is expected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequence import repeat_char

_TYPE = "array<struct<cand:string,pos:int>>"


def _span(lo: Column, hi: Column, make) -> Column:
    """make(p) for p from lo to hi, none if lo > hi (a descending sequence otherwise)."""
    return F.when(lo <= hi, F.transform(F.sequence(lo, hi), make)).otherwise(F.array().cast(_TYPE))


def jitter_windows(seq, start: int, end: int, jitter: int = 0) -> Column:
    """Array of (cand, pos): windows of length end-start+1 within `jitter` of start, and clipped ones at either end.

    Places count from 1. Windows that would begin before the read get N in front and a place of start-c-1;
    windows that would end behind it get N at the end and a place of start+c.
    """
    seq = F.col(seq) if isinstance(seq, str) else seq
    size = end - start + 1
    n = F.length(seq)

    def at(p, k):
        return F.substring(seq, p, F.greatest(F.lit(k) if isinstance(k, int) else k, F.lit(0)))

    slide = _span(F.lit(max(1, start - jitter)), F.least(n - size + 1, F.lit(start + jitter)), lambda p: F.struct(at(p, size).alias("cand"), p.cast("int").alias("pos")))
    parts = [slide]
    if jitter and start - jitter < 1:
        parts.append(F.array(*[F.struct(F.concat(F.lit("N" * c), at(F.lit(start), size - c)).alias("cand"), F.lit(start - c - 1).alias("pos")) for c in range(1, jitter + 1)]))
    if jitter:
        right = F.array(*[F.struct(F.concat(at(F.lit(start + c), size - c), F.lit("N" * c)).alias("cand"), F.lit(start + c).alias("pos")) for c in range(1, jitter + 1)])
        parts.append(F.when(n < start - 1 + size + jitter, right).otherwise(F.array().cast(_TYPE)))
    return F.concat(*[p.cast(_TYPE) for p in parts])


def window_list(seq: Column, start: int, end: int, jitter: int = 0) -> list[tuple[Column, int]]:
    """The windows of jitter_windows() as (cand, pos), a column each; null where a read has no such window of full length."""
    size = end - start + 1
    n = F.length(seq)
    out = [(F.when(n >= p + size - 1, F.substring(seq, p, size)), p) for p in range(max(1, start - jitter), start + jitter + 1)]

    def full(cand, c: int) -> Column:
        return cand if c <= size else F.lit(None).cast("string")

    if jitter and start - jitter < 1:
        out += [(full(F.concat(F.lit("N" * c), F.substring(seq, start, max(size - c, 0))), c), start - c - 1) for c in range(1, jitter + 1)]
    out += [(F.when(n < start - 1 + size + jitter, full(F.concat(F.substring(seq, start + c, max(size - c, 0)), F.lit("N" * c)), c)), start + c) for c in range(1, jitter + 1)]
    return [(F.when(F.length(cand) == size, cand), pos) for cand, pos in out]


def all_windows(seq, size: int) -> Column:
    """Array of (cand, pos): every window of the given length."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return _span(F.lit(1), F.length(seq) - size + 1, lambda p: F.struct(F.substring(seq, p, F.lit(size)).alias("cand"), p.cast("int").alias("pos"))).cast(_TYPE)


def no_match(size) -> Column:
    return repeat_char("N", size)
