"""Approximate matching of read windows against a whitelist, and the choice of one barcode for each read.

One logical operator, `windows within m mismatches of a barcode`, has three physical forms that give the same rows:
the neighbourhood of each barcode as a hash table, pigeonhole seeds, and shared k-mers with verification. Each is
an equi-join against the whitelist side; that side is sent to all executors only when its counted size allows it.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, hamming, packed_bases, packed_distance

#: Bytes of a whitelist side that may be broadcast; a larger one is joined by a shuffle.
MAX_BROADCAST_BYTES = 64 << 20

#: Bytes of a row besides its strings, about, as Spark keeps it in a hash table.
ROW_BYTES = 64


def _fits(rows: int, length: int) -> bool:
    return rows * (ROW_BYTES + 2 * max(8, length)) <= MAX_BROADCAST_BYTES


def _side(df: DataFrame, rows: int, length: int) -> DataFrame:
    return F.broadcast(df) if _fits(rows, length) else df


def neighbourhood(whitelist: DataFrame, mismatches: int) -> DataFrame:
    """Rows (barcode, variant, n): every string over ACGTN at distance n <= mismatches of each barcode."""
    spread = whitelist.select("barcode", F.col("barcode").alias("variant"), F.lit(0).alias("n"))
    for _ in range(mismatches):
        places = spread.select("barcode", "variant", F.explode(F.sequence(F.lit(1), F.length("barcode"))).alias("p"))
        bases = places.select("barcode", "variant", "p", F.explode(F.array(*map(F.lit, BASES))).alias("b"))
        changed = bases.select("barcode", F.expr("concat(substring(variant, 1, p - 1), b, substring(variant, p + 1))").alias("variant"))
        spread = changed.distinct().select("barcode", "variant", hamming("barcode", "variant").alias("n"))
    return spread.groupBy("barcode", "variant").agg(F.min("n").alias("n"))


def neighbourhood_size(barcodes: int, length: int, mismatches: int) -> int:
    return barcodes * sum(comb(length, k) * 4**k for k in range(mismatches + 1))


def fits_neighbourhood(barcodes: int, length: int, mismatches: int) -> bool:
    """True if the neighbourhood of that many barcodes may be broadcast."""
    return _fits(neighbourhood_size(barcodes, length, mismatches), length)


def lookup_table(whitelist: DataFrame, length: int, mismatches: int) -> DataFrame:
    """A row a variant: (variant, hit), hit of its least mismatches n, the first barcode that has it so, and how many do (kinds)."""
    near = neighbourhood(whitelist.select("barcode").where(F.length("barcode") == length).distinct(), mismatches)
    by_n = near.groupBy("variant", "n").agg(F.min("barcode").alias("barcode"), F.count(F.lit(1)).cast("int").alias("kinds"))
    return by_n.groupBy("variant").agg(F.min(F.struct("n", "kinds", "barcode")).alias("hit"))


def choose_strategy(barcodes: int, length: int, mismatches: int) -> str:
    """Neighbourhood while its table is small, seeds beyond."""
    return "neighbourhood" if mismatches == 0 or _fits(neighbourhood_size(barcodes, length, mismatches), length) else "seed"


def _seed_spans(length: int, mismatches: int) -> list[tuple[int, int]]:
    """(start, size) of mismatches+1 disjoint parts; the last takes the remainder."""
    size = max(1, length // (mismatches + 1))
    parts = min(mismatches + 1, length)
    return [(i * size + 1, size if i < parts - 1 else length - i * size) for i in range(parts)]


def seed_index(whitelist: DataFrame, length: int, mismatches: int) -> DataFrame:
    """Rows (len, seed_id, seed, barcode)."""
    parts = F.array(*[F.struct(F.lit(i).alias("seed_id"), F.substring("barcode", a, n).alias("seed")) for i, (a, n) in enumerate(_seed_spans(length, mismatches))])
    return whitelist.where(F.length("barcode") == length).select("barcode", F.explode(parts).alias("s")).select(F.lit(length).alias("len"), "s.seed_id", "s.seed", "barcode")


def kmer_size(length: int, mismatches: int) -> int:
    return max(1, length // (mismatches + 1))


def kmer_index(whitelist: DataFrame, length: int, mismatches: int) -> DataFrame:
    """Rows (kmer, barcode): every k-mer of each barcode."""
    k = kmer_size(length, mismatches)
    return whitelist.where(F.length("barcode") == length).select("barcode", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, {length - k + 1}), i -> substring(barcode, i, {k}))"))).alias("kmer"))


def _earlier_seed_fits(length: int, mismatches: int) -> Column:
    """True if a seed before `seed_id` agrees as well, so that this pair has been found by that one."""
    spans = _seed_spans(length, mismatches)
    same = [F.substring("cand", a, n) == F.substring("barcode", a, n) for a, n in spans[:-1]]
    out = F.lit(False)
    for i, one in enumerate(same):
        out = out | ((F.col("seed_id") > i) & one)
    return out


def approximate_matches(
    windows: DataFrame,
    whitelist: DataFrame,
    length: int,
    mismatches: int,
    strategy: str | None = None,
    barcodes: int | None = None,
    index: tuple[str, DataFrame] | None = None,
) -> DataFrame:
    """`windows` (with `cand`) joined to `barcode` and `n`, the mismatches, at most `mismatches`.

    `barcodes` is the whitelist's number of rows, counted here if it is not given. `index` is a stored index, its kind
    and its rows (see index.py), which then takes the whitelist's place. A pair that several seeds or k-mers find is
    kept where its first one is found, so pairs need no shuffle to be made distinct.
    """
    count = whitelist.count() if barcodes is None else barcodes
    if index is not None:
        strategy, stored = index[0], index[1].where(F.col("len") == length)
    strategy = strategy or choose_strategy(count, length, mismatches)
    whitelist = whitelist.select("barcode").where(F.length("barcode") == length).distinct()
    full = windows.where(F.length("cand") == length)
    own = [F.col(c) for c in full.columns]
    if strategy == "neighbourhood":
        rows = neighbourhood(whitelist, mismatches) if index is None else stored.where(F.col("n") <= mismatches).drop("len")
        table = _side(rows, neighbourhood_size(count, length, mismatches), length)
        return full.join(table, full["cand"] == table["variant"]).drop("variant")
    if strategy == "seed":
        rows = seed_index(whitelist, length, mismatches) if index is None else stored
        table = _side(rows.drop("len").withColumn("y", packed_bases("barcode")), count * (mismatches + 1), length)
        parts = F.array(*[F.struct(F.lit(i).alias("seed_id"), F.substring("cand", a, n).alias("seed")) for i, (a, n) in enumerate(_seed_spans(length, mismatches))])
        near = full.select(*own, packed_bases("cand").alias("x"), F.explode(parts).alias("s")).select(*own, "x", "s.seed_id", "s.seed").join(table, ["seed_id", "seed"])
        near = near.where(~_earlier_seed_fits(length, mismatches))
    elif strategy == "kmer":
        k = kmer_size(length, mismatches)
        rows = kmer_index(whitelist, length, mismatches) if index is None else stored.drop("len")
        table = _side(rows.withColumn("y", packed_bases("barcode")), count * length, length)
        kmers = F.array_distinct(F.expr(f"transform(sequence(1, {length - k + 1}), i -> substring(cand, i, {k}))"))
        near = full.select(*own, packed_bases("cand").alias("x"), kmers.alias("kmers")).select("*", F.posexplode("kmers").alias("at", "kmer")).join(table, "kmer")
        # few pairs are near enough; of these the one found by the first k-mer that both have stays
        near = near.where(packed_distance("x", "y", "cand", "barcode") <= mismatches)
        near = near.where(~F.exists(F.slice("kmers", F.lit(1), F.col("at")), lambda x: F.contains(F.col("barcode"), x)))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return near.select(*own, "barcode", packed_distance("x", "y", "cand", "barcode").alias("n")).where(F.col("n") <= mismatches)


def distance(pos, start: int, n) -> Column:
    """Distance of a window's place from the expected one; inexact clipped windows count from the place after."""
    return F.when((n > 0) & (pos < 1), F.abs(pos + 1 - start)).otherwise(F.abs(pos - start))


def resolve(hits, size: int, tie: str = "set") -> Column:
    """Struct (barcode, n, pos) for an array of hits (n, dist, barcode, pos).

    The least (n, dist) wins if it belongs to one barcode; its place is `*` if several windows have it. With tie
    `set`, two exact windows at one distance are no match even for one barcode. No match: N's, -1 and `N`.
    """
    best = F.array_min(F.transform(hits, lambda h: F.struct(h["n"], h["dist"])))
    top = F.filter(hits, lambda h: (h["n"] == best["n"]) & (h["dist"] == best["dist"]))
    barcodes = F.array_distinct(F.transform(top, lambda h: h["barcode"]))
    places = F.array_distinct(F.transform(top, lambda h: h["pos"]))
    good = (F.size(hits) > 0) & (F.size(barcodes) == 1)
    if tie == "set":
        good = good & ~((best["n"] == 0) & (F.size(top) > 1))
    found = F.struct(F.get(barcodes, F.lit(0)).alias("barcode"), best["n"].alias("n"), F.when(F.size(places) == 1, F.get(places, F.lit(0)).cast("string")).otherwise("*").alias("pos"))
    return F.when(good, found).otherwise(F.struct(F.lit("N" * size).alias("barcode"), F.lit(-1).alias("n"), F.lit("N").alias("pos")))


#: Above any distance of a window from its place.
_FAR = 1 << 20


def _of(f, columns: list[Column]) -> Column:
    return f(*columns) if len(columns) > 1 else columns[0]


def resolve_windows(hits: list[tuple[Column, int]], start: int, tie: str = "set") -> dict[str, Column]:
    """The choice of resolve() for windows that are columns: (hit of lookup_table(), or null; place); `good` is true if there is a match.

    Within a window only its hits of least mismatches can win, so their number and the first of them are enough.
    """
    keys = []
    for h, pos in hits:
        away = F.lit(abs(pos - start)) if pos >= 1 else F.when(h["n"] > 0, abs(pos + 1 - start)).otherwise(abs(pos - start))
        keys.append(h["n"] * _FAR + away)
    best = _of(F.least, keys)
    top = [key == best for key in keys]
    each = lambda make: [F.when(t, make(h, pos)) for t, (h, pos) in zip(top, hits)]
    barcodes, kinds, places = each(lambda h, _: h["barcode"]), each(lambda h, _: h["kinds"]), each(lambda _, pos: F.lit(pos))
    first, n = _of(F.least, barcodes), F.shiftright(best, 20)
    good = (_of(F.greatest, kinds) == 1) & (first == _of(F.greatest, barcodes))
    if tie == "set":
        total = F.lit(0)
        for k in kinds:
            total = total + F.coalesce(k, F.lit(0))
        good = good & ~((n == 0) & (total > 1))
    place = _of(F.least, places)
    return {"good": F.coalesce(good, F.lit(False)), "barcode": first, "n": n, "pos": F.when(place == _of(F.greatest, places), place.cast("string")).otherwise("*")}
