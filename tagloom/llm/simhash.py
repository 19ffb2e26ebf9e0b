"""SimHash fingerprints and near-duplicate groups by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments, and the numbers of bits set in them are a point of a grid. The
Manhattan distance of two points is at most the number of differing bits, so fingerprints that differ in two bits
at most are two steps apart at most, and have a grid point in common that is one step at most from either. This is
the range join: each distinct fingerprint is entered at its own point and the 64 at most beside it, written once,
and fingerprints that meet at a point are candidates. They are verified exactly by counting the bits that differ.

A point where many fingerprints meet would make pairs with the square of their number. Beyond CROWD of them, the
same question is asked on the bits themselves: two fingerprints differ in at most two bits if and only if a word
one bit at most from both exists, and all fingerprints around such a word are linked through their smallest. That
gives 65 rows a fingerprint and connects what all pairs would connect, so no candidate is left out at any size.

Defined results: null, empty and word-less texts have fingerprint zero, linked like any other; texts of fewer words
than a shingle are one shingle; equal fingerprints are one node, so copies make no pairs; a null id is smaller
than any other; ids may repeat. Columns of the input are carried along whatever their names, except those named
like outputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, Shelf, cut, look_up, map_texts, quoted, stored
from .components import components

SHINGLE = 3
SEED = 42
SEGMENTS = 32
BITS = 2

#: Fingerprints at one grid point that are compared pair by pair; more are linked through words.
CROWD = 32

_LOWER = bytes(ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The text's fingerprint: a bit is set if over half of the shingles' hashes have it."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(words[i : i + size]), SEED) for i in range(count)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for i in range(0, count, 1 << 15):
        ones += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", size: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """`df` with `fp`, the fingerprint as a signed 64-bit number; a map over partitions."""

    def make():
        def work(texts: pa.Array) -> dict:
            return {"fp": np.array([fingerprint(t, size) for t in texts.to_pylist()], np.uint64).view(np.int64).tolist()}

        return work

    return map_texts(df, text_col, make, T.StructType().add("fp", T.LongType()), df.columns if carry is None else carry)


def _points(fps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint its grid point and those one step away that exist, each as a number: (row, point)."""
    x = fps.to_numpy().view(np.uint64)
    width = 64 // SEGMENTS
    powers = np.array([(width + 1) ** k for k in range(SEGMENTS)], np.uint64)
    ones = np.stack([np.bitwise_count(x >> np.uint64(k * width) & np.uint64((1 << width) - 1)) for k in range(SEGMENTS)], axis=1).astype(np.uint64)
    point = (ones * powers).sum(axis=1, dtype=np.uint64)[:, None]
    steps = np.concatenate([point, point + powers, point - powers], axis=1)
    real = np.concatenate([np.ones((len(x), 1), bool), ones < width, ones > 0], axis=1)
    return np.nonzero(real)[0], steps[real].view(np.int64)


def grid(distinct: DataFrame) -> DataFrame:
    """Rows (fp, point): each fingerprint at its own grid point and at those beside it."""
    schema = T.StructType().add("fp", "long").add("point", "long")

    def run(parts):
        for part in parts:
            for a in range(0, part.num_rows, 4096):
                fps = part.column(0).slice(a, 4096)
                rows, points = _points(fps)
                yield pa.RecordBatch.from_arrays([fps.take(pa.array(rows)), pa.array(points)], names=schema.names)

    return distinct.select("fp").mapInArrow(run, schema)


def links(distinct: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) that connect the fingerprints of `distinct` (fp) that differ in at most `bits` bits, two at most."""
    if not 0 <= bits <= 2:
        raise ValueError("grid points one step away find fingerprints that differ in two bits at most")
    # the grid's rows are made once; what stays of them is at points where several meet
    at = stored(grid(distinct))
    met = cut(look_up(at, stored(at.groupBy("point").agg(F.count(F.lit(1)).alias("many")).where("many > 1")), ["point"], "many"))
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits
    few = met.where(F.col("many") <= crowd)
    pairs = few.select("point", F.col("fp").alias("u")).join(few.select("point", F.col("fp").alias("v")), "point").where((F.col("u") < F.col("v")) & close("u", "v"))
    found = pairs.select("u", "v").distinct()
    crowded = met.where(F.col("many") > crowd).select("fp").distinct()
    if crowded.head(1):
        found = found.unionByName(_links_by_words(cut(crowded), bits))
    return found


def _links_by_words(close: DataFrame, bits: int) -> DataFrame:
    """As links(), in rows that grow in proportion to the fingerprints: through words one bit at most away."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long") for k in range(64)])
    around = cut(close.select("fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("word")))
    centre = around.groupBy("word").agg(F.min("fp").alias("u"), F.max("fp").alias("other")).where("u <> other").select("word", "u")
    return around.join(centre, "word").where("fp <> u").select("u", F.col("fp").alias("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, carry: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """`df` with fingerprint (16 hexadecimal digits) and component_id, the smallest id that links lead to."""
    shelf = Shelf(df.columns if carry is None else carry, ("fingerprint", "component_id"))
    marked = cut(fingerprints(df.select(*shelf.put, quoted(id_col).alias("id"), quoted(text_col).alias("text")), "text", size, [*shelf.keys, "id"]))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = marked.groupBy("fp").agg(F.min("id").alias("least"), F.max(F.col("id").isNull()).alias("nulls"))
    # as many parts as the session asks for, as each row becomes 65
    smallest = cut(kinds.repartition(n, "fp"))
    roots = components(links(smallest))
    # the smallest id of each component, for the fingerprints that have links; others are their own
    own = cut(smallest.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "root", "least", "nulls"))
    best = own.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("best"), F.max("nulls").alias("some"))
    linked = look_up(own.where("root IS NOT NULL"), cut(best), ["root"]).select("fp", F.when(~F.col("some"), F.col("best")).alias("component_id"))
    alone = own.where("root IS NULL").select("fp", F.when(~F.col("nulls"), F.col("least")).alias("component_id"))
    table = cut(linked.unionByName(alone))
    return look_up(marked, table, ["fp"]).select(*shelf.back, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
