"""Removal of every byte that a repeated string of LEAST bytes covers, by suffix arrays of what may repeat.

Each string of LEAST bytes has an anchor: the place in it whose ANCHOR bytes have the smallest hash, the first of
equals. Equal strings have equal anchors at one offset, so they can only meet where anchors are equal. The strings
of a text that share an anchor are one stretch of it, and a stretch that occurs twice is repeated as a whole. Of
stretches of equal anchors that differ, two can only share a string if they share the anchor with a whole number of
steps on its left and a whole number on its right, of a step less than a string has: PARTS such surroundings, which
are met by hash. Stretches that meet are dealt out by anchor, and each shard's stretches are one text whose suffix
array (external induced sorting, which carries common prefixes) brings equal strings together. A string counts as
repeated if another stretch has it at the same offset from the anchor; as each string belongs to one stretch only,
no place is compared with itself. An anchor of more such stretches than fill a block is not sorted in one task: all
strings of its stretches are dealt out and counted by a 128-bit hash of their bytes. As every string of a stretch
has its anchor, the repeated ones cover one run, from the first to the end of the last.

Shorter passages that other rows have too can be reported besides (`short`); none of their bytes is removed for it.
A string of `short` bytes has an anchor of GRAM bytes, found as above, and equal strings have equal ones: so anchors
that another row has as an anchor too, by a 64-bit hash, are in every passage of `short` bytes or more that another
row has, and no run of them has less than GRAM bytes that another row has.

Defined results: null counts as empty; bytes are those of UTF-8; texts of fewer than LEAST bytes have nothing to
remove; a row that occurs twice is two texts, so all its strings repeat if it is long enough; columns besides id
and text are carried along whatever their names, except those named like outputs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shelf, batches, cut, quoted, stored, sweep
from .suffix_array import suffix_array

LEAST = 400
ANCHOR = 48

#: Bytes of the shortest passage that is reported for certain, and of its anchor; 50 words of prose are seldom fewer bytes.
SHORT = 256
GRAM = 96

#: Surroundings of an anchor; a string has this many steps beside its anchor, and surroundings have one less.
PARTS = 6

#: Most tasks that stretches are dealt out to; a task sorts its blocks one after another.
MOST_TASKS = 1 << 15

#: Most bytes of stretches sorted at once; an anchor whose stretches may be more has its strings counted by hash.
BLOCK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        k = min(filled, n - filled)
        out[filled : filled + k] = out[:k] * np.uint64(pow(base, filled, 1 << 64))
        filled += k
    return out


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of the `size` bytes from each place on."""
    n = len(data)
    if not _tables or len(_tables[0][0]) < n:
        room = 1 << max(16, n.bit_length())
        _tables[0] = _powers(_BASE, room), _powers(pow(_BASE, -1, 1 << 64), room)
    up, down = _tables[0]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    x = (total[size:] - total[:-size]) * down[: n - size + 1]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    n = len(x) - width + 1
    rows = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, least: int = LEAST, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, offset of the anchor, hash of the anchor) of the stretches of strings that share an anchor."""
    if len(data) < least:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) > 1 << 24:
        # the place takes 24 bits; a longer text is gone through in parts that overlap by a string less a byte
        step, found = (1 << 24) - least, []
        for at in range(0, len(data) - least + 1, step):
            s, n, o, h = stretches(data[at : at + step + least - 1], least, anchor)
            found.append((s + at, n, o, h))
        return tuple(np.concatenate(x) for x in zip(*found))
    h = _hashes(data, anchor)
    best = _smallest((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), least - anchor + 1)
    first = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    place = (best[first] & _PLACE).astype(np.int64)
    last = np.append(first[1:], len(best)) - 1
    return first, last - first + least, place - first, h[place].view(np.int64)


def repeated_windows(bodies: list[bytes], offsets: list[int], groups: np.ndarray, least: int = LEAST, folder: str | None = None) -> list[list[tuple[int, int]]]:
    """For each stretch the parts that strings cover which another stretch of its group has at the same offset from the anchor."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    start = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    text = np.append(data.astype(np.int16) + 2, np.int16(0))
    text[start + size] = 1  # between stretches
    order, common = (x[1:] for x in suffix_array(text, 258, least, folder))
    kind = order.dtype
    owner = np.repeat(np.arange(len(bodies), dtype=kind), size + 1)
    place = np.arange(len(data), dtype=kind)
    place -= np.repeat(start.astype(kind), size + 1)
    # places from which a whole string fits; what two neighbours share is the least along the way
    fits = np.flatnonzero((place <= np.repeat((size - least).astype(kind), size + 1))[order])
    same = np.minimum.reduceat(common, fits[:-1] + 1)[: len(fits) - 1] >= least if len(fits) > 1 else np.zeros(0, bool)
    if len(fits) > 1:
        # the last stretch of reduceat goes on to the end
        same[-1] = common[fits[-2] + 1 : fits[-1] + 1].min() >= least
    order = order[fits]
    inside = np.append(False, same) | np.append(same, False)
    run = np.cumsum(np.append(0, ~same))[inside]
    order = order[inside]
    own = owner[order]
    shift = place[order] - np.asarray(offsets, np.int64)[own]  # at most 0, above -least
    _, which, count = np.unique((run * (int(groups.max()) + 1) + groups[own]) * least - shift, return_inverse=True, return_counts=True)
    hit = np.sort(order[count[which] > 1])
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    if len(hit):
        a, b = owner[hit], place[hit]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] > b[:-1] + least))
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(hit)) - 1
        for i, x, y in zip(a[firsts].tolist(), b[firsts].tolist(), (b[lasts] + least).tolist()):
            out[i].append((x, y))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


_ANCHORS = T.StructType().add("k1", "long").add("k2", "integer").add("start", "integer").add("size", "integer").add("offset", "integer").add("h", "long").add("body", "long")


def _anchors(keyed: DataFrame, least: int, anchor: int) -> DataFrame:
    """A row for each stretch of each text (k1, k2, text): its place, its anchor's hash, and a hash of its bytes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi in batches(part.column(2)):
                columns: list[list] = [[] for _ in range(7)]
                k1, k2 = part.column(0).slice(lo, hi - lo).to_pylist(), part.column(1).slice(lo, hi - lo).to_pylist()
                for a, b, text in zip(k1, k2, part.column(2).slice(lo, hi - lo).to_pylist()):
                    raw = (text or "").encode()
                    s, n, o, h = (x.tolist() for x in stretches(np.frombuffer(raw, np.uint8), least, anchor))
                    digest = [xxhash.xxh3_64_intdigest(raw[i : i + k], j) for i, k, j in zip(s, n, o)]
                    for column, values in zip(columns, ([a] * len(s), [b] * len(s), s, n, o, h, np.array(digest, np.uint64).view(np.int64).tolist())):
                        column.extend(values)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_ANCHORS.names)

    return keyed.mapInArrow(run, _ANCHORS)


def _bodies(wanted: DataFrame, least: int, anchor: int) -> DataFrame:
    """The stretches asked for (text, want: array of start, size, offset, h, body, lone): their bytes, and hashes of the anchor's surroundings."""
    schema = T.StructType().add("h", "long").add("offset", "integer").add("body", "long").add("lone", "boolean").add("data", "binary").add("around", T.ArrayType(T.StructType().add("side", "integer").add("beside", "long")))
    # a string has a bytes on the left and b on the right, a + b = least - anchor, so a // step + b // step >= PARTS - 1
    step = (least - anchor + 1) // PARTS
    size = anchor + (PARTS - 1) * step
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.struct([("side", pa.int32()), ("beside", pa.int64())])))

    def around(data: bytes, at: int) -> list[dict]:
        starts = [(i, at - i * step) for i in range(PARTS)]
        return [{"side": i, "beside": xxhash.xxh3_64_intdigest(data[a : a + size]) - (1 << 63)} for i, a in starts if 0 <= a <= len(data) - size]

    def run(parts):
        for part in parts:
            for lo, hi in batches(part.column(0)):
                rows = []
                for text, want in zip(part.column(0).slice(lo, hi - lo).to_pylist(), part.column(1).slice(lo, hi - lo).to_pylist()):
                    raw = text.encode()
                    for w in want:
                        data = raw[w["start"] : w["start"] + w["size"]]
                        rows.append((w["h"], w["offset"], w["body"], w["lone"], data, around(data, w["offset"])))
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    return wanted.select("text", "want").mapInArrow(run, schema)


_SPANS = T.ArrayType(T.StructType().add("a", "integer").add("b", "integer"))
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sorted_spans(bodies: DataFrame, least: int, block_bytes: int) -> DataFrame:
    """Repeated parts of the stretches that occur once: (h, body, spans). Rows of one h come together."""
    schema = T.StructType().add("h", "long").add("body", "long").add("spans", _SPANS)

    def run(parts):
        block: list[tuple] = []
        held = first = 0  # bytes of the block, and where its last anchor's stretches begin

        def done(block):
            new = [a[0] != b[0] for a, b in zip(block, block[1:])]
            with tempfile.TemporaryDirectory() as folder:
                found = repeated_windows([r[4] for r in block], [r[1] for r in block], np.cumsum([0, *new]), least, folder)
            rows = [(r[0], r[2], s) for r, s in zip(block, found) if r[3] and s]
            columns = list(zip(*rows)) or [()] * 3
            spans = [[{"a": a, "b": b} for a, b in s] for s in columns[2]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(spans, _ARROW_SPANS)], names=schema.names)

        for part in parts:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if block and row[0] != block[-1][0]:
                    first = len(block)
                block.append(row)
                held += len(row[4])
                if held > block_bytes and first:
                    # those of an anchor stay together, and alone they are no more than a block
                    yield done(block[:first])
                    block, first = block[first:], 0
                    held = sum(len(r[4]) for r in block)
        if block:
            yield done(block)

    return bodies.select("h", "offset", "body", "lone", "data").mapInArrow(run, schema)


def _counted_spans(bodies: DataFrame, least: int) -> DataFrame:
    """What _sorted_spans gives, by counting the hashes of all strings; no anchor's stretches come together."""
    schema = T.StructType().add("h", "long").add("body", "long").add("lone", "boolean").add("at", "integer").add("digest", "binary")

    def run(parts):
        for part in parts:
            for lo, hi in batches(part.column(3), 1 << 17):
                h, body, lone, data = (c.slice(lo, hi - lo) for c in part.columns)
                data = data.to_pylist()
                which = pa.array(np.repeat(np.arange(len(data)), [len(d) - least + 1 for d in data]))
                at = pa.array([i for d in data for i in range(len(d) - least + 1)], pa.int32())
                digest = pa.array([xxhash.xxh3_128_digest(d[i : i + least]) for d in data for i in range(len(d) - least + 1)], pa.binary())
                yield pa.RecordBatch.from_arrays([h.take(which), body.take(which), lone.take(which), at, digest], names=schema.names)

    strings = bodies.select("h", "body", "lone", "data").mapInArrow(run, schema)
    # sums precede the shuffle, and the written table lets Spark split the rows of a frequent string
    repeated = cut(strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    found = strings.where("lone").join(repeated, "digest").groupBy("h", "body").agg(F.min("at").alias("a"), (F.max("at") + least).alias("b"))
    return found.select("h", "body", F.array(F.struct("a", "b")).alias("spans"))


def _marks(keyed: DataFrame, anchors: DataFrame, least: int, anchor: int, block_bytes: int) -> DataFrame:
    """Repeated parts of the stretches (h, body, spans), by all of `anchors` and the texts they are from."""
    # stretches by anchor and bytes; sums precede the shuffle, so that one that all texts have is no burden
    kinds = anchors.groupBy("h", "offset", "body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "start", "size")).alias("at"))
    groups = kinds.groupBy("h").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("lone")).where("total > 1")
    shared = cut(kinds.join(groups, "h").select("h", "offset", "body", "n", "at", ((F.col("kinds") > 1) & (F.col("lone") > 0)).alias("differ")))
    sweep(keyed.sparkSession)

    whole = shared.where("n > 1").select("h", "body", F.array(F.struct(F.lit(0).alias("a"), F.col("at.size").alias("b"))).alias("spans"))
    asked = shared.where("differ").select("at.k1", "at.k2", F.struct("at.start", "at.size", "offset", "h", "body", (F.col("n") == 1).alias("lone")).alias("w"))
    wanted = keyed.join(asked.groupBy("k1", "k2").agg(F.collect_list("w").alias("want")), ["k1", "k2"])
    bodies = cut(_bodies(wanted, least, anchor))
    sweep(keyed.sparkSession)
    stretch, key = ["h", "offset", "body"], ["h", "side", "beside"]
    members = bodies.select(*stretch, "lone", F.octet_length("data").alias("size"), F.explode("around").alias("s")).select(*stretch, "lone", "size", "s.side", "s.beside")
    met = members.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"), F.count_if("lone").alias("alone")).where("kinds > 1 AND alone > 0")
    asked = cut(members.join(met.select(*key), key).groupBy(*stretch).agg(F.first("size").alias("size")))
    # a stretch has fewer than 2 * least bytes; each of these anchors has half a block or more, so they are few
    hot = asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_bytes // (2 * least)).select("h").collect()
    spans = whole
    if hot:
        hot = F.broadcast(keyed.sparkSession.createDataFrame(hot, "h long"))
        spans = spans.unionByName(_counted_spans(bodies.join(asked.join(hot, "h").select(*stretch), stretch), least))
        asked = asked.join(hot, "h", "left_anti")
    tasks = min(MOST_TASKS, 1 + (asked.agg(F.sum("size")).head()[0] or 0) // block_bytes)
    dealt = bodies.drop("around").join(asked.select(*stretch), stretch).repartition(tasks, "h").sortWithinPartitions("h", "body")
    return cut(spans.unionByName(_sorted_spans(dealt, least, block_bytes)))


_GRAMS = T.StructType().add("k1", "long").add("k2", "integer").add("at", "integer").add("h", "long").add("first", "boolean")


def _shared(texts: DataFrame, short: int, gram: int) -> DataFrame:
    """Places of the anchors of strings of `short` bytes that another row has too: (k1, k2, at). Rows are counted, not places."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi in batches(part.column(2)):
                k1, k2 = (part.column(i).slice(lo, hi - lo) for i in (0, 1))
                sizes, places, hashes, firsts = [], [], [], []
                for text in part.column(2).slice(lo, hi - lo).to_pylist():
                    raw = text.encode()
                    s, _, o, _ = stretches(np.frombuffer(raw, np.uint8), short, gram)
                    at = np.unique(s + o)
                    h = np.array([xxhash.xxh3_64_intdigest(raw[i : i + gram]) for i in at.tolist()], np.uint64)
                    first = np.zeros(len(at), bool)
                    first[np.unique(h, return_index=True)[1]] = True
                    for column, values in zip((sizes, places, hashes, firsts), (len(at), at, h, first)):
                        column.append(values)
                which = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = [pa.array(np.concatenate(c).astype(t)) for c, t in ((places, np.int32), (hashes, np.uint64), (firsts, bool))]
                yield pa.RecordBatch.from_arrays([k1.take(which), k2.take(which), columns[0], columns[1].view(pa.int64()), columns[2]], names=_GRAMS.names)

    grams = stored(texts.mapInArrow(run, _GRAMS))
    # sums precede the shuffle, and the written table lets Spark split the rows of a frequent anchor
    repeated = cut(grams.where("first").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    return grams.join(repeated, "h").groupBy("k1", "k2").agg(F.collect_set("at").alias("at"))


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    anchor: int = ANCHOR,
    block_bytes: int = BLOCK_BYTES,
    carry: list[str] | None = None,
    short: int | None = None,
    gram: int = GRAM,
) -> DataFrame:
    """`df` with n_bytes, spans (start, end of each removed run, in bytes) and kept (binary, the bytes that stay).

    With `short` there are also passages (start, end in bytes): runs of anchors that other rows have too, which come
    one after another as the anchors of one passage do.
    """
    if not 8 <= anchor <= least or short is not None and not 8 <= gram <= short:
        raise ValueError("an anchor has 8 bytes at least, and no more than a string")
    outputs = ("n_bytes", "spans", "kept", *(["passages"] if short else []))
    shelf = Shelf(df.columns if carry is None else carry, outputs)
    carry = shelf.keys
    text = quoted(text_col).cast("string")
    k1, k2 = F.xxhash64(quoted(id_col), text), F.hash(text, quoted(id_col))
    texts = df.select(k1.alias("k1"), k2.alias("k2"), text.alias("text"))
    if short:
        shared = _shared(texts.where(F.octet_length("text") >= short), short, gram)
        sweep(df.sparkSession)
    keyed = texts.where(F.octet_length("text") >= least)
    # read three times; as columns they take a quarter of what the texts do
    anchors = stored(_anchors(keyed, least, anchor))

    marks = _marks(keyed, anchors, least, anchor, block_bytes)
    sweep(df.sparkSession)
    covered = anchors.join(marks, ["h", "body"]).select("k1", "k2", F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"))).alias("spans"))
    by_text = covered.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    rows = df.select(*shelf.put, text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    joined = rows.join(by_text, ["k1", "k2"], "left")
    joined = (joined.join(shared, ["k1", "k2"], "left") if short else joined).select(*carry, "text", "spans", *(["at"] if short else []))
    places = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
    added = T.StructType().add("n_bytes", "long").add("spans", places).add("kept", "binary")
    schema = T.StructType([*joined.schema.fields[: len(carry)], *(added.add("passages", places) if short else added)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(parts):
        for part in parts:
            for lo, hi in batches(part.column(len(carry))):
                sizes, spans, kept = [], [], []
                for value, found in zip(part.column(len(carry)).slice(lo, hi - lo).to_pylist(), part.column(len(carry) + 1).slice(lo, hi - lo).to_pylist()):
                    raw = (value or "").encode()
                    gone = merged([(s["a"], s["b"]) for s in found or ()])
                    edges = [0, *[x for s in gone for x in s], len(raw)]
                    sizes.append(len(raw))
                    spans.append([{"start": a, "end": b} for a, b in gone])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                columns = [pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())]
                if short:
                    # anchors of neighbouring strings are no further apart than a string has places for one
                    found = part.column(len(carry) + 2).slice(lo, hi - lo).to_pylist()
                    runs = [merged([(i, i + short - gram + 1) for i in at or ()]) for at in found]
                    columns.append(pa.array([[{"start": a, "end": b - short + 2 * gram - 1} for a, b in r] for r in runs], kind))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in part.columns[: len(carry)]], *columns], names=schema.names)

    return joined.mapInArrow(run, schema).select(*shelf.back, *outputs)
