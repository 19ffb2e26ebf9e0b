"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one resolves a whole pre-token that is in the vocabulary through a minimal perfect hash (hash and
displace); tier two merges the bytes of any other pre-token, a linked list of parts with a heap of pair ranks.
The new pre-tokens of a batch are merged together: each has its own links and its own heap, a tree whose nodes
hold the least of their four children, and all take a merge at once; a merge renews the three leaves that it
changes and the nodes above them. Pre-tokens of over WIDEST bytes have a binary heap each, by the same order.

Defined results: null and empty texts have no ids; texts of any length are encoded whole (a pre-token of n
bytes costs n log n); repeated rows are encoded alike. Columns of the input are carried along
whatever their names, except those named like outputs. A table without rows gives no rows. Ranks must
hold every single byte, or there would be texts without ids.
"""

from __future__ import annotations

import base64
import re
from array import array
from heapq import heapify
from heapq import heappop as pop
from heapq import heappush as push

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import kept, map_texts

#: Pre-tokens whose ids a worker remembers unless told otherwise; beyond it all are forgotten, and computed again, before the next batch.
REMEMBERED = 250_000

#: A rank file may have this many bytes at most, as it is sent to every executor.
MAX_RANK_BYTES = 64 << 20

_MASK = (1 << 64) - 1
_NONE = np.iinfo(np.int32).max

#: Leaves of the heaps that are merged together, powers of FAN.
FAN = 4
WIDTHS = (4, 16, 64)
WIDEST = WIDTHS[-1]
_WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDEST + 1)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks from a file of `base64 rank` lines."""
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has more than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys in n slots, found with one displacement a bucket."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = max(1, len(ranks))
        self.buckets = max(1, n // 3)
        groups: dict[int, list[bytes]] = {}
        for key in ranks:
            groups.setdefault(xxhash.xxh64_intdigest(key) % self.buckets, []).append(key)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        free = n - 1
        for bucket, keys in sorted(groups.items(), key=lambda g: -len(g[1])):
            hashes = [xxhash.xxh64_intdigest(k) for k in keys]
            if len(keys) == 1:
                # a lone key takes any free slot, kept as a negative number
                while self.keys[free] is not None:
                    free -= 1
                slots, self.shift[bucket] = [free], -free - 1
            else:
                for d in range(1, 1 << 24):
                    slots = [self._slot(h, d) for h in hashes]
                    if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                else:
                    raise ValueError("no displacement found")
                self.shift[bucket] = d
            for key, slot in zip(keys, slots):
                self.keys[slot], self.values[slot] = key, ranks[key]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & _MASK) >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


#: What a pattern may consist of for `re` to find the same; sets hold characters and categories only.
_PLAIN = re.compile(r"(?:\[\^?(?:\\p\{[LN]\}|\\s|[A-Za-z0-9 '])+\]|\\p\{[LN]\}|\\[sS]|[A-Za-z0-9 '|+*?)]|\((?:\?[:!=]|(?!\?)))*")


def _members(category: str) -> str:
    """The characters below 2^16 that `regex` has in a category, as ranges of a set."""
    out = []
    for part in (range(0xD800), range(0xE000, 1 << 16)):
        out += [f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{category}+", "".join(map(chr, part)))]
    return "".join(out)


def finder(pattern: str):
    """findall of `regex` for a pattern; texts whose characters are below 2^16 are left to `re`, which takes half the time, if it can do the pattern."""
    slow = regex.compile(pattern).findall
    if not _PLAIN.fullmatch(pattern):
        return slow
    sets = {c: _members(c) for c in (r"\p{L}", r"\p{N}", r"\s")}

    def plain(m) -> str:
        inside = re.sub(r"\\p\{.\}|\\s", lambda c: sets[c[0]], m[0])
        return inside if m[0][0] == "[" else f"[^{sets[m[0].lower()]}]" if m[0] == r"\S" else f"[{inside}]"

    fast = re.compile(re.sub(r"\[[^]]*\]|\\p\{.\}|\\[sS]", plain, pattern)).findall
    return lambda text: fast(text) if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else slow(text)


class _Pieces(dict):
    """Ids by pre-token. One that is not there gets a place for its ids, which whoever asked may hold already."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytearray:
        self.new.append(piece)
        self[piece] = place = bytearray()
        return place


class Codec:
    """Encodes and decodes by ranks, which must hold every single byte that a text can have."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: PerfectHash | None = None, remembered: int | None = None):
        self.remembered = REMEMBERED if remembered is None else remembered
        self.table, self.ranks = table or PerfectHash(ranks), ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.byte_ranks = [ranks.get(bytes([a]), -1) for a in range(256)]
        if min(self.byte_ranks) < 0:
            raise ValueError("the ranks lack a single byte")
        if max(ranks.values()) >= _NONE // WIDEST:
            raise ValueError(f"ranks are below {_NONE // WIDEST}")
        self.pair_ranks = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.find = finder(pattern)
        self.pieces = _Pieces()
        self.pairs = _PairTable(ranks)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > self.remembered:
            self.pieces = _Pieces()
        get = self.pieces.__getitem__
        try:
            found = [list(map(get, self.find(x))) for x in texts]
            self._learn()
        except BaseException:
            self.pieces = _Pieces()  # places without ids are not for later texts
            raise
        return list(map(b"".join, found))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""

    def _learn(self) -> None:
        """Find the ids of new pre-tokens: whole ones by the perfect hash, the rest by merging."""
        pieces, new = self.pieces, self.pieces.new
        table, rest = self.table.get, {w: ([], []) for w in (*WIDTHS, 0)}

        def known(names: list[str], ids: list[bytes]) -> None:
            for piece, x in zip(names, ids):
                pieces[piece][:] = x
            pieces.update(zip(names, ids))

        whole: tuple[list, list] = [], []
        for piece, data in zip(new, map(str.encode, new)):
            rank = table(data)
            if rank >= 0:
                names, values = whole
                data = rank.to_bytes(4, "little")
            else:
                names, values = rest[_WIDTH_OF[len(data)] if len(data) <= WIDEST else 0]
            names.append(piece)
            values.append(data)
        known(*whole)
        for width, (names, values) in rest.items():
            known(names, self.merge_many(values, width) if width else [array("I", self.merge(x)).tobytes() for x in values])
        pieces.new = []

    def merge_many(self, values: list[bytes], width: int) -> list[bytes]:
        """As merge(), for byte strings of at most `width` bytes, all of them a merge at a time."""
        count = len(values)
        if not count:
            return []
        size = np.fromiter(map(len, values), np.int64, count)
        text = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in values]), np.uint8).reshape(count, width)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, np.array(self.byte_ranks, np.int32)[text], -1)
        ids = np.concatenate([ids, np.full((count, 1), -1, np.int32)], axis=1)
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int8), (count, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int8), (count, width + 1)).copy()
        first = np.array(self.pair_ranks, np.int32)[(text[:, :-1].astype(np.int64) << 8) | text[:, 1:]]
        heap = _Heaps(count, width)
        heap.levels[0].reshape(count, width)[:, :-1] = np.where(inside[:, 1:] & (first >= 0), first * width + np.arange(width - 1), _NONE)
        heap.build()
        rows = np.arange(count)
        while True:
            root = heap.least(rows)
            live = root != _NONE
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            rank, i = np.divmod(root, width)
            j = after[rows, i]
            stop = after[rows, j]
            ids[rows, i], ids[rows, j] = rank, -1
            after[rows, i], before[rows, stop] = stop, i
            right = self.pairs.get(rank, ids[rows, stop])
            h = before[rows, i]
            own = np.flatnonzero(h >= 0)
            left = self.pairs.get(ids[rows[own], h[own]], rank[own])
            heap.renew(
                np.concatenate([rows, rows, rows[own]]),
                np.concatenate([i, j, h[own]]).astype(np.int64),
                np.concatenate([np.where(right >= 0, right * width + i, _NONE), np.full(len(rows), _NONE), np.where(left >= 0, left * width + h[own], _NONE)]),
            )
        flat = ids[ids >= 0].astype("<u4").tobytes()
        ends = (np.cumsum((ids >= 0).sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, data: bytes) -> list[int]:
        """Ids of a pre-token by merging its lowest-ranked pair, the leftmost of equals, until none is left."""
        n, rank_of = len(data), self.ranks.get
        ids = list(map(self.byte_ranks.__getitem__, data))
        after, before = list(range(1, n + 1)), list(range(-1, n))  # links between the parts by their first bytes
        pairs = list(map(self.pair_ranks.__getitem__, map(int.__add__, map((256).__mul__, data), data[1:])))
        pairs.append(-1)  # at a part's first byte: the rank of this part with the next, -1 if none
        heap = [r * n + i for i, r in enumerate(pairs) if r >= 0]
        heapify(heap)
        while heap:
            rank, i = divmod(pop(heap), n)
            if pairs[i] != rank:
                continue  # either part has changed since
            ids[i] = rank
            stop = after[j := after[i]]
            after[i], pairs[j] = stop, -1
            if stop < n:
                before[stop] = i
                pairs[i] = r = rank_of(data[i : after[stop]], -1)
                if r >= 0:
                    push(heap, r * n + i)
            else:
                pairs[i] = -1
            if i:
                h = before[i]
                pairs[h] = r = rank_of(data[h:stop], -1)
                if r >= 0:
                    push(heap, r * n + h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


class _Heaps:
    """Heaps of one size beside each other; a node holds the least of its FAN children, the root the least of all."""

    def __init__(self, count: int, width: int):
        self.widths, self.levels = [], []
        while True:
            self.widths.append(width)
            self.levels.append(np.full(count * width, _NONE, np.int32))
            if width == 1:
                break
            width //= FAN

    def build(self) -> None:
        for below, above in zip(self.levels, self.levels[1:]):
            above[:] = below.reshape(-1, FAN).min(axis=1)

    def least(self, rows: np.ndarray) -> np.ndarray:
        return self.levels[-1][rows]

    def renew(self, rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
        """Give leaves new values, and the nodes above them theirs."""
        at = rows * self.widths[0] + places
        self.levels[0][at] = values
        for below, above in zip(self.levels, self.levels[1:]):
            at = at // FAN
            child = at * FAN
            above[at] = np.minimum(np.minimum(below[child], below[child + 1]), np.minimum(below[child + 2], below[child + 3]))


class _PairTable:
    """Rank of the string that two tokens make together, by their ranks; -1 if it is none. Open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        made = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = rank
        self.mask = (1 << max(4, (4 * len(made)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        keys, values = np.array(list(made), np.int64), np.array(list(made.values()), np.int32)
        slots = self._slots(keys)
        while len(keys):
            first = np.unique(slots, return_index=True)[1]
            put = first[self.keys[slots[first]] == -1]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32) | b
        keys[(a < 0) | (b < 0)] = -2
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], -1)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.ranks[slots[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out


def codec_of(shared, pattern: str, remembered: int = REMEMBERED) -> Codec:
    """This worker's codec for a broadcast (name, ranks, table), with what it remembers."""
    name, ranks, table = shared.value
    return kept((name, pattern, remembered), lambda: Codec(ranks, pattern, table, remembered))


def share_ranks(spark, ranks_path: str):
    """Broadcast of the ranks (a file of bounded size, read by the driver) and their perfect hash."""
    ranks = read_ranks(ranks_path)
    name = xxhash.xxh64_hexdigest(repr(sorted(ranks.items(), key=lambda x: x[1])).encode())
    return spark.sparkContext.broadcast((name, ranks, PerfectHash(ranks)))


def encode_documents(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None, decode: bool = False
) -> DataFrame:
    """`df` with `ids` (binary, little-endian unsigned 32-bit) and, if asked for, `decoded` (binary).

    A map over partitions: no shuffle, memory bounded by a batch and the remembered pre-tokens.
    """
    shared = share_ranks(df.sparkSession, ranks_path)

    def make():
        codec = codec_of(shared, pattern)

        def work(texts: pa.Array) -> dict:
            ids = codec.encode([x or "" for x in texts.to_pylist()])
            return {"ids": ids} | ({"decoded": [codec.decode(x) for x in ids]} if decode else {})

        return work

    fields = [T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.BinaryType())] * decode
    return map_texts(df, text_col, make, T.StructType(fields), df.columns if carry is None else carry)


def decode_documents(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with `decoded` (binary), the bytes that the ids of `ids_col` stand for; null ids give no bytes."""
    shared = share_ranks(df.sparkSession, ranks_path)
    carry = [c for c in df.columns if c != "decoded"]
    schema = df.select(*[f"`{c}`" for c in carry]).schema.add("decoded", T.BinaryType())
    at = carry.index(ids_col)

    def run(parts):
        codec = codec_of(shared, r"\S+|\s+")
        for part in parts:
            out = pa.array([codec.decode(x or b"") for x in part.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*carry, "decoded"])

    return df.select(*[f"`{c}`" for c in carry]).mapInArrow(run, schema)
