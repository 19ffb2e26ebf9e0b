"""Packing token ids into rows of one length by best-fit decreasing.

Each task encodes its documents and packs them in blocks of bounded size. A document of more ids than a row has is
split into whole rows and a rest, so nothing is lost; the pieces of a block, largest first, go to the open row with
the least room that is enough, which a segment tree over the rooms finds in log steps. A packed row holds its ids
(padded), the cumulative lengths of its segments, positions that restart with each segment, and for each segment
the document and the offset in the document's ids at which it starts.

Defined results: null and empty texts have no ids and are in no row; repeated rows are packed as often as they
occur; a null id stays null. Which rows a document shares depends on how the input is partitioned; what each
segment holds does not. Columns besides id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import batches, quoted
from .byte_bpe import codec_of, share_ranks

ROW = 2048

#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 700_000

#: Ids that a task holds before it packs them.
BLOCK_IDS = 2 << 20



class Rooms:
    """Open rows by room left: a segment tree over rooms 0..size, whose nodes count the rows below."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int]:
        """A row with the least room of at least `need`, and that room; (-1, 0) if there is none."""
        count, i = self.count, need + self.base
        if not count[i]:
            # up to the first ancestor with something to the right, then down its left edge
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return -1, 0
            i += 1
            while i < self.base:
                i *= 2
                if not count[i]:
                    i += 1
        room = i - self.base
        self._add(room, -1)
        return self.rows[room].pop(), room


def pack(sizes: list[int], row: int = ROW) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, offset, length) for documents of these sizes."""
    pieces = [(min(row, n - a), d, a) for d, n in enumerate(sizes) for a in range(0, n, row)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    rooms, rows = Rooms(row), []
    for n, d, a in pieces:
        at, room = rooms.take(n)
        if at < 0:
            at, room = len(rows), row
            rows.append([])
        rows[at].append((d, a, n))
        if room > n:
            rooms.put(at, room - n)
    return rows


def pack_documents(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", row: int = ROW, block_ids: int = BLOCK_IDS, pad: int | None = None) -> DataFrame:
    """Packed rows: doc_ids, offsets, lengths, cu_seqlens, input_ids and position_ids (both little-endian unsigned 32-bit), n_ids.

    Room that is left has the id `pad`, the first that the vocabulary has free if none is named.
    """
    kept = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    shared = share_ranks(df.sparkSession, ranks_path)
    if pad is None:
        pad = max(shared.value[1].values(), default=-1) + 1
    kind = kept.schema["id"].dataType
    schema = T.StructType()
    for name, t in (("doc_ids", T.ArrayType(kind)), ("offsets", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.IntegerType())), ("cu_seqlens", T.ArrayType(T.IntegerType())), ("input_ids", T.BinaryType()), ("position_ids", T.BinaryType()), ("n_ids", T.IntegerType())):
        schema = schema.add(name, t)

    def run(parts):
        codec = codec_of(shared, pattern, REMEMBERED)
        names: list = []
        ids: list[np.ndarray] = []

        def packed(kinds):
            rows = pack([len(x) for x in ids], row)
            for start in range(0, len(rows), 256):
                out: list[list] = [[] for _ in schema.names]
                for segments in rows[start : start + 256]:
                    lengths = [n for _, _, n in segments]
                    matrix, places = np.full(row, pad, "<u4"), np.zeros(row, "<u4")
                    at = 0
                    for d, a, n in segments:
                        matrix[at : at + n], places[at : at + n] = ids[d][a : a + n], np.arange(n)
                        at += n
                    cumulative = [0, *np.cumsum(lengths).tolist()]
                    for column, v in zip(out, ([names[d] for d, _, _ in segments], [a for _, a, _ in segments], lengths, cumulative, matrix.tobytes(), places.tobytes(), at)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=schema.names)

        for part in parts:
            own = part.schema.field(0).type
            kinds = [pa.list_(own), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32()]
            for a, b in batches(part.column(1)):
                found = codec.encode([t or "" for t in part.column(1).slice(a, b - a).to_pylist()])
                names.extend(part.column(0).slice(a, b - a).to_pylist())
                ids.extend(np.frombuffer(x, "<u4") for x in found)
                if sum(map(len, ids)) >= block_ids:
                    yield from packed(kinds)
                    names, ids = names[:0], ids[:0]
        if ids:
            yield from packed(kinds)

    return kept.mapInArrow(run, schema)


def segments(packed: DataFrame) -> DataFrame:
    """Rows (doc_id, offset, ids) of the packed segments: a document's, in order, are its ids."""
    from pyspark.sql import functions as F

    one = F.explode(F.expr("transform(doc_ids, (d, i) -> struct(d AS doc_id, offsets[i] AS offset, substring(input_ids, 4 * cu_seqlens[i] + 1, 4 * lengths[i]) AS ids))"))
    return packed.select(one.alias("s")).select("s.*")
