"""Substring deduplication by hashing lines or paragraphs, and passages inside them.

A text is cut into units (lines, or paragraphs between blank lines), each is normalised (A-Z lower-cased, white
space runs made one space, ends stripped) and hashed to 128 bits. Digests are grouped over all texts; of the units
with one digest the earliest by (id, place in the text) stays, and the others are removed, with their places in
the original text retained. Every unit with a word counts, however short.

A repeated passage often begins and ends inside a line. So the same is done with passages: from each sentence on,
the fewest whole sentences that have PASSAGE_WORDS words together. What is removed of a text is all that its
removed units and passages cover; the earliest occurrence of each keeps its place somewhere in the corpus.

The rows of units are written once. Counting them by digest sends partial results, so a unit that everyone has is
no burden there; the rows of such a digest then meet their counts without a shuffle (see look_up).

Defined results: null, empty and blank texts have no units; rows with one id and different texts are different
texts, ordered by a hash; rows that are equal in id and text are one text; a null id is smaller than any other;
other columns are carried along whatever their names, except those named like outputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, Shelf, batches, look_up, quoted, stored

#: Words of a passage, at least; None as a parameter leaves passages out.
PASSAGE_WORDS = 20

UNIT_ENDS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[^\S\n]*\n\s*")}
_SENTENCE_ENDS = re.compile(r"(?<=[.!?])\s+|\n")
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

TEXT, UNIT, PASSAGE = 0, 1, 2


class Cut:
    """The sentences of a text, and its normalised words as one string of bytes in which any run of sentences is a slice."""

    def __init__(self, text: str, ends: re.Pattern = _SENTENCE_ENDS):
        self.places: list[tuple[int, int, int]] = []  # number, start, end
        self.words, self.edges, pieces = [0], [0], []
        at = 0
        for n, m in enumerate([*ends.finditer(text), None]):
            end = m.start() if m else len(text)
            words = text[at:end].split()
            if words:
                piece = " ".join(words).encode()
                pieces.append(piece)
                self.places.append((n, at, end))
                self.words.append(self.words[-1] + len(words))
                self.edges.append(self.edges[-1] + len(piece) + 1)
            at = m.end() if m else end
        self.norm = b" ".join(pieces).translate(_FOLD)

    def digest(self, first: int, last: int) -> tuple[int, bytes]:
        """Number and digest of the words of the sentences first, ..., last - 1."""
        return self.words[last] - self.words[first], xxhash.xxh3_128_digest(self.norm[self.edges[first] : self.edges[last] - 1])


def _whole(cut: Cut, min_words: int) -> list[tuple[int, int, int, int, bytes]]:
    found = ((p, a, b, *cut.digest(i, i + 1)) for i, (p, a, b) in enumerate(cut.places))
    return [x for x in found if x[3] >= min_words]


def _lines(text: str, cut: Cut, min_words: int) -> list[tuple[int, int, int, int, bytes]]:
    """As units_of() for lines; no sentence goes over a line's end."""
    out, i, n, start = [], 0, len(cut.places), 0
    for place, line in enumerate(text.split("\n")):
        end, first = start + len(line), i
        while i < n and cut.places[i][1] <= end:
            i += 1
        if i > first and cut.words[i] - cut.words[first] >= min_words:
            out.append((place, start, end, *cut.digest(first, i)))
        start = end + 1
    return out


def _passages(cut: Cut, least: int) -> list[tuple[int, int, int, int, bytes]]:
    out, last, n = [], 0, len(cut.places)
    for i, (place, start, _) in enumerate(cut.places):
        while last < n and cut.words[last] - cut.words[i] < least:
            last += 1
        if cut.words[last] - cut.words[i] < least:
            break
        out.append((place, start, cut.places[last - 1][2], *cut.digest(i, last)))
    return out


def units_of(text: str | None, unit: str = "line", min_words: int = 1) -> list[tuple[int, int, int, int, bytes]]:
    """(place, start, end, words, digest) of each unit; offsets count characters."""
    return _whole(Cut(text or "", UNIT_ENDS[unit]), min_words)


def passages_of(text: str | None, least: int = PASSAGE_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(place, start, end, words, digest) of the passage that begins with each sentence, if enough words follow."""
    return _passages(Cut(text or ""), least)


def _both(text: str | None, unit: str, min_words: int, passage_words: int | None) -> tuple[list, list]:
    if not text:
        return [], []
    if not passage_words:
        return units_of(text, unit, min_words), []
    cut = Cut(text)
    return _lines(text, cut, min_words) if unit == "line" else units_of(text, unit, min_words), _passages(cut, passage_words)


def explode_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """Rows (id, hash, level, place, start, end, words, k1, k2) of `df`, a map over partitions.

    A row of level TEXT stands for each text, with the numbers of its units and passages as start and end.
    """
    text = quoted(text_col).cast("string")
    kept = df.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    schema = T.StructType([*kept.schema.fields[:2], *T.StructType().add("level", "integer").add("place", "integer").add("start", "integer").add("end", "integer").add("words", "integer").add("k1", "long").add("k2", "long")])

    def run(parts):
        for part in parts:
            for a, b in batches(part.column(2)):
                which, level, found = [], [], []
                for i, text in enumerate(part.column(2).slice(a, b - a).to_pylist(), a):
                    units, passages = _both(text, unit, min_words, passage_words)
                    found.append((0, len(units), len(passages), 0, bytes(16)))
                    found += units
                    found += passages
                    which += [i] * (1 + len(units) + len(passages))
                    level += [TEXT, *[UNIT] * len(units), *[PASSAGE] * len(passages)]
                columns = list(zip(*found))
                keys = np.frombuffer(b"".join(columns[4]), np.int64).reshape(-1, 2)
                rows = pa.array(which, pa.int64())
                numbers = [pa.array(x, pa.int32()) for x in (level, *columns[:4])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *numbers, pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], names=schema.names)

    return kept.mapInArrow(run, schema)


def repeated_units(units: DataFrame) -> DataFrame:
    """The rows of written `units` whose digest occurs more than once, with `first` (id, hash, place) and `copies`."""
    real = units.where(F.col("level") > TEXT)
    # nulls sort first in a struct, as in the definition; equal rows are one occurrence
    once = real.select("level", "k1", "k2", F.struct("id", "hash", "place").alias("at"))
    groups = once.groupBy("level", "k1", "k2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("copies"))
    return look_up(real, stored(groups.where("first <> last")), ["level", "k1", "k2"], "copies")


def _later() -> F.Column:
    return ~F.struct("id", "hash", "place").eqNullSafe(F.col("first"))


def removed_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, passage_words: int | None = None) -> DataFrame:
    """A row for each unit to remove: id, level, unit, start, end (characters of the original text), words, keep_id, keep_unit, copies."""
    found = repeated_units(stored(explode_units(df, id_col, text_col, unit, min_words, passage_words))).where(_later())
    return found.select(F.col("id").alias(id_col), "level", F.col("place").alias("unit"), "start", "end", "words", F.col("first.id").alias("keep_id"), F.col("first.place").alias("keep_unit"), "copies")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover what `spans` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without `spans`; the line end of a line that goes as a whole goes too."""
    gone = merged([{"start": a, "end": b + (b < len(text) and text[b] == "\n" and (a == 0 or text[a - 1] == "\n"))} for a, b in spans])
    if gone and gone[-1][1] == len(text) and gone[-1][0] > 0 and text[gone[-1][0] - 1] == "\n":
        gone[-1] = gone[-1][0] - 1, len(text)
    edges = [0, *[x for s in gone for x in s], len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


_SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def document_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """A row for each text: its id and hash, n_units and n_passages, how many of each are removed, n_passages_shared (they occur elsewhere too, kept or not), n_removed (characters) and the removed spans."""
    units = stored(explode_units(df, id_col, text_col, unit, min_words, passage_words))
    found = repeated_units(units).select("id", "hash", "level", "start", "end", _later().alias("later")).distinct()
    texts = units.where(F.col("level") == TEXT).select("id", "hash", F.lit(TEXT).alias("level"), "start", "end", F.lit(False).alias("later")).distinct()
    whole, is_unit, is_passage = F.col("level") == TEXT, F.col("level") == UNIT, F.col("level") == PASSAGE
    rows = found.unionByName(texts).groupBy("id", "hash").agg(
        F.max(F.when(whole, F.col("start"))).cast("long").alias("n_units"),
        F.count_if(is_unit & F.col("later")).alias("n_units_removed"),
        F.max(F.when(whole, F.col("end"))).cast("long").alias("n_passages"),
        F.count_if(is_passage & F.col("later")).alias("n_passages_removed"),
        F.count_if(is_passage).alias("n_passages_shared"),
        F.collect_list(F.when(F.col("later"), F.struct("start", "end"))).alias("spans"),
    )
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("spans", _SPANS), T.StructField("n_removed", T.LongType())])

    def run(parts):
        for part in parts:
            spans = [merged(x) for x in part.column(part.num_columns - 1).to_pylist()]
            lists = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = 1, passage_words: int | None = None) -> DataFrame:
    """`df` with spans (what is removed, in characters; null in rows without) and deduplicated, the text without it."""
    report = document_report(df, id_col, text_col, unit, min_words, passage_words).where("n_removed > 0").select(F.col("id").alias("id2"), F.col("hash").alias("hash2"), "spans")
    shelf = Shelf(df.columns, ("spans", "deduplicated"))
    text = quoted(text_col).cast("string")
    rows = df.select(*shelf.put, quoted(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    joined = rows.join(report, F.col("id").eqNullSafe(F.col("id2")) & (F.col("hash") == F.col("hash2")), "left").select(*shelf.keys, "text", "spans")
    schema = T.StructType([*joined.schema.fields[:-2], T.StructField("spans", _SPANS), T.StructField("deduplicated", T.StringType())])
    n = len(shelf.keys)

    def run(parts):
        for part in parts:
            for a, b in batches(part.column(n)):
                texts, spans = part.column(n).slice(a, b - a).to_pylist(), part.column(n + 1).slice(a, b - a)
                out = [t if not s else without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans.to_pylist())]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in part.columns[:n]], spans, pa.array(out, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema).select(*shelf.back, "spans", "deduplicated")
