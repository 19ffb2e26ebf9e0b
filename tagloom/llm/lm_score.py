"""Language-model scores by stupid backoff over the corpus' own n-grams of words.

Texts are dealt into blocks of bounded size by a hash. The n-grams of a block's documents, each once with its count,
are exploded over the count tables, of which there is one for each part of the hashes' range; a block's n-grams of
one part travel as one row (sorted hashes, counts). A table adds up the counts of all blocks and gives each block
its n-grams' counts in the whole corpus, which are joined to the n-grams of the block's documents and summed per
document. An n-gram is in at most one row of a block, so the most frequent one weighs 8 bytes for each block of 16 MB.
(Rows for each n-gram of each document would be 42 million for 0.1 GB, about 0.5 GB in one shuffle of several.)

A word after a history of up to ORDER - 1 words of its text scores log(count of both / count of the history) if the
two together occur `least` times in the corpus, and otherwise the logarithm of BACKOFF plus the score after the
history less its first word; without a history, log(count / all words). The n-gram of no words, whose count is that
of all words, is a row of each block as well. N-grams are told apart by hashes of 64 bits. The table grows with the
corpus: each word adds an n-gram of each size, and most are new.

Defined results: words are what ASCII white space separates; null, empty and blank texts have none and score 0, their
mean too; texts of any length are scored whole; repeated rows count and score as often as they occur; a table
without rows gives none. Columns of the input are carried along whatever their names, except those named like
outputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shelf, quoted

ORDER = 2
BACKOFF = 0.4
LEAST = 2

#: Bytes of text in a block, and of hashes in a count table, about.
BLOCK_BYTES = 16 << 20
TABLE_BYTES = 32 << 20

OUTPUTS = ("n_words", "log_score", "mean_score")

#: Key of the n-gram of no words.
NOTHING = np.uint64(0x5851F42D4C957F2D)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Grams:
    """Word n-grams of texts: of each size the keys and counts, the numbers of their histories and of what a backoff leaves."""

    def __init__(self, texts: list[str | None], order: int = ORDER):
        number: dict[bytes, int] = {}
        parts = []
        for t in texts:
            words = (t or "").encode().split()
            parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)
        self.place = (np.arange(len(self.doc)) - np.repeat(np.cumsum(self.size) - self.size, self.size)).astype(np.int32)
        ids = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int64)
        one = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        self.keys, self.counts, self.at = [one], [np.bincount(ids, minlength=len(number))], [ids]
        self.history, self.rest = [np.zeros(len(number), np.int64)], [None]
        for n in range(1, order):
            where = np.flatnonzero(self.place >= n)
            kinds, first, which, count = np.unique(self.at[-1][where - 1] * len(number) + ids[where], return_index=True, return_inverse=True, return_counts=True)
            history, last = np.divmod(kinds, max(1, len(number)))
            self.keys.append(_mixed(self.keys[-1][history] * np.uint64(0x9E3779B97F4A7C15) + one[last] + np.uint64(n)))
            self.counts.append(count)
            self.history.append(history)
            self.rest.append(self.at[-1][where[first]])
            at = np.full(len(ids), -1, np.int64)
            at[where] = which
            self.at.append(at)

    def rows(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts, keys and counts of all n-grams, that of no words among them, in order of part and key."""
        keys = np.concatenate([[NOTHING], *self.keys])
        part = (keys >> np.uint64(32)) % np.uint64(parts)
        self.order = np.lexsort((keys, part))
        return part[self.order].astype(np.int64), keys[self.order], np.concatenate([[len(self.doc)], *self.counts])[self.order]

    def learn(self, counts: np.ndarray) -> int:
        """Take counts of the whole corpus, in the order of rows(), and return that of all words."""
        now = np.empty(len(counts), np.int64)
        now[self.order] = counts
        ends = np.cumsum([1, *map(len, self.counts)])
        self.counts = [now[a:b] for a, b in zip(ends, ends[1:])]
        return int(now[0])

    def scores(self, total: int, least: int = LEAST, backoff: float = BACKOFF) -> np.ndarray:
        """Each text's score by the counts as they are."""
        below, out = np.array([max(1, total)]), np.zeros(len(self.doc))
        for n, own in enumerate(self.counts):
            exact = np.log(own / below[self.history[n]])
            score = exact if n == 0 else np.where(own >= least, exact, math.log(backoff) + score[self.rest[n]])
            has = self.place >= n
            out[has] = score[self.at[n][has]]
            below = own
        return np.bincount(self.doc, out, len(self.size)).astype(np.float64)


def exploded_grams(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """Rows (part, block, grams, counts) of documents (block, text, ...) dealt out by block."""
    schema = T.StructType().add("part", "integer").add("block", "integer").add("grams", "binary").add("counts", "binary")

    def explode(key, rows):
        part, grams, counts = Grams(rows.column(1).to_pylist(), order).rows(parts)
        own, first = np.unique(part, return_index=True)
        ends = np.append(first[1:], len(part))
        columns = [[x[a:b].tobytes() for a, b in zip(first, ends)] for x in (grams, counts.astype("<u4"))]
        return pa.table([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), key[0].as_py(), np.int32)), *map(pa.array, columns)], names=schema.names)

    return docs.groupBy("block").applyInArrow(explode, schema)


def corpus_counts(exploded: DataFrame) -> DataFrame:
    """Rows (block, part, counts): for each row of `exploded` its n-grams' counts in all blocks; a table is one group."""
    schema = T.StructType().add("block", "integer").add("part", "integer").add("counts", "binary")

    def add(rows: pa.Table) -> pa.Table:
        grams = [np.frombuffer(x, "<u8") for x in rows.column(2).to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column(3).to_pylist()])
        kinds, which = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(which, counts, len(kinds)).astype("<u8")[which]
        ends = np.cumsum([0, *map(len, grams)])
        # most counts are small
        parts = [x.astype("<u4") if x.max(initial=0) < 1 << 32 else x for x in (total[a:b] for a, b in zip(ends, ends[1:]))]
        return pa.table([rows.column(1), rows.column(0), pa.array([x.tobytes() for x in parts], pa.binary())], names=schema.names)

    return exploded.groupBy("part").applyInArrow(add, schema)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, least: int = LEAST, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, table_bytes: int = TABLE_BYTES, carry: list[str] | None = None) -> DataFrame:
    """`df` with n_words, log_score (the sum of its words' scores by the n-grams of all of `df`) and mean_score (per word)."""
    if order < 1:
        raise ValueError("n-grams have a word at least")
    shelf = Shelf(df.columns if carry is None else carry, OUTPUTS)
    text = quoted(text_col).cast("string")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    # a word and the space after it are six bytes or so, and each word begins `order` n-grams of eight
    parts = max(1, -(-size * order * 8 // (6 * table_bytes)))
    block = F.pmod(F.xxhash64(quoted(id_col), text), F.lit(blocks)).cast("int")
    docs = df.select(block.alias("block"), text.alias("text"), *shelf.put).repartition("block")
    table = corpus_counts(exploded_grams(docs, order, parts))
    schema = T.StructType([*docs.schema.fields[2:], *T.StructType().add("n_words", "long").add("log_score", "double")])

    def score(rows, table):
        grams = Grams(rows.column(1).to_pylist(), order)
        part, _, _ = grams.rows(parts)
        counts = dict(zip(table.column(1).to_pylist(), table.column(2).to_pylist()))
        found = [(counts[k], n) for k, n in zip(*(x.tolist() for x in np.unique(part, return_counts=True)))]
        total = grams.learn(np.concatenate([np.frombuffer(x, "<u4" if len(x) == 4 * n else "<u8").astype(np.int64) for x, n in found]))
        return pa.table([*rows.columns[2:], pa.array(grams.size), pa.array(grams.scores(total, least, backoff))], names=schema.names)

    scored = docs.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(score, schema)
    return scored.select(*shelf.back, "n_words", "log_score", (F.col("log_score") / F.greatest("n_words", F.lit(1))).alias("mean_score"))
