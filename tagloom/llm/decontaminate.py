"""Benchmark decontamination with a Wu-Manber multi-pattern search over words.

A window is 13 consecutive words of a benchmark item (an item of fewer words is one window). Windows of one
length form one searcher: a table over blocks of two words says how far the search may move on, the block that
ends a window selects the windows to try, and a direct comparison confirms each occurrence.

Defined results: a null or empty text has no words, no hits and is not contaminated; null or word-less items
have no windows; equal windows of several items count for all of them; an item id of null is left out of the
list of items, though its windows hit; without benchmark rows nothing is hit. Columns of the input are carried
along whatever their names, except those named like outputs.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, Shelf, cut, kept, map_texts, quoted

WINDOW = 13

#: Characters of all windows sent to the executors at once; beyond it the search takes several passes.
MAX_BLOCK_CHARS = 64 << 20

# Lower-cases A-Z, and makes every ASCII character that no word has a space; bytes from 0x80 on are of words.
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(ord(LOWER[UPPER.index(chr(c))]) if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))




def split_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


class Searcher:
    """Wu-Manber over word sequences of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end] if self.block > 1 else window[end - 1]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[key][window] = items

    def search(self, words: list[bytes], hit: bytearray, found: set) -> None:
        n, m, far, shift, buckets = len(words), self.length, self.far, self.shift.get, self.buckets
        blocks = list(zip(words, words[1:])) if self.block > 1 else words
        back = self.block  # a block that ends before word `end` is blocks[end - back]
        end = m
        while end <= n:
            block = blocks[end - back]
            move = shift(block, far)
            if move:
                end += move
                continue
            items = buckets[block].get(tuple(words[end - m : end]))
            if items is not None:
                hit[end - m : end] = b"\1" * m
                found.update(items)
            end += 1


def searchers(windows: list[tuple[str, list]]) -> list[Searcher]:
    by_length: dict[int, dict] = defaultdict(dict)
    for window, items in windows:
        key = tuple(window.encode().split(b" "))
        by_length[len(key)].setdefault(key, []).extend(items)
    return [Searcher(w, n) for n, w in sorted(by_length.items())]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int = WINDOW) -> DataFrame:
    """Rows (window, items): each distinct window, its words joined by spaces, and the ids (as text) that have it."""
    words = F.expr(f"filter(split(regexp_replace(translate(`{text_col}`, '{UPPER}', '{LOWER}'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+', ' '), ' '), x -> x != '')")
    return (
        benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> array_join(slice(w, i, {size}), ' '))")).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def _blocks(windows: DataFrame, limit: int):
    block, chars = [], 0
    for row in windows.toLocalIterator():
        size = len(row.window) + sum(map(len, row["items"]))
        if block and chars + size > limit:
            yield block
            block, chars = [], 0
        block.append((row.window, list(row["items"])))
        chars += size
    if block:
        yield block


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: int = 20,
    carry: list[str] | None = None,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """`df` with n_words, n_hit, hits (binary, a byte for each word), items (array) and contaminated.

    A map over partitions. Windows are sent in blocks of `max_block_chars` at most; each block after the first
    is a further pass over what the one before has written to the shared folder.
    """
    shelf = Shelf(df.columns if carry is None else carry, ("n_words", "n_hit", "hits", "items", "contaminated"))
    df = df.select(*shelf.put, quoted(text_col).alias("text"))
    text_col, carry = "text", [*shelf.keys, "text"]
    spark = df.sparkSession
    outputs = T.StructType().add("n_words", T.LongType()).add("hits", T.BinaryType()).add("items", T.ArrayType(T.StringType()))

    def one_pass(docs: DataFrame, block: list, first: bool) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def make():
            finders = kept(key, lambda: searchers(shared.value))

            def work(texts: pa.Array) -> dict:
                out: dict[str, list] = {"n_words": [], "hits": [], "items": []}
                for text in texts.to_pylist():
                    words = split_words(text)
                    hit, found = bytearray(len(words)), set()
                    for f in finders:
                        f.search(words, hit, found)
                    out["n_words"].append(len(words))
                    out["hits"].append(bytes(hit) if 1 in hit else b"")
                    out["items"].append(sorted(found))
                return out

            return work

        if first:
            return map_texts(docs, text_col, make, outputs, carry)
        old = docs.withColumnsRenamed({"hits": "__hits", "items": "__items"}).drop("n_words")
        new = map_texts(old, text_col, make, outputs, old.columns)
        # the bytes of both passes, each 0 or 1, a byte for each word
        either = F.expr("CASE WHEN length(hits) = 0 THEN __hits WHEN length(__hits) = 0 THEN hits ELSE unhex(array_join(transform(sequence(1, cast(n_words AS int)), i -> CASE WHEN substring(hits, i, 1) = X'01' OR substring(__hits, i, 1) = X'01' THEN '01' ELSE '00' END), '')) END")
        return new.withColumns({"hits": either, "items": F.sort_array(F.array_union("items", "__items"))}).drop("__hits", "__items")

    out, first = None, True
    for block in _blocks(benchmark_windows(benchmark, item_col, item_text_col), max_block_chars):
        out = one_pass(df, block, True) if first else one_pass(cut(out), block, False)
        first = False
    if out is None:
        out = one_pass(df, [], True)
    n_hit = F.length(F.regexp_replace(F.hex("hits"), "0", "")).cast("long")
    out = out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    return out.select(*shelf.back, "n_words", "n_hit", "hits", "items", "contaminated")
