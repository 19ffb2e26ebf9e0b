"""Quality scores by histogram gradient-boosted trees over statistics of a text.

The statistics are counted from the bytes of a whole batch at once. Trees are fitted on the driver over at most
about MAX_LABELLED labelled rows (numbers only, no texts), on binned statistics, and are kept as flat arrays in
which all rows of a batch descend a level at a time.

Defined results: a null text counts as the empty one, whose statistics are zero, and has a score like any other;
rows without a label, or with a null one, are not learned from; of several labels of one id each is learned; with
no labels at all, or only one kind, every score is the share of ones (one half without any). Columns of the input
are carried along whatever their names, except those named like outputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shelf, cut, map_texts, quoted

#: The trees are fitted on about this many labelled rows, taken by a hash of their id.
MAX_LABELLED = 20_000

_KINDS = "other lower upper digit space newline period comma exclaim mark hash bar quote bracket high lead".split()
_KIND = np.zeros(256, np.uint8)
for _name, _bytes in (
    ("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("newline", (10,)), ("period", b".?"), ("comma", b",;:-"),
    ("exclaim", b"!"), ("mark", b"$%&*+=~^"), ("hash", b"#@\\/_<>"), ("bar", b"|"), ("quote", b"'\"`"), ("bracket", b"()[]{}"), ("high", range(0x80, 0xC0)), ("lead", range(0xC0, 0x100)),
):
    for _b in _bytes:
        _KIND[_b] = _KINDS.index(_name)

STATISTICS = [*_KINDS, "size", "words", "word_length", "line_length", "distinct_words", "distinct_lines", "short_words", "capital_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    values = [t or "" for t in texts.to_pylist()]
    data = [v.encode() for v in values]
    size = np.fromiter(map(len, data), np.int64, len(data))
    kinds = _KIND[np.frombuffer(b"".join(data), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(data)) * 16, size) + kinds, minlength=16 * len(data)).reshape(-1, 16).astype(float)
    lines = [v.split("\n") for v in values]
    words = [v.split() for v in values]
    n_words = np.fromiter(map(len, words), float, len(words))
    some = np.maximum(n_words, 1)
    own = np.array(
        [
            np.log1p(size),
            np.log1p(n_words),
            (size - counts[:, 4] - counts[:, 5]) / some,
            np.log1p(size / (counts[:, 5] + 1)),
            np.fromiter((len(set(w)) for w in words), float, len(words)) / some,
            np.fromiter((len(set(x)) / len(x) for x in lines), float, len(lines)),
            np.fromiter((sum(len(x) < 4 for x in w) for w in words), float, len(words)) / some,
            np.fromiter((sum(x.isupper() for x in w) for w in words), float, len(words)) / some,
        ]
    ).T
    out = np.hstack([counts / np.maximum(size, 1)[:, None], own])
    out[size == 0] = 0
    return out


class Trees:
    """Boosted trees in flat arrays: feature, limit, left and right node (a leaf is its own child), value."""

    def __init__(self, base: float):
        self.base, self.roots, self.depth = base, np.zeros(0, np.int64), 0
        self.feature, self.limit, self.left, self.right, self.value = (np.zeros(0, k) for k in (np.int64, float, np.int64, np.int64, float))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 2.0) -> Trees:
    """Logistic gradient boosting on histograms of `bins` quantile bins."""
    share = float(y.mean()) if len(y) else 0.5
    model = Trees(float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))) if len(y) else 0.0)
    if len(np.unique(y)) < 2:
        return model
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.array([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).T
    keys = binned + np.arange(width) * bins
    feature, limit, left, right, value, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int) -> int:
        node = len(feature)
        for parts, v in ((feature, 0), (limit, np.inf), (left, node), (right, node), (value, rate * -g[rows].sum() / (h[rows].sum() + 1))):
            parts.append(v)
        if level == depth or len(rows) < 8:
            return node
        flat = keys[rows].ravel()
        gs = np.bincount(flat, np.repeat(g[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
        hs = np.bincount(flat, np.repeat(h[rows], width), width * bins).reshape(width, bins).cumsum(axis=1)
        g_all, h_all = gs[0, -1], hs[0, -1]
        gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
        gain[(hs < least) | (h_all - hs < least)] = 0
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] <= 1e-9 or b >= len(edges[f]):
            return node
        low = binned[rows, f] <= b
        feature[node], limit[node], value[node] = int(f), float(edges[f][b]), 0.0
        left[node] = grow(rows[low], g, h, level + 1)
        right[node] = grow(rows[~low], g, h, level + 1)
        return node

    total = np.full(n, model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-6), 0))
        one = Trees(0.0)
        one.depth, one.roots = depth, np.array(roots[-1:])
        one.feature, one.limit, one.left, one.right, one.value = np.array(feature), np.array(limit, float), np.array(left), np.array(right), np.array(value)
        at = np.full(n, roots[-1])
        for _ in range(depth):
            at = np.where(x[np.arange(n), one.feature[at]] <= one.limit[at], one.left[at], one.right[at])
        total += one.value[at]
    one.base, one.roots = model.base, np.array(roots)
    return one


def learn(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees for `features` (id, x) whose ids have a label; about `max_labelled` of them reach the driver."""
    known = features.join(labels.select(F.col(id_col).alias("__label_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL"), F.col(id_col) == F.col("__label_id"))
    known = known.select("x", "y", F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("h"))
    share = min(1.0, max_labelled / max(1, labels.count()))
    rows = known.where(F.col("h") < int(share * (1 << 30))).select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T)  # the fit does not depend on the order of rows
    return fit(x[order], rows["y"].to_numpy(float)[order])


def score_quality(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """`df` with score (0 to 1) and predicted (1 from `limit` on); `train` has ids and labels to learn from.

    The texts are read once: their statistics are written to the shared folder, learned from, then scored.
    """
    shelf = Shelf(df.columns if carry is None else carry, ("score", "predicted"))
    carry = shelf.keys
    rows = df.select(*shelf.put, quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    outputs = T.StructType().add("x", T.ArrayType(T.DoubleType()))
    features = cut(map_texts(rows, "text", lambda: lambda texts: {"x": statistics(texts).tolist()}, outputs, [*carry, "id"]))
    model = learn(features.select("id", "x"), train.select(quoted(id_col).alias("id"), quoted(label_col).alias("label")), "id", "label")
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*features.select(*carry).schema, *T.StructType().add("score", "double").add("predicted", "integer")])

    def run(parts):
        for part in parts:
            x = part.column(len(carry)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            score = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(score), pa.array((score >= limit).astype(np.int32))], names=schema.names)

    return features.select(*carry, "x").mapInArrow(run, schema).select(*shelf.back, "score", "predicted")
