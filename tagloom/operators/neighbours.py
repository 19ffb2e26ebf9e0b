"""Exact nearest neighbours of a block of queries among batches of points, in tiles of bounded size.

Distances are first taken from a product of matrices, with a bound for its rounding. Only pairs that the bound leaves
are worked out as the sum of squared differences, entry by entry, and by that sum they are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Points and queries of a tile, and pairs that are worked out at a time.
TILE = (2_048, 1_024)
PAIRS = 1 << 18

Vectors = tuple[np.ndarray, np.ndarray | None]


def _padded(values: np.ndarray, valid: np.ndarray | None, lengths: np.ndarray) -> Vectors:
    """Rows of equal length, and which entries there are; None if all are."""
    n = len(lengths)
    width = int(lengths.max()) if n else 0
    if valid is None and (lengths == width).all():
        return values.reshape(n, width), None
    out, there = np.zeros((n, width)), np.arange(width) < lengths[:, None]
    out[there] = values
    if valid is not None:
        there[there] = valid
        out[~there] = 0
    return out, there


def pack_vectors(rows: list) -> Vectors:
    return vectors_of(pa.array(rows, pa.list_(pa.float64())))


def vectors_of(column: pa.ListArray) -> Vectors:
    flat = column.flatten()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    valid = None if flat.null_count == 0 else flat.is_valid().to_numpy(zero_copy_only=False)
    return _padded(flat.fill_null(0.0).to_numpy(zero_copy_only=False), valid, lengths)


def _regular(vectors: Vectors, width: int) -> np.ndarray:
    """Rows of `width` finite entries whose squares can be added up."""
    values, there = vectors
    if values.shape[1] != width:
        return np.zeros(len(values), bool) if there is None else there[:, :width].all(1) & ~there[:, width:].any(1) & (values.shape[1] > width)
    fine = (np.abs(values) < 1e150).all(1)
    return fine if there is None else fine & there.all(1)


def distances(p: Vectors, q: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """For rows of p and q pairwise: the sum of squared differences in the entries' order, and whether there is none (null)."""
    total, none = np.zeros(len(p[0])), np.ones(len(p[0]), bool)
    with np.errstate(all="ignore"):
        for j in range(min(p[0].shape[1], q[0].shape[1])):
            d = p[0][:, j] - q[0][:, j]
            both = None
            for there in (p[1], q[1]):
                if there is not None:
                    both = there[:, j] if both is None else both & there[:, j]
            if both is None:
                total += d * d
                none[:] = False
            else:
                total = np.where(both, total + d * d, total)
                none &= ~both
    return total, none


def _take(v: Vectors, rows: np.ndarray) -> Vectors:
    return v[0][rows], None if v[1] is None else v[1][rows]


class _Best:
    """The best k of each query so far, as rows sorted by query, null, distance and id."""

    def __init__(self, queries: int, k: int, ids: np.ndarray):
        self.k, self.queries = k, queries
        self.q, self.none, self.d, self.ids = np.empty(0, np.int64), np.empty(0, bool), np.empty(0), ids[:0]
        self.bound = np.full(queries, np.inf)

    def add(self, q: np.ndarray, none: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        q, none, d, ids = np.concatenate([self.q, q]), np.concatenate([self.none, none]), np.concatenate([self.d, d]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, d, none, q))
        q = q[order]
        first = np.searchsorted(q, np.arange(self.queries + 1))
        place = np.arange(len(q)) - first[q]
        order, q = order[place < self.k], q[place < self.k]
        self.q, self.none, self.d, self.ids = q, none[order], d[order], ids[order]
        last = np.flatnonzero(np.bincount(q, minlength=self.queries) == self.k)
        ends = np.searchsorted(q, last, side="right") - 1
        self.bound[:] = np.inf
        self.bound[last] = np.where(self.none[ends] | np.isnan(self.d[ends]), np.inf, self.d[ends])


def best_of(batches: Iterator[pa.RecordBatch], query_ids: list, queries: Vectors, k: int) -> Iterator[pa.RecordBatch]:
    """Batches (id, v) to (query, neighbour, distance): the k nearest of these points for each query."""
    best = None
    rows_of: dict = {}
    for i, name in enumerate(query_ids):
        rows_of.setdefault(name, []).append(i)
    width = queries[0].shape[1]
    regular_q = _regular(queries, width)
    norm_q = np.where(regular_q, (np.where(regular_q[:, None], queries[0], 0) ** 2).sum(1), 0.0)
    # covers the rounding of the product, of the norms and of the sum itself
    slack = 16 * (width + 16) * 2.0**-53
    schema = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        schema = pa.schema([("query", id_type), ("neighbour", id_type), ("distance", pa.float64())])
        for at in range(0, batch.num_rows, TILE[0]):
            part = batch.slice(at, TILE[0])
            names = part.column(0).to_pylist()
            ids = part.column(0).to_numpy(zero_copy_only=False) if pa.types.is_integer(id_type) else np.array(names, object)
            best = best or _Best(len(query_ids), k, ids)
            own = vectors_of(part.column(1))
            regular_p = _regular(own, width)
            values = np.where(regular_p[:, None], own[0][:, :width], 0) if own[0].shape[1] >= width else np.zeros((len(names), width))
            norm_p = (values**2).sum(1)
            same = [(i, j) for i, name in enumerate(names) for j in rows_of.get(name, ())]
            for b in range(0, len(query_ids), TILE[1]):
                e = min(b + TILE[1], len(query_ids))
                size = norm_p[:, None] + norm_q[None, b:e]
                low = size - 2 * (values @ np.where(regular_q[b:e, None], queries[0][b:e], 0).T)
                size *= slack
                low -= size
                low[~regular_p, :] = -np.inf
                low[:, ~regular_q[b:e]] = -np.inf
                mine = [(i, j - b) for i, j in same if b <= j < e]
                for i, j in mine:
                    low[i, j] = np.inf
                bound = best.bound[b:e]
                if not np.isfinite(bound).all() and len(names) > k:
                    size *= 2
                    size += low
                    size[~regular_p, :] = np.inf
                    size[:, ~regular_q[b:e]] = np.inf
                    for i, j in mine:
                        size[i, j] = np.inf
                    bound = np.minimum(bound, np.partition(size, k - 1, axis=0)[k - 1])
                keep = low <= bound
                for i, j in mine:
                    keep[i, j] = False
                pi, qi = np.nonzero(keep)
                for c in range(0, len(pi), PAIRS):
                    i, j = pi[c : c + PAIRS], qi[c : c + PAIRS] + b
                    d, none = distances(_take(own, i), _take(queries, j))
                    best.add(j, none, d, ids[i])
    if best is not None and schema is not None:
        for at in range(0, len(best.q), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([query_ids[j] for j in best.q[s]], schema.field(0).type), pa.array(best.ids[s], schema.field(1).type), pa.array(np.where(best.none[s], 0, best.d[s]), pa.float64(), mask=best.none[s])], schema=schema)
