"""The vectors nearest to each query by exact cosine, in blocks of a matrix product.

A product in single precision only nominates: what may lie among the k best, by a bound on its error, is scored again in double precision, component
by component, so that equal vectors have equal scores. A task holds one block of vectors, the queries and their k best scores so far, whatever the table's size.

Scores are those of ``greatest(0, cosine)``: a vector that is null, holds a null or has another length than the query scores 0; one that is
zero or not finite scores NaN, which sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows of a block of vectors, queries of a product, pairs that are scored at once.
ROWS, QUERIES, PAIRS = 32_768, 256, 65_536


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values end to end, each row's start, and its length; -1 for a row that is null or holds a null."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))[:-1]]).astype(np.int64) if len(size) else size
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        size = np.where((size >= 0) & (holes[start + np.maximum(size, 0)] > holes[start]), -1, size)
    return flat.to_numpy(zero_copy_only=False), start, size


def _taken(flat: np.ndarray, start: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return flat[start[at][:, None] + np.arange(width)].astype(np.float64)


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in single precision, and which rows have a direction at all."""
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        good = np.isfinite(norm) & (norm > 0) & np.isfinite(norm * norm) & (norm * norm > 1e-200)
        return np.where(good[:, None], rows / np.where(good, norm, 1)[:, None], 0).astype(np.float32), good


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot, x, y = (np.zeros(len(a)) for _ in range(3))
    with np.errstate(all="ignore"):
        for p, q in zip(a.T, b.T):
            dot += p * q
            x += p * p
            y += q * q
        return np.maximum(0.0, np.minimum(dot / np.sqrt(x * y), 1.0))


@dataclass
class Asked:
    """Queries of one length: their identifiers, vectors, directions, and which have one. Of length -1 are those that score 0 with everything."""

    ids: pa.Array
    width: int
    vectors: np.ndarray
    units: np.ndarray
    good: np.ndarray


def asked(table: pa.Table) -> list[Asked]:
    """Queries ``query_id, asked`` by the length of their vectors."""
    if not table.num_rows:
        return []
    ids = table.column("query_id").combine_chunks()
    flat, start, size = _matrix(table.column("asked").combine_chunks())
    out = []
    for width in np.unique(size).tolist():
        at = np.flatnonzero(size == width)
        vectors = _taken(flat, start, at, max(width, 0))
        out.append(Asked(ids.take(pa.array(at)), width, vectors, *_units(vectors)))
    return out


def _first(mask: np.ndarray, k: int) -> np.ndarray:
    return np.flatnonzero(mask)[:k]


def _fewer_copies(rows: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each set of equal rows, in order."""
    key = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel()
    _, same = np.unique(key, return_inverse=True)
    order = np.argsort(same, kind="stable")
    new = np.r_[True, np.diff(same[order]) != 0]
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = np.sort(order[place < k])
    return rows[keep], at[keep]


def _pairs(q: Asked, best: np.ndarray, flat: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``query, row, score`` of all pairs of a block that may be among the k best; rows are in the order of their identifiers. ``best`` has each query's k best scores so far."""
    fits = size == q.width if q.width >= 0 else np.zeros(len(size), bool)
    at = np.flatnonzero(fits)
    vectors = _taken(flat, start, at, max(q.width, 0))
    units, good = _units(vectors)
    every = lambda qs, rows, score: (np.repeat(qs, len(rows)), np.tile(rows, len(qs)), np.full(len(qs) * len(rows), score))
    queries = np.arange(len(q.good))
    if q.width >= 0:
        yield every(queries[~q.good], at[:k], np.nan)
        yield every(queries[q.good], at[~good][:k], np.nan)
    yield every(queries[best.min(axis=1) <= 0], _first(~fits, k), 0.0)
    at, vectors, units = at[good], vectors[good], units[good]
    if not len(at) or not q.good.any():
        return
    vectors, kept = _fewer_copies(vectors, np.arange(len(at)), k)
    at, units = at[kept], units[kept]
    slack = (q.width + 16) * 2.0**-22
    live = queries[q.good]
    for low in range(0, len(live), QUERIES):
        qs = live[low : low + QUERIES]
        near = q.units[qs] @ units.T
        cut = best[qs].min(axis=1) - slack
        fresh = np.isneginf(cut)
        if fresh.any() and len(at) >= k:
            cut[fresh] = np.partition(near[fresh], len(at) - k, axis=1)[:, len(at) - k] - 2 * slack
        floor = np.where(cut > 0, cut, -slack).astype(np.float32)
        a, b = np.nonzero(near >= np.nextafter(floor, np.float32(-2))[:, None])
        for lo in range(0, len(a), PAIRS):
            i, j = qs[a[lo : lo + PAIRS]], b[lo : lo + PAIRS]
            yield i, at[j], _cosines(q.vectors[i], vectors[j])
        # Where nothing positive fills the k places, rows behind the query score 0, the smallest identifiers first.
        for r in np.flatnonzero(cut <= 0):
            behind = _first(near[r] < floor[r], k)
            yield np.full(len(behind), qs[r]), at[behind], np.zeros(len(behind))


def _block(q: Asked, best: np.ndarray, ids: pa.Array, vectors: pa.Array, k: int) -> pa.RecordBatch:
    found = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    for part in _pairs(q, best, *_matrix(vectors), k):
        for column, values in zip(found, part):
            column.append(values)
    i, j, score = map(np.concatenate, found)
    value = np.where(np.isnan(score), np.inf, score)
    order = np.lexsort((j, -value, i))
    i, j, score, value = i[order], j[order], score[order], value[order]
    new = np.r_[True, np.diff(i) != 0] if len(i) else np.empty(0, bool)
    place = np.arange(len(i)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(i) else 0)
    keep = (place < k) & (value >= best.min(axis=1)[i])
    i, j, score, value, place = i[keep], j[keep], score[keep], value[keep], place[keep]
    more = np.full(best.shape, -np.inf)
    more[i, place] = value
    best[:] = np.partition(np.concatenate([best, more], axis=1), k, axis=1)[:, k:]
    return pa.RecordBatch.from_arrays([q.ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], names=["query_id", "vec_id", "score"])


def nominate(batches: Iterator[pa.RecordBatch], queries: list[Asked], k: int) -> Iterator[pa.RecordBatch]:
    """From batches ``vec_id, embedding`` the rows ``query_id, vec_id, score`` that may be among a query's k best, at most k of each block."""
    best = [np.full((len(q.good), k), -np.inf) for q in queries]

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table.column("vec_id"), null_placement="at_start"))
        ids, vectors = (table.column(c).combine_chunks() for c in ("vec_id", "embedding"))
        for q, b in zip(queries, best):
            yield _block(q, b, ids, vectors, k)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield from done(held)
            held, n = [], 0
    if n:
        yield from done(held)
