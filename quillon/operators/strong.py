"""Strongly connected components of a graph that fits one task, by one depth-first walk without recursion (Tarjan)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _smallest(start: list[int], to: list[int]) -> np.ndarray:
    """For each node the smallest one of its component; node ``i`` has edges to ``to[start[i]:start[i + 1]]``."""
    n = len(start) - 1
    at, low, place, out = start[:n], [0] * n, [0] * n, [-1] * n  # next edge, lowest place reached, own place from 1, result
    seen, open_, path = 0, [], []
    for first in range(n):
        if place[first]:
            continue
        seen += 1
        place[first] = low[first] = seen
        open_.append(first)
        path.append(first)
        while path:
            v = path[-1]
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not place[w]:
                    seen += 1
                    place[w] = low[w] = seen
                    open_.append(w)
                    path.append(w)
                elif out[w] < 0 and place[w] < low[v]:
                    low[v] = place[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == place[v]:
                k = len(open_) - 1
                while open_[k] != v:
                    k -= 1
                members = open_[k:]
                del open_[k:]
                least = min(members)
                for w in members:
                    out[w] = least
    return np.array(out, dtype=np.int64)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, group`` of the nodes of components of two or more, from all edges ``src, dst`` of the graph."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    nodes = pc.unique(pa.chunked_array([*t["src"].chunks, *t["dst"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    src, dst = (pc.index_in(t[c], nodes).to_numpy().astype(np.int64) for c in ("src", "dst"))
    order = np.argsort(src, kind="stable")
    group = _smallest(np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist(), dst[order].tolist())
    kept = np.flatnonzero(np.bincount(group, minlength=len(nodes))[group] > 1)
    yield from pa.table({"node": nodes.take(pa.array(kept)), "group": nodes.take(pa.array(group[kept]))}).to_batches(max_chunksize=10_000)
