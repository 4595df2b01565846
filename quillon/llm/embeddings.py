"""Near-duplicate vectors by Euclidean p-stable hashing, checked by exact cosine.

Vectors are normalised, so that a cosine of c is a distance of sqrt(2 - 2c).  Each of ``tables`` hash tables
joins ``projections`` quantised Gaussian projections ``floor((a.x + b) / width)`` to one bucket code.  Vectors of
a bucket are compared by cosine in double precision.  With the defaults a pair at exactly 0.93 is found with
probability 0.9998, at 0.98 with 0.9999999; see :func:`recall`.

A pair that shares buckets in several tables counts in the first of them only, so that link counts need no list
of pairs: a bucket gives each member a number of links and a connecting set of links.  Codes are computed again, exactly, where vectors meet,
so that only a vector and its key travel to each table.  Equal vectors
are one class, compared once and counted by its size.  Large buckets are compared in pairs of blocks.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
whose label is null; vectors of different length link with nothing; repeated rows are linked copies; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, arrow, batches_of, connected_components, in_blocks, mixed, realigned, stored

#: Vectors of one bucket that a task compares at once.
BLOCK = 1024


def recall(cosine: float, projections: int = 8, tables: int = 16, width: float = 3.0) -> float:
    """Probability that a pair of this cosine shares a bucket in some table."""
    c = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = width / c
    p = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return 1 - (1 - p**projections) ** tables


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls and of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


@lru_cache(8)
def _projections(size: int, n: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions in units of 2**-16, as doubles without fractions, and offsets."""
    rng = np.random.default_rng((seed, size))
    return np.rint(rng.standard_normal((size, n)) * 2.0**16), rng.uniform(0, width, n)


def _codes(unit: np.ndarray, projections: int, tables: int, width: float, seed: int) -> np.ndarray:
    """Bucket codes, a column for each table.  All products and sums are of whole numbers below 2**53, so that a vector's codes are
    the same wherever and beside whichever others they are computed, and needn't travel with it."""
    a, b = _projections(unit.shape[1], tables * projections, width, seed)
    cell = np.floor((np.rint(unit * 2.0**20) @ a * 2.0**-36 + b) / width).astype(np.int64).view(U64).reshape(len(unit), tables, projections)
    code = np.zeros(cell.shape[:2], U64)
    for k in range(projections):
        code = mixed(code * U64(31) + cell[:, :, k] + U64(k + 1))
    return code.view(np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1))[:, None] if len(v) else v


def _compare(codes: np.ndarray, unit: np.ndarray, table: int, weight: np.ndarray, mine: np.ndarray, left: int, right: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row, in rows of the table, and links that connect what is connected."""
    n, parts = np.zeros(len(unit), np.int64), []
    first, second = (np.arange(len(unit)),) * 2 if left == right else (np.flatnonzero(mine == left), np.flatnonzero(mine == right))
    links: list[tuple[int, int]] = []
    root = np.arange(len(unit))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(first), 512):
        rows = first[at : at + 512]
        near = unit[rows] @ unit[second].T >= threshold
        for t in range(table):
            near &= codes[rows, t][:, None] != codes[second, t][None, :]
        if left == right:
            near &= rows[:, None] != second[None, :]
            n[rows] += near @ weight[second]
        else:
            n[rows] += near @ weight[second]
            n[second] += weight[rows] @ near
        for r in np.flatnonzero(near.any(axis=1)):
            others = second[near[r]]
            for o in others[root[others] != root[rows[r]]].tolist():
                x, y = find(int(rows[r])), find(o)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(rows[r]), o))
    return n, links


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, projections: int = 8, tables: int = 16, width: float = 3.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``id_col``, ``n_links`` and ``component_id`` of every row; rows link within equal labels only."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumns({"usable": F.coalesce(usable, F.lit(False)), "h1": F.xxhash64("label", "vec"), "h2": F.xxhash64(F.lit(1), "label", "vec")})
    classes = rows.where("usable").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("h1").alias("h1"), F.min("h2").alias("h2"))
    classes = stored(classes, "vectors")

    real = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    fields = [("key", pa.int64()), ("tbl", pa.int32()), ("rep", pa.int64()), ("copies", pa.int64()), ("vec", pa.binary())]
    schema = pa.schema(fields)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.diff(whole.column("vec").offsets.to_numpy())
            for n in np.unique(size):
                batch = whole.filter(pa.array(size == n))
                v = _matrix(batch.column("vec"))
                code = _codes(_unit(v), projections, tables, width, seed)
                label = batch.column("salt").to_numpy(zero_copy_only=False).view(U64)
                raw = pa.array([x.tobytes() for x in v.astype(real)], pa.binary())
                rep, copies = batch.column("rep"), batch.column("copies")
                for t in range(tables):
                    key = mixed(code[:, t].view(U64) ^ mixed(label + U64(t * 4096 + int(n))))
                    yield arrow(schema, key=key.view(np.int64), tbl=np.full(len(v), t, np.int32), rep=rep, copies=copies, vec=raw)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "grp"):
            grp = batch.column("grp").to_numpy(zero_copy_only=False)
            cut = np.r_[0, np.flatnonzero(np.diff(grp)) + 1, len(grp)]
            rep, copies, mine, left, right, tbl, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "copies", "mine", "left", "right", "tbl", "key"))
            vec = batch.column("vec").to_pylist()
            size = np.fromiter(map(len, vec), np.int64, len(vec))
            units, codes, place = {}, {}, np.empty(len(vec), np.int64)
            for k in np.unique(size):
                same = np.flatnonzero(size == k)
                place[same] = np.arange(len(same))
                units[k] = _unit(np.frombuffer(b"".join(vec[i] for i in same.tolist()), real).reshape(len(same), -1).astype(np.float64))
                codes[k] = _codes(units[k], projections, tables, width, seed)
            a, b, n = [], [], []
            for s, e in zip(cut[:-1], cut[1:]):
                if e - s < 2:
                    continue
                for k in np.unique(key[s:e]):  # other keys are here only if their hashes are equal
                    own = s + np.flatnonzero(key[s:e] == k)
                    if len(own) < 2 or (size[own] != size[own[0]]).any():
                        continue
                    c, unit = codes[size[own[0]]][place[own]], units[size[own[0]]][place[own]]
                    got, links = _compare(c, unit, int(tbl[own[0]]), copies[own], mine[own], int(left[own[0]]), int(right[own[0]]), threshold)
                    some = np.flatnonzero(got)
                    a += rep[own][some].tolist() + [int(rep[own[x]]) for x, _ in links]
                    b += [None] * len(some) + [int(rep[own[y]]) for _, y in links]
                    n += got[some].tolist() + [0] * len(links)
            if a:
                yield arrow(out, a=a, b=b, n=n)

    hashed = classes.select("vec", "rep", "copies", F.xxhash64("label").alias("salt")).mapInArrow(hash_rows, "key long, tbl int, rep long, copies long, vec binary")
    hashed = in_blocks(hashed, "key", F.xxhash64("rep"), block).withColumn("grp", F.xxhash64("key", "left", "right"))
    found = hashed.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, "a long, b long, n long")
    found = stored(found, "links")
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep_n"), "n")
    parts = connected_components(found.where("b is not null"))
    known = classes.join(links, F.col("rep") == F.col("rep_n"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    own = rows.select("vec_id", "usable", "h1", "h2").join(known.withColumn("k1", realigned(F.col("k1"))), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("usable"), "left")
    return own.select(F.col("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))


def op1_embedding_near_dedup(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
parts AS (SELECT node, min(other) AS least FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN parts ON node = vec_id LEFT JOIN n ON a = vec_id
"""
