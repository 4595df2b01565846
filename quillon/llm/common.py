"""What the operators share: the shared work folder, connected components, hot-key blocks, byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# --------------------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only where it is unset is one chosen: ``/tmp/checkpoints`` for a single-process session such as the tests use. On a cluster no
    local folder would do, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/quillon"


def work_dir(spark: SparkSession) -> str:
    """This session's own part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, computes once."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillon/" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def realigned(key: Column) -> Column:
    """``key`` as an expression that no existing partitioning matches.

    A join on it puts a plain exchange above an aggregate, which is what adaptive execution needs in order
    to split the partitions of hot keys.
    """
    return F.shiftleft(key, 0)


def first_by_hash(rows: DataFrame, place: str, n: int, *ties: str) -> DataFrame:
    """The n rows with the smallest ``place``, a 64-bit hash that all rows have: a fixed sample of bounded size.

    Where there are many more rows than that, a threshold on the hash first leaves about twice as many as are asked for, so that
    what reaches the driver doesn't grow with the number of tasks.
    """
    total = rows.select(place).count()
    if total > 4 * n:
        rows = rows.where(F.col(place) < -(1 << 63) + (1 << 64) * 2 * n // total)
    return rows.orderBy(place, *ties).limit(n)


# --------------------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds; each is a grouped minimum and an equi-join, so that a hub
    is never gathered in one task.  A round's result goes to the shared folder.  Self links and links with a
    null end are ignored; no edges give no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    was = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select("v", "v").distinct()
            )
        was = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(realigned(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(realigned(F.col("u")).alias("k"), "m")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = stored(small.select("x.u", "x.v").where("u != v").distinct(), "edges")
        forget(e)
        forget(large)
        e = new


# --------------------------------------------------------------------------- hot keys


def in_blocks(rows: DataFrame, key: str, spread: Column, block: int) -> DataFrame:
    """``rows`` with ``left``, ``right`` and ``mine``: keys of over ``block`` rows are dealt to pairs of blocks.

    Rows of a key with n rows get a block number below ceil(n / block) from ``spread``; each goes to every
    pair of blocks that holds its own.  So each two rows of a key still meet exactly once as a pair of
    blocks, and no group has much more than ``2 * block`` rows.  Keys at or below the bound stay whole, as (0, 0).
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = stored(hot.select(F.col(key).alias("hot_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("left", "right", "mine")})
    joined = rows.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("mine", F.coalesce(F.pmod(spread, F.col("blocks")), F.lit(0)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), lambda i: F.struct(F.least(i, "mine").alias("left"), F.greatest(i, "mine").alias("right")))
    return joined.withColumn("pair", F.explode(pairs)).select(*rows.columns, F.col("pair.left").alias("left"), F.col("pair.right").alias("right"), "mine")


# --------------------------------------------------------------------------- Arrow and bytes


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes of ``text`` each; a longer text is a part of its own."""
    n = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(n), 0
    while start < len(n):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers live on, and so would what their allocator holds


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def arrow(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(k).type) for k, c in columns.items()], schema=schema)


_POWERS: dict[int, list[np.ndarray]] = {}


def _powers(n: int, seed: int) -> list[np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = (0x9E3779B97F4A7C15 + 2 * seed * 0xD1B54A32D192ED03) & (2**64 - 1) | 1
        size = 1 << max(16, int(n).bit_length())
        have = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, U64)
            p[0] = 1
            have.append(np.cumprod(p, dtype=U64))
        _POWERS[seed] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, piece: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running polynomial sums; equal spans hash equally.

    Spans are in order and don't overlap; about ``piece`` bytes are worked on at once.
    """
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + piece, "right")))
        n = int(ends[stop - 1] - base)
        up, down = _powers(n + 1, seed)
        sums = np.zeros(n + 1, U64)
        sums[1:] = data[base : base + n]
        sums[1:] += U64(1)
        sums[1:] *= up[:n]
        np.cumsum(sums, out=sums)
        first = starts[at:stop] - base
        out[at:stop] = (sums[ends[at:stop] - base] - sums[first]) * down[first]
        at = stop
    return mixed(out)


def span_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all bytes of the spans, one span after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """For each pair of spans whether their bytes are equal."""
    out = a_len == b_len
    at = np.flatnonzero(out & (a_len > 0))
    if len(at):
        n = a_len[at]
        equal = data[span_index(a[at], n)] == data[span_index(b[at], n)]
        out[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of bytes in ``is_word`` that don't cross a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[edges - 1] = inside[edges - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Words of a text are runs of bytes other than space and U+0009 to U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[*range(9, 14), 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def batches_of(rows: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Regroup batches that are sorted by ``key`` so that no key is cut; about as large as they come."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else 0
        if last == 0 and held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = ([] if last else held) + [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
