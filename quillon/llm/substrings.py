"""Substring dedup: words covered by a window of words that also starts in an earlier document go.

Every window of ``window`` words has a minimiser, the smallest hash among its runs of ``mer`` words.  Consecutive
windows that share their minimiser travel as one packed string of words, a super-k-mer, to the minimiser's bucket, so that
all windows of one word sequence meet there.  In the bucket windows are sorted and each group's smallest
doc_id is found.  Hashes only bring windows together: every removal is confirmed word by word.

Map side, each shard of documents is resolved in itself first: of a window that is common in the shard only the
occurrences in its first document travel, which keeps a passage that a third of all documents share down to one super-k-mer
a shard.  Super-k-mers go as compressed blocks, one for each shard and bucket; the number of buckets follows the bytes of
text, so that a bucket is of bounded size.

Defined cases: null and empty texts have no words; texts with fewer words than the window keep all of them; equal
rows are the same document and don't remove each other's words; a null doc_id is no document of the corpus: such a row keeps its words
and removes none; an empty table gives no rows; further columns pass or are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import NOT_SPACE, U64, arrow, batches_of, mixed, realigned, same_spans, shuffle_partitions, slices, span_hashes, span_index, text_bytes, word_spans

#: Bytes of packed super-k-mers that one bucket should hold, and that a task gathers before it sends blocks.
BUCKET_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20


class HashCollision(Exception):
    """Different words with one hash; the shard or bucket is done again with another hash."""


def _windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive entries, from those of halves."""
    n, out, done, power = len(words), None, 0, {1: words}
    size = 1
    while 2 * size <= k:
        half = power[size]
        power[2 * size] = mixed(half[: len(half) - size] * U64(0x9E3779B97F4A7C15) + half[size:])
        size *= 2
    for p in sorted(power, reverse=True):
        while k - done >= p:
            part = power[p][done : n - k + 1 + done]
            out = part if out is None else mixed(out * U64(0xC2B2AE3D27D4EB4F) + part)
            done += p
    return out


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of every k consecutive entries."""
    size, low, n = 1, x, len(x)
    while 2 * size <= k:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return np.minimum(low[: n - k + 1], low[k - size : n - size + 1])


def _resolve(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, at: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows that start at words ``at`` also start in a document of smaller ``order``, confirmed word by word."""
    if not len(at):
        return np.zeros(0, bool)
    keys = _windows(words, k)[at]
    by = np.lexsort((order, keys))
    new = np.r_[True, np.diff(keys[by]) != 0]
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    first = np.empty(len(at), np.int64)
    first[by] = head
    later = order > order[first]
    mine, theirs = at[later], at[first[later]]
    # Neighbouring windows with the same offset share all words but one: each pair of words is compared once.
    linked = np.zeros(len(mine), bool)
    linked[1:] = (mine[1:] == mine[:-1] + 1) & (theirs[1:] == theirs[:-1] + 1)
    count = np.where(linked, 1, k)
    skip = np.where(linked, k - 1, 0)
    a, b = span_index(mine + skip, count), span_index(theirs + skip, count)
    if len(a) and not same_spans(data, starts[a], starts[b], (ends - starts)[a], (ends - starts)[b]).all():
        raise HashCollision
    return later


def _attempts(f, *args):
    for seed in range(16):
        try:
            return f(*args, seed)
        except HashCollision:
            continue
    raise RuntimeError("sixteen hashes in a row collided")


class _Shard:
    """Documents as bytes with one space between words, and where the words lie."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        starts, ends, self.row = word_spans(data, offsets, NOT_SPACE)
        size = ends - starts
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        self.data = np.full(int(self.ends[-1]) + 1 if len(size) else 0, 32, np.uint8)
        self.data[span_index(self.starts, size)] = data[span_index(starts, size)]


def _intervals(doc: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of a document as spans of words."""
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(word) != 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(word)] - 1
    return doc[first], word[first], word[last] + k


def _cut(shard: _Shard, order: np.ndarray, k: int, mer: int, seed: int):
    """Windows of the shard that are resolved here, and the super-k-mers of the rest."""
    words = span_hashes(shard.data, shard.starts, shard.ends, seed)
    n = len(words) - k + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    at = np.flatnonzero(shard.row[:n] == shard.row[k - 1 :])
    later = _resolve(shard.data, shard.starts, shard.ends, words, at, order[shard.row[at]], k)
    fixed = words if not seed else span_hashes(shard.data, shard.starts, shard.ends, 0)
    least = _least(_windows(fixed, mer), k - mer + 1)
    rest = at[~later]
    m = least[rest]
    new = np.r_[True, (np.diff(rest) != 1) | (np.diff(m) != 0) | (np.diff(shard.row[rest]) != 0)] if len(rest) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return at[later], rest[first], np.diff(np.r_[first, len(rest)]), m[first]


_PACK = zstandard.ZstdCompressor(level=5)
_UNPACK = zstandard.ZstdDecompressor()


def _squeeze(raw: bytes) -> bytes:
    return _PACK.compress(raw)


def _expand(raw: bytes) -> bytes:
    return _UNPACK.decompress(raw)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one block: a mark, their sizes, their bytes; each is compressed on its own unless there are few bytes."""
    raw = [a.tobytes() for a in arrays]
    small = sum(map(len, raw)) < 512
    parts = raw if small else [_PACK.compress(r) for r in raw]
    return b"".join([b"\0" if small else b"\1", np.array(list(map(len, parts)), np.uint32).tobytes(), *parts])


def _unpack(block: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(block, np.uint32, len(types), 1).tolist()
    out, at = [], 1 + 4 * len(types)
    for kind, n in zip(types, sizes):
        part = block[at : at + n]
        out.append(np.frombuffer(part if block[0] == 0 else _UNPACK.decompress(part), kind))
        at += n
    return out


_EMPTY = np.zeros(0, np.int64)
_BLOCK = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)


def _bucket(data: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, k: int, seed: int):
    """Covered spans of words, by document, of the windows in one bucket's super-k-mers."""
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), NOT_SPACE)
    words = span_hashes(data, starts, ends, seed)
    base = np.cumsum(count + k - 1) - (count + k - 1)
    owner = np.repeat(np.arange(len(count)), count)
    step = span_index(np.zeros(len(count), np.int64), count)
    later = _resolve(data, starts, ends, words, base[owner] + step, doc[owner], k)
    owner, word = owner[later], (start[owner] + step)[later]
    which, first, stop = _intervals(owner, word, k) if len(owner) else (_EMPTY, _EMPTY, _EMPTY)
    return doc[which], tag[which], first, stop


def covered_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, mer: int = 3, shard_bytes: int = 2 << 20) -> DataFrame:
    """``doc_id, tag, first, stop``: spans of words that earlier documents hold too; ``tag`` is XXH64 of the text, for ids that repeat."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shuffle_partitions(spark)
    buckets = max(4 * parts, -(-3 * total // BUCKET_BYTES))
    sent = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])

    def blocks(held: list[tuple], spans: list[tuple]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = defaultdict(list)
        for doc, tag, start, count, bucket, size, data, begin in held:
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            for own in np.split(order, cut[1:]):
                by[int(bucket[own[0]])].append((doc[own], tag[own], start[own], count[own], data[span_index(begin[own], size[own])]))
        keys, raw = [], []
        for key, parts in by.items():
            doc, tag, start, count, data = (np.concatenate(x) for x in zip(*parts))
            keys.append(key)
            raw.append(_pack(doc, tag, start.astype(np.int32), _EMPTY.astype(np.int32), count.astype(np.int32), data))
        if spans:  # resolved already: any bucket hands them on
            doc, tag, first, stop = (np.concatenate(x) for x in zip(*spans))
            if len(doc):
                keys.append(int(mixed(doc[:1].view(U64))[0] % U64(buckets)))
                raw.append(_pack(doc, tag, first.astype(np.int32), stop.astype(np.int32), _EMPTY.astype(np.int32), _EMPTY.astype(np.uint8)))
        if keys:
            yield arrow(sent, bucket=keys, block=raw)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spans, gathered = [], [], 0
        for whole in batches:
            for batch in slices(whole, "text", shard_bytes):
                shard = _Shard(batch.column("text"))
                doc, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
                done, first, count, least = _attempts(_cut, shard, doc, window, mer)
                base = np.searchsorted(shard.row, np.arange(len(doc)))
                if len(done):
                    row = shard.row[done]
                    which, a, b = _intervals(row, done - base[row], window)
                    spans.append((doc[which], tag[which], a, b))
                if len(first):
                    row = shard.row[first]
                    begin = shard.starts[first]
                    size = shard.ends[first + count + window - 2] + 1 - begin
                    held.append((doc[row], tag[row], first - base[row], count, (mixed(least) % U64(buckets)).astype(np.int32), size, shard.data, begin))
                    gathered += int(size.sum())
                if gathered >= BLOCK_BYTES:
                    yield from blocks(held, spans)
                    held, spans, gathered = [], [], 0
        yield from blocks(held, spans)

    out = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("first", pa.int32()), ("stop", pa.int32())])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "bucket"):
            bucket = batch.column("bucket").to_numpy()
            cut = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket) != 0]), len(bucket)]
            for s, e in zip(cut[:-1], cut[1:]):
                parts = []
                for raw in batch.column("block").slice(s, e - s):
                    doc, tag, first, stop, count, data = _unpack(raw.as_py(), *_BLOCK)
                    if len(stop):
                        yield arrow(out, doc_id=doc, tag=tag, first=first, stop=stop)
                    else:
                        parts.append((doc, tag, first.astype(np.int64), count.astype(np.int64), data))
                if parts:
                    doc, tag, start, count, data = (np.concatenate(x) for x in zip(*parts))
                    del parts
                    doc, tag, first, stop = _attempts(_bucket, data, doc, tag, start, count, window)
                    if len(doc):
                        yield arrow(out, doc_id=doc, tag=tag, first=first.astype(np.int32), stop=stop.astype(np.int32))

    sent_rows = rows.mapInArrow(shards, "bucket int, block binary")
    return sent_rows.repartitionById(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(resolve, "doc_id long, tag long, first int, stop int")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, mer: int = 3) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row; ``kept`` is the words that stay, joined by one space."""
    spans = covered_spans(docs, id_col, text_col, window, mer)
    spans = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    spans = spans.select(realigned(F.col("doc_id")).alias("span_id"), F.col("tag").alias("span_tag"), "spans")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                data, offsets = text_bytes(batch.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                z = [_squeeze(raw[s:e]) for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(z, pa.binary())], names=["doc_id", "tag", "packed"])

    packed = rows.mapInArrow(pack, "doc_id long, tag long, packed binary")
    joined = packed.join(spans, (F.col("doc_id") == F.col("span_id")) & (F.col("tag") == F.col("span_tag")), "left").select("doc_id", "packed", "spans")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "packed", 2 << 20):
                spans = batch.column("spans")
                n, removed, kept = [], [], []
                for k, z in enumerate(batch.column("packed")):
                    words = _expand(z.as_py()).split()
                    n.append(len(words))
                    if (own := spans[k]).is_valid:
                        own = own.values
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, own.field("first").to_numpy(), 1)
                        np.add.at(edge, own.field("stop").to_numpy(), -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        words = [w for w, x in zip(words, stay.tolist()) if x]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield arrow(out, doc_id=batch.column("doc_id"), n_words=n, n_removed=removed, kept=kept)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM w WHERE len(words) >= 13),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM starts),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM s JOIN f USING (k) WHERE first < doc_id),
x AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
kept AS (SELECT x.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS t FROM x LEFT JOIN gone USING (doc_id, p) GROUP BY x.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
