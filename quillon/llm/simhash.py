"""SimHash near-duplicates of documents, found by pigeonring filtering of 64-bit fingerprints.

Five segments form a ring.  If two fingerprints differ in at most four bits, some segment starts a chain of
consecutive segments whose running differences stay within 0.8 bits a segment: the first is equal, the first two
differ in at most one bit, the first three in at most two.  The index keys hold the first segment and those
halves of the next two that such a chain must leave equal: 26 bits, five keys for each start.  All pairs that are looked at, in
runs of any length, pass the chain test before the full Hamming distance is taken.  No link within the distance is lost.

Defined cases: null or empty text and text without words have fingerprint zero, and link like any other; repeated
rows and equal fingerprints form one class and are compared once; null doc_ids keep a fingerprint and take part in no link;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, arrow, batches_of, connected_components, in_blocks, realigned, slices, stored, text_bytes

EDGES = np.array([0, 13, 26, 39, 52, 64])
WIDTHS = np.diff(EDGES)
#: Rows of one key that one task compares at once, at most twice.
BLOCK = 4096


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles, as a signed integer."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(plain[s:e], 42) for s, e in zip(starts, ends[k - 1 :])], U64)
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 16384):
        part = hashes[at : at + 16384]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * total > n).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id`` and the 64-bit fingerprint ``fp`` of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                data, offsets = text_bytes(batch.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                yield arrow(schema, doc_id=batch.column("doc_id"), fp=np.array([fingerprint(raw[s:e], shingle) for s, e in zip(at, at[1:])], np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(x: np.ndarray, low: int, width: int) -> np.ndarray:
    return (x >> U64(low)) & U64((1 << width) - 1)


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """25 keys of each fingerprint, as rows."""
    out = []
    for i in range(5):
        first = _bits(fp, EDGES[i], WIDTHS[i])
        halves = []
        for j in ((i + 1) % 5, (i + 2) % 5):
            low, half = EDGES[j], WIDTHS[j] // 2
            halves += [_bits(fp, low, half), _bits(fp, low + half, WIDTHS[j] - half)]
        for c, (a, b) in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))):
            out.append(U64((i * 5 + c) << 48) | (first << U64(20)) | (halves[a] << U64(10)) | halves[b])
    return np.stack(out, axis=1).view(np.int64)


def chain(x: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the running differences from segment ``start`` stay within their share of ``distance``."""
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
    for step in range(5):
        j = (start + step) % 5
        part = (x >> np.asarray(EDGES[j]).astype(U64)) & ((U64(1) << np.asarray(WIDTHS[j]).astype(U64)) - U64(1))
        total = total + np.bitwise_count(part)
        ok &= 5 * total <= (step + 1) * distance
    return ok


def within(x: np.ndarray, distance: int) -> np.ndarray:
    """Which differences have at most ``distance`` bits: only those in which some segment starts a chain are counted in full."""
    some, close = x.ravel(), np.zeros(x.size, bool)
    for start in range(5):
        open_ = np.flatnonzero(~close)
        close[open_] = chain(some[open_], start, distance)
    at = np.flatnonzero(close)
    close[at] = np.bitwise_count(some[at]) <= distance
    return close.reshape(x.shape)


def _cluster(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever chains of near pairs connect among ``fp``, without listing all pairs."""
    links, groups, left = [], [], np.arange(len(fp))
    while len(left):
        near = within(fp[left] ^ fp[left[0]], distance)
        groups.append(own := left[near])
        links += [(int(own[0]), int(k)) for k in own[1:]]
        left = left[~near]
    root = list(range(len(groups)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    heads = fp[[g[0] for g in groups]]
    for a, own in enumerate(groups):
        if len(own) == 1:
            continue
        for b in np.flatnonzero(np.bitwise_count(heads ^ heads[a]) <= 3 * distance):
            if find(a) == find(int(b)):
                continue
            for at in range(0, len(own), 256):
                near = within(fp[own[at : at + 256], None] ^ fp[None, groups[b]], distance)
                if near.any():
                    x, y = np.argwhere(near)[0]
                    links.append((int(own[at + x]), int(groups[b][y])))
                    root[find(a)] = find(int(b))
                    break
    return links


def run_links(keys: np.ndarray, fp: np.ndarray, distance: int, small: int = 48) -> np.ndarray:
    """Index pairs within ``distance`` among rows of equal key (rows sorted by key), chain test first: all in short runs, a connecting set in long ones."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    begin, stop = np.r_[0, cut], np.r_[cut, len(keys)]
    size = stop - begin
    found = []
    for k in np.flatnonzero(size > small):
        found += [np.array([(begin[k] + a, begin[k] + b) for a, b in _cluster(fp[begin[k] : stop[k]], distance)], np.int64).reshape(-1, 2)]
    short = np.repeat(size <= small, size)
    for gap in range(1, min(small, int(size.max(initial=0)))):
        i = np.flatnonzero((keys[gap:] == keys[:-gap]) & short[:-gap])
        if not len(i):
            break
        x = fp[i] ^ fp[i + gap]
        ok = chain(x, (keys[i] >> 48) // 5, distance)
        i = i[ok]
        near = np.bitwise_count(x[ok]) <= distance
        found.append(np.stack([i[near], i[near] + gap], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def near_links(classes: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between the ``rep`` values of distinct fingerprints ``fp`` that connect all near pairs."""
    if not 0 <= distance <= 4:
        raise ValueError("the segments serve distances up to 4")
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            keys = ring_keys(fp.view(U64))
            yield arrow(schema, key=keys.ravel(), fp=np.repeat(fp, keys.shape[1]), rep=np.repeat(rep, keys.shape[1]))

    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "group"):
            group, key, fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "key", "fp", "rep"))
            order = np.lexsort((key, group))
            group, key, fp, rep = group[order], key[order], fp[order].view(U64), rep[order]
            run = np.cumsum(np.r_[True, (np.diff(group) != 0) | (np.diff(key) != 0)]) | (key & ~((1 << 48) - 1))
            found = run_links(run, fp, distance)
            if len(found):
                found = np.unique(np.sort(rep[found], axis=1), axis=0)
                yield arrow(pairs, a=found[:, 0], b=found[:, 1])

    keyed = classes.where("rep is not null").mapInArrow(index, "key long, fp long, rep long")
    keyed = in_blocks(keyed, "key", F.xxhash64("fp"), block)
    dealt = keyed.withColumn("group", F.xxhash64("key", "left", "right")).repartition("group").sortWithinPartitions("group")
    return dealt.select("group", "key", "fp", "rep").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable over links, for every row."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    parts = connected_components(near_links(classes, distance))
    known = classes.join(parts, F.col("rep") == F.col("node"), "left").select(realigned(F.col("fp")).alias("class_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(known, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op4_simhash(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their near-duplicate group; columns unchanged. Rows that repeat a kept doc_id, and those without one, stay."""
    kept = near_duplicates(docs).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")
