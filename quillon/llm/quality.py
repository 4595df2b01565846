"""Quality classifier with supervised subword embeddings.

A document is the mean of learned vectors for its features, hashed to ``2 ** BITS`` buckets: its words, its pairs of adjacent words
(a word that repeats the one before it is one feature of its own, whichever word it is) and the 3- and 4-byte n-grams of its
words with their borders.  A softmax over the mean gives the class.  Vectors and output are trained together by
stochastic gradient descent in numpy, on the driver, from a bounded sample of labelled rows; whole texts are used.
Scoring is one pass: the output applied to every vector beforehand leaves one number a bucket.  What the driver gathers is bounded by
the sample: each example is at most ``2 ** BITS`` buckets and shares, whatever its text's length and however often its rows repeat.

Defined cases: null and empty texts have no features and score as the model's bias; labels that are null are not learned from; rows that
repeat, in either table, are one example, and of different texts with one id the smallest is learned from; without labels, or with one class only, all scores are that class's share (0.5 without any);
an empty table gives no rows; further columns pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm.common import NOT_SPACE, arrow, first_by_hash, slices, span_hashes, span_index, text_bytes, word_spans

BITS = 16
#: Labelled rows that are learned from, at most.
SAMPLE = 3000
REPEATED = 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all texts' features, a kind at a time, with the row of each."""
    data, offsets = text_bytes(column)
    starts, ends, row = word_spans(data, offsets, NOT_SPACE)
    if not len(starts):
        return
    size = ends - starts
    begin = 1 + np.cumsum(size + 1) - (size + 1)
    text = np.full(int(begin[-1] + size[-1]) + 1, 32, np.uint8)  # " word word "
    text[span_index(begin, size)] = data[span_index(starts, size)]
    words = span_hashes(text, begin, begin + size)
    yield (words >> np.uint64(64 - BITS)).astype(np.int64), row
    same = np.flatnonzero(row[1:] == row[:-1])
    pair = ((words[same] * np.uint64(0x9E3779B97F4A7C15) + words[same + 1]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)
    pair[words[same] == words[same + 1]] = REPEATED
    yield pair, row[same]
    owner = np.zeros(len(text), np.int32)
    owner[begin] = np.diff(row, prepend=row[0])
    owner = np.cumsum(owner, dtype=np.int32) + np.int32(row[0])
    inner, wide = text != 32, text.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    ok = inner[1:-1]
    yield (three[ok] * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64), owner[1:-1][ok]
    if len(text) > 3:
        four = three[:-1] | wide[3:] << np.uint32(24)
        ok = inner[1:-2] & inner[2:-1]
        yield ((four[ok] ^ (four[ok] >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int64), owner[1:-2][ok]


@dataclass
class Model:
    """A number for each bucket; a document's log odds are their mean and ``bias``."""

    value: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        total, n = np.zeros(len(column)), np.zeros(len(column))
        for bucket, row in features(column):
            n += np.bincount(row, minlength=len(column))
            total += np.bincount(row, self.value[bucket], len(column))
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], width: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """Fit to ``(class, buckets, shares)``; classes weigh alike."""
    classes = np.array([e[0] for e in examples])
    share = classes.mean() if len(classes) else 0.5
    if share in (0, 1) or not len(classes):
        return Model(np.zeros(1 << BITS), 40.0 * (2 * share - 1))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << BITS, width)).astype(np.float32)
    out, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    weight = np.where(classes == 1, 0.5 / share, 0.5 / (1 - share))
    weight = np.minimum(weight, 8)
    step, steps = 0, epochs * len(examples)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            y, bucket, part = examples[k]
            lr = rate * (1 - step / steps)
            step += 1
            rows = vectors[bucket]
            mean = part @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            g = (p * weight[k] * lr).astype(np.float32)
            back = out @ g
            out -= np.outer(mean, g)
            bias -= g
            vectors[bucket] = rows - np.outer(part, back) * (len(part) ** 0.5)
    value = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    return Model(value, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from the ``sample`` labelled rows, not held out, that come first by a hash of their id."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("int").alias("y")).where("label_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("label_id"))).withColumn("place", F.xxhash64("label_id"))
    chosen = first_by_hash(known, "place", sample, "label_id", "y")  # bounded, so that it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("place", "label_id", "y").agg(F.min("text").alias("text"))
    schema = pa.schema([("place", pa.int64()), ("y", pa.int32()), ("bucket", pa.binary()), ("share", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, share = [], []
            for k in range(batch.num_rows):
                got = [b for b, _ in features(batch.column("text").slice(k, 1))]
                b, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0))
                bucket.append(b.astype(np.uint16).tobytes())
                share.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
            yield arrow(schema, place=batch.column("place"), y=batch.column("y"), bucket=bucket, share=share)

    got = rows.select("place", "y", "text").mapInArrow(count, "place long, y int, bucket binary, share binary").toArrow()
    got = got.sort_by([("place", "ascending"), ("y", "ascending"), ("bucket", "ascending")])
    return train([(r["y"], np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["share"], np.float32)) for b in got.to_batches(256) for r in b.to_pylist()])


def scored(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """``docs`` with ``score``, in place of a column of that name; with ``least``, only rows that reach it, and their columns as they are."""
    docs = docs if least is not None else docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                score = pa.array(sent.value.score(batch.column(text_col)))
                if least is None:
                    yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, "score"])
                else:
                    yield batch.filter(pc.greater_equal(score, least))

    return docs.mapInArrow(run, docs.schema if least is not None else StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op5_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; columns unchanged."""
    return scored(docs, fit(docs, labels), least=least)
