"""Learned operators: gradients, held-out accuracy, and their defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import langid, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.1"


def tables(spark, *names):
    return [spark.read.parquet(f"{TABLES}/{n}.parquet") for n in names]


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert spark.sql("select cast(null as long) id").select(quality.held_out(F.col("id"))).first()[0] is False


def test_quality_on_held_out_labels(spark):
    docs, labels = tables(spark, "documents", "labels")
    out = quality.op5_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert len(good) > 500 and len(bad) > 80
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 1).mean() < 0.06
    assert ((out.score >= 0.7) == (out.predicted == 1)).all() and out.score.between(0, 1).all()


def test_quality_ignores_everything_but_the_text(spark):
    docs, labels = tables(spark, "documents", "labels")
    model = quality.fit(docs, labels, sample=400)
    frame = docs.limit(50).select("doc_id", "text")
    a = {r.doc_id: r.score for r in quality.scored(frame, model).collect()}
    shuffled = frame.repartition(3).withColumn("doc_id", -F.col("doc_id"))
    assert {-r.doc_id: r.score for r in quality.scored(shuffled, model).collect()} == a


def test_quality_features_do_not_depend_on_neighbours():
    texts = ["a bb a bb bb", "", None, "Ünïcode  x\nx", "z" * 5000]
    whole: dict[int, list] = {k: [] for k in range(len(texts))}
    for bucket, row in quality.features(pa.array(texts)):
        for b, r in zip(bucket.tolist(), row.tolist()):
            whole[r].append(b)
    for k, t in enumerate(texts):
        alone = [b for bucket, _ in quality.features(pa.array([t], pa.string())) for b in bucket.tolist()]
        assert sorted(alone) == sorted(whole[k])
    assert whole[1] == whole[2] == []
    words = "a bb a bb bb".split()
    want = 5 + 4 + sum(len(w) for w in words) + sum(max(0, len(w) - 1) for w in words)
    assert len(whole[0]) == want and whole[0].count(quality.REPEATED) == 1


def test_quality_defined_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "good text", "en", "s", 9), (3, None, None, None, None), (4, "", None, None, 0), (None, "x", None, None, 1), (1, "good text", "en", "s", 9)], DOCS).selectExpr("*", "1 AS score", "2 AS y", "3 AS place")
    out = quality.op5_quality(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.op5_quality(empty, labels).count() == 0
    assert {r.score for r in quality.op5_quality(docs, labels.limit(0)).collect()} == {0.5}
    one = quality.op5_quality(docs, labels.where("quality = 1")).collect()
    assert all(r.score > 0.99 for r in one)
    kept = quality.keep_good(docs, labels.where("quality = 1"))
    assert kept.columns == docs.columns and kept.count() == 5


def test_gru_gradients():
    rng = np.random.default_rng(1)
    names, hidden, length, n = 3, 3, 6, 4
    w = {}
    for d in "fb":
        w |= {f"table_{d}": rng.standard_normal((3 * hidden, 256)).astype(np.float32), f"gates_{d}": rng.standard_normal((2 * hidden, hidden)).astype(np.float32), f"cand_{d}": rng.standard_normal((hidden, hidden)).astype(np.float32), f"out_{d}": rng.standard_normal((names, hidden)).astype(np.float32)}
    w["bias"] = rng.standard_normal((names, 1)).astype(np.float32)
    x = rng.integers(0, 256, (length, n)).astype(np.uint8)
    mask = (np.arange(length)[:, None] < np.array([6, 4, 1, 5])).astype(np.float32)
    y = np.array([0, 2, 1, 1])

    def loss():
        f = langid._gru(w["table_f"], w["gates_f"], w["cand_f"], x, mask, range(length)).astype(np.float64)
        b = langid._gru(w["table_b"], w["gates_b"], w["cand_b"], x, mask, range(length - 1, -1, -1))
        p = langid._softmax(w["out_f"] @ f + w["out_b"] @ b + w["bias"])
        return -(np.log(p[:, y, np.arange(n)]) * mask).sum() / mask.sum()

    grads = langid._gradients(w, x, mask, y)
    for k, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in w[k].shape) if not k.startswith("table") else (rng.integers(0, w[k].shape[0]), int(x[0, rng.integers(0, n)]))
            old = w[k][at]
            w[k][at] = old + 1e-2
            up = loss()
            w[k][at] = old - 1e-2
            down = loss()
            w[k][at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3, k


def test_language_on_held_out_documents(spark):
    (docs,) = tables(spark, "documents")
    out = langid.op6_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 2000 and (out.lang == out.lang_pred).mean() > 0.99
    assert out.score.between(0, 1).all()


def test_language_pools_every_window():
    model = langid.train([b"aaaa " * 40, b"bbbb " * 40] * 10, ["a", "b"] * 10, epochs=80)
    texts = ["a" * 1000, "b" * 1000, "a" * 100 + "b" * 5000, None, "", "123 !", "é", "a"]
    lang, score = model.predict(pa.array(texts))
    assert lang[:3] == ["a", "b", "b"] and lang[3:6] == ["und"] * 3 and lang[6] != "und" and (score[3:6] == 0).all()
    for k, t in enumerate(texts):
        one, s = model.predict(pa.array([t], pa.string()))
        assert one == [lang[k]] and abs(s[0] - score[k]) < 1e-5


def test_language_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, None, 0), (None, "abc", "en", None, 3), (4, "abc", None, None, 3), (4, "abc", None, None, 3)], DOCS).selectExpr("*", "1 AS score", "2 AS place", "'x' AS part")
    assert [r.lang_pred for r in langid.op6_language(docs).orderBy("doc_id").collect()] == ["und"] * 5  # nothing to learn from
    assert langid.op6_language(docs.limit(0)).count() == 0
    more = docs.unionByName(spark.createDataFrame([(k, "le la une " * 9, "fr", None, 9) for k in range(20)], DOCS).selectExpr("*", "1 AS score", "2 AS place", "'x' AS part"))
    got = {(r.doc_id, r.lang_pred) for r in langid.op6_language(more).collect()}
    assert (1, "und") in got and (4, "fr") in got and (None, "fr") in got
