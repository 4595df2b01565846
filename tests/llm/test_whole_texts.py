"""Operators work on whole texts, whatever their length: learned states, removed lines, phrases, encodings."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, embeddings, langid, lines, quality, simhash, token_counts
from quillon.llm.common import text_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def slow_gru(w, d, text):
    """States of one reading of ``text`` from end to end, a position at a time."""
    size, h, out = w[f"cand_{d}"].shape[0], np.zeros(w[f"cand_{d}"].shape[0]), []
    for c in text if d == "f" else text[::-1]:
        g = w[f"table_{d}"][:, c].astype(float)
        a = 1 / (1 + np.exp(-(w[f"gates_{d}"] @ h + g[: 2 * size])))
        r, z = a[:size], langid.CARRY * a[size:]
        h = z * h + (1 - z) * np.tanh(w[f"cand_{d}"] @ (r * h) + g[2 * size :])
        out.append(h)
    return out if d == "f" else out[::-1]


@pytest.mark.parametrize("block", [3, 2048])
def test_states_are_carried_through_whole_texts(block):
    rnd = random.Random(4)
    words = {"a": ["uno", "due", "tre", "casa"], "b": ["one", "two", "three", "house"]}
    make = lambda g, n: " ".join(rnd.choice(words[g]) for _ in range(n)).encode()
    model = langid.train([make(g, 60) for g in "ab" * 20], list("ab" * 20), epochs=30, batch=32)
    texts = [make("a", 3), make("b", 900) + make("a", 400), b"", b"x" * 700, make("a", 257)]
    data, offsets = text_bytes(pa.array([t.decode() for t in texts]))
    got = model.pooled(data, offsets, block)
    for k, t in enumerate(texts):
        want = np.zeros(2)
        for f, b in zip(slow_gru(model.weights, "f", t), slow_gru(model.weights, "b", t)):
            z = model.weights["out_f"] @ f + model.weights["out_b"] @ b + model.weights["bias"][:, 0]
            want += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.abs(got[k] - want / max(1, len(t))).max() < 1e-3


def test_languages_are_learned_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs: seen.append((texts, langs)))
    long = "la " * 40000
    langid.fit(spark.createDataFrame([(k, long + str(k), "fr", None, 1) for k in range(6)], DOCS))
    assert sorted(map(len, seen[0][0])) == [len(long) + 1] * len(seen[0][0]) and seen[0][0]


def test_scores_equal_a_slow_sum(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(["good one here", "bad bad bad", "", None, "z" * 3000 + " ünder"])], DOCS)
    rng = np.random.default_rng(2)
    model = quality.Model(rng.standard_normal(1 << quality.BITS), 0.25)
    got = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    for r in docs.collect():
        buckets = [int(b) for own, _ in quality.features(pa.array([r.text], pa.string())) for b in own]
        z = sum(model.value[b] for b in buckets) / max(1, len(buckets)) + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_rows_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda examples: seen.append([(y, b.tolist(), s.tolist()) for y, b, s in examples]))
    docs = spark.createDataFrame([(k, f"text {k} here", "en", "s", 1) for k in range(12)], DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels)
    quality.fit(docs.union(docs).union(docs), labels.union(labels))
    assert seen[0] == seen[1] and len(seen[0]) > 4


def test_lines_go_from_a_very_long_text(spark):
    n = 200_000
    text = "\n".join(f"own {k}" if k % 2 else f"common {k % 500}" for k in range(n))
    docs = spark.createDataFrame([(k, text if k == 9 else "\n".join(f"common {i}" for i in range(0, 500, 2)), None, f"s{k}", 1) for k in range(10)], DOCS)
    got = {r.doc_id: r for r in lines.without_boilerplate(docs).collect()}
    assert got[9].n_removed == n // 2 and got[0].n_removed == 0 and got[1].n_removed == 250
    assert got[9].text == "\n".join(f"own {k}" for k in range(n) if k % 2)
    assert got[1].text == ""


def test_every_run_passes_the_chain_test(monkeypatch):
    rnd, calls = random.Random(8), []
    real = simhash.chain
    monkeypatch.setattr(simhash, "chain", lambda x, *a: calls.append(x.size) or real(x, *a))
    base = rnd.getrandbits(60)
    fp = np.array([base ^ sum(1 << rnd.randrange(26, 60) for _ in range(rnd.randrange(5))) for _ in range(300)], np.uint64)
    links = simhash.run_links(np.zeros(300, np.int64), fp, 4)
    assert len(links) and calls
    assert all(int(fp[a] ^ fp[b]).bit_count() <= 4 for a, b in links.tolist())
    x = np.array([rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64) for _ in range(20000)], np.uint64)
    assert (simhash.within(x, 4) == (np.bitwise_count(x) <= 4)).all()


def test_one_encoding_for_each_digest(spark, tmp_path, monkeypatch):
    cache = (tmp_path / "cache").as_uri()
    rows = [(1, "same text")] * 500 + [(None, "same text")] * 50 + [(k, "same text") for k in range(2, 40)] + [(50, "other"), (51, "x" * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    sent = []
    made = type(frame).mapInArrow
    counter = spark.sparkContext.accumulator(0)

    def counted(df, run, schema):
        def through(batches):
            for b in run(batches):
                counter.add(b.num_rows)
                yield b

        sent.append(schema)
        return made(df, through, schema)

    monkeypatch.setattr(type(frame), "mapInArrow", counted)
    out = token_counts.token_counts(frame, BYTE, cache).collect()
    assert len(out) == len(rows) and counter.value == 3 and len(sent) == 1
    assert len({r.n_tokens for r in out if r.doc_id is None or r.doc_id < 50}) == 1
    again = token_counts.token_counts(frame, BYTE, cache).collect()  # nothing is missing now
    assert len(sent) == 1 and counter.value == 3 and sorted(map(str, again)) == sorted(map(str, out))


def test_the_query_keeps_its_cache(spark):
    text = hashlib.sha256(b"a text that nothing else holds").hexdigest()
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    first = token_counts.op8_token_counts(frame, BYTE).collect()
    cache = token_counts.open_cache(spark, f"{token_counts.shared_dir(spark)}/token-cache")
    own = F.col("digest") == hashlib.sha256(text.encode()).hexdigest()
    assert cache.where(own).count() == 1
    assert token_counts.op8_token_counts(frame, BYTE).collect() == first
    assert token_counts.open_cache(spark, f"{token_counts.shared_dir(spark)}/token-cache").where(own).count() == 1


def test_an_index_answers_for_any_phrases():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(60))) for _ in range(40)] + ["", None, "Ä b c"]
    shard = decontaminate.Shard(pa.array(texts))
    for seed in range(3):
        items = [(str(i), " ".join(rnd.choice("abcdefgz") for _ in range(rnd.randrange(1, 9))).encode()) for i in range(20)] + [("x", "ä B".encode())]
        phrases = decontaminate.Phrases(items, 4)
        hit, found = shard.hits(phrases, piece=7)
        base, want = 0, []
        for k, t in enumerate(texts):
            own = (t or "").lower().replace("ä", "Ä").split()
            marks, have = [False] * len(own), set()
            for name, raw in items:
                ws = raw.decode().lower().split()
                for j in range(max(1, len(ws) - 3)):
                    part = ws[j : j + 4]
                    for i in range(len(own) - len(part) + 1):
                        if own[i : i + len(part)] == part:
                            have.add(name)
                            marks[i : i + len(part)] = [True] * len(part)
            want += marks
            assert found[k] == have
        assert hit.tolist() == want


def test_phrases_are_small():
    rng = np.random.default_rng(1)
    items = [(str(i), " ".join(map(str, rng.integers(0, 50_000, 300))).encode()) for i in range(1200)]  # 2 MB
    tracemalloc.start()
    phrases = decontaminate.Phrases(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(len(t) for _, t in items)  # a full set stays under 300 MB
    assert sum(len(p[1]) for p in phrases.by_length) > 300_000


def test_vector_codes_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 33))
    unit = embeddings._unit(v)
    whole = embeddings._codes(unit, 8, 16, 3.0, 7)
    for size in (1, 2, 7, 300):
        for at in range(0, 700 - size, 97):
            part = embeddings._unit(v[at : at + size].copy())
            assert (embeddings._codes(part, 8, 16, 3.0, 7) == whole[at : at + size]).all()
