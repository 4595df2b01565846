"""Near-duplicate and repeat operators against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from quillon.llm import embeddings, lines, simhash, substrings
from quillon.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"src{i % 12}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def reach(links, nodes):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return comp


def prose(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


# ------------------------------------------------------------------ components


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    links = [(a, a + rnd.choice([1, 2, 7])) for a in range(0, 200) if rnd.random() < 0.6] + [(500, k) for k in range(600, 700)] + [(3, 3), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == reach(real, {x for e in real for x in e})


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ op 4


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rnd = random.Random(2)
    base = [prose(rnd, 120) for _ in range(12)]
    texts = []
    for i in range(150):
        words = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = "Zz"
        texts.append((i, " ".join(words)))
    texts += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE\ttwo"), (905, " x"), (906, "É É É É É")]
    prints = {i: slow_fingerprint(t) for i, t in texts}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    comp = reach(links, prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(docs(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in prints.items()}


def test_ring_keys_lose_no_pair():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 2**63, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rnd.integers(0, 64, 3000).astype(np.uint64)
    assert (simhash.ring_keys(x) == simhash.ring_keys(y)).any(axis=1).all()


@pytest.mark.parametrize("block", [4, 4096])
def test_hot_keys_are_linked_in_blocks(spark, block):
    # All fingerprints share most keys; a chain of single-bit steps joins them, whatever the blocks are.
    chain = [0]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << (k % 12)) ^ (1 << (12 + k % 7)))
    chain = sorted(set(chain))
    rows = spark.createDataFrame([(f, i) for i, f in enumerate(chain)], "fp long, rep long")
    links = [(a, b) for a in range(len(chain)) for b in range(a) if (chain[a] ^ chain[b]).bit_count() <= 4]
    got = {(r.a, r.b) for r in simhash.near_links(rows, block=block).collect()}
    assert got <= {(min(e), max(e)) for e in links}
    assert reach(got, range(len(chain))) == reach(links, range(len(chain)))


def test_long_runs_are_clustered_exactly():
    rnd = random.Random(5)
    for _ in range(30):
        fp = np.array([rnd.getrandbits(10) << rnd.choice([0, 0, 0, 20]) for _ in range(90)], np.uint64)
        want = [(a, b) for a in range(90) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 2]
        assert reach(simhash._cluster(fp, 2), range(90)) == reach(want, range(90))


def test_simhash_of_odd_tables(spark):
    assert simhash.op4_simhash(docs(spark, [])).count() == 0
    rows = docs(spark, [(1, "a b c"), (1, "a b c"), (2, "a b c")]).union(spark.createDataFrame([(None, "a b c", None, None, None)], DOCS))
    for c in ("fp", "rep", "key", "component", "node", "class_fp", "tag"):
        rows = rows.withColumn(c, rows.n_chars)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.op4_simhash(rows).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1)]
    kept = simhash.keep_first(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1]


# ------------------------------------------------------------------ op 2


def slow_repeats(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def got_repeats(df):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op2_substring_dedup(df).collect()], key=str)


def test_substrings_equal_brute_force(spark):
    rnd = random.Random(7)
    shared = [prose(rnd, n) for n in (13, 14, 30, 60)]
    rows = [(i, " ".join([prose(rnd, rnd.randrange(30)), rnd.choice(shared), prose(rnd, rnd.randrange(20)), rnd.choice(shared)]).replace(" ", rnd.choice([" ", "  ", "\n", "\t "]))) for i in rnd.sample(range(1000), 120)]
    rows += [(2000, None), (2001, ""), (2002, "few words"), (2003, shared[3]), (2004, shared[3]), (2005, "a " * 60), (2006, "a " * 60), (2007, "é  " * 40), (2008, "é  " * 40)]
    assert got_repeats(docs(spark, rows)) == slow_repeats(rows)


def test_substrings_of_odd_tables(spark):
    assert substrings.op2_substring_dedup(docs(spark, [])).count() == 0
    text = prose(random.Random(8), 40)
    rows = [(5, text), (5, text), (5, "x y " + text), (7, text), (7, text + " z")]
    frame = docs(spark, rows).union(spark.createDataFrame([(None, text, None, None, None)], DOCS))
    for c in ("tag", "bucket", "spans", "packed", "doc", "first"):
        frame = frame.withColumn(c, frame.n_chars)
    assert got_repeats(frame) == slow_repeats(rows + [(None, text)])


def test_a_very_long_text(spark):
    text = prose(random.Random(9), 60_000, 5000)
    rows = [(1, text), (2, text[: len(text) // 2]), (3, "q " * 30 + text[1000:3000])]
    assert got_repeats(docs(spark, rows)) == slow_repeats(rows)


def test_colliding_hashes_are_found_out(monkeypatch):
    import pyarrow as pa

    real = substrings.span_hashes
    calls = []

    def weak(data, starts, ends, seed=0, **_):
        calls.append(seed)
        return real(data, starts, ends, seed) if seed else np.zeros(len(starts), np.uint64)

    monkeypatch.setattr(substrings, "span_hashes", weak)
    shard = substrings._Shard(pa.array([" ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))]))
    done, first, count, _ = substrings._attempts(substrings._cut, shard, np.array([1, 2]), 13, 3)
    assert len(done) == 0 and count.sum() == 16 and max(calls) > 0


# ------------------------------------------------------------------ op 1


def slow_vectors(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        v = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        if label is not None and len(v) and np.isfinite(v).all() and v.any():
            ok[i] = (v / np.linalg.norm(v), label)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold]
    comp = reach(links, [i for i, *_ in rows])
    return {i: (sum(i in e for e in links), comp[i], comp[i] == i) for i, *_ in rows}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_equal_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    heads = rng.standard_normal((15, 16))
    rows = []
    for i in range(250):
        noise = 0.02 if i % 2 else 0.15
        rows.append((i, [float(np.float32(x)) for x in heads[i % 15] + noise * rng.standard_normal(16)], int(i % 3)))
    rows += [(300 + k, rows[0][1], 0) for k in range(8)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 16, 0), (403, [None] + [1.0] * 15, 0), (404, [float("nan")] + [1.0] * 15, 0), (405, [float("inf")] * 16, 0), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [1.0, 2.0], 0), (409, [2.0 * x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "1 AS rep", "2 AS copies", "3 AS key")
    got = {r.vec_id: (r.n_links, r.component_id, r.component_id == r.vec_id) for r in embeddings.near_vectors(frame, block=40, tables=24).collect()}
    assert got == slow_vectors(rows)


def test_vector_recall():
    assert embeddings.recall(0.93) > 0.999 and embeddings.recall(0.98) > 0.99999


def test_no_vectors(spark):
    assert embeddings.op1_embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ------------------------------------------------------------------ op 3


def slow_lines(rows, least):
    where, first = {}, {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n")):
            plain = line.strip(" \t\r")
            if plain:
                where.setdefault(plain, set()).add(s)
                key = (i is None, i or 0, p)
                first[plain] = min(first.get(plain, key), key)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept, removed, n = [], 0, 0
        for p, line in enumerate(t.split("\n")):
            plain = line.strip(" \t\r")
            n += bool(plain)
            gone = bool(plain) and len(where[plain] - {None}) >= least and first[plain] != (i is None, i or 0, p)
            removed += gone
            if not gone:
                kept.append(line)
        out.append((i, "\n".join(kept), n, removed))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rnd = random.Random(13)
    rows = []
    for i in range(200):
        body = [prose(rnd, 4) for _ in range(rnd.randrange(4))] + rnd.sample(["  cookie notice ", "cookie notice", "menu", "rare", "", "foot\r"], 3)
        rnd.shuffle(body)
        rows.append((i, "\n".join(body), f"src{rnd.randrange(12)}" if rnd.random() < 0.9 else None))
    rows += [(300, None, "a"), (301, "", "b"), (302, "\n\n", "c"), (303, "menu\nmenu", "d"), (None, "menu\nx", "e")]
    for least in (2, 10, 13):
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS tag", "2 AS line", "3 AS gone", "4 AS h1")
        got = lines.without_boilerplate(frame, min_sites=least)
        assert got.columns == [*frame.columns, "n_lines", "n_removed"]
        assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=str) == slow_lines(rows, least)


def test_near_bound_estimates_are_counted_exactly(spark):
    rows = [(k, "edge", f"site{k}") for k in range(997)] + [(2000 + k, "over", f"site{k}") for k in range(1003)]
    got = {r.text: r.removed for r in lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=1000).groupBy("n_removed").count().selectExpr("cast(n_removed as string) text", "`count` removed").collect()}
    assert got == {"0": 998, "1": 1002}


def test_no_lines(spark):
    assert lines.op3_line_dedup(docs(spark, [])).count() == 0
