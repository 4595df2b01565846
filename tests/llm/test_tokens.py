"""BPE, token counts and decontamination against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import bpe, decontaminate, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD, BYTE, PIECE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["Hello World's <|endoftext|> Été  ñ123 aİb x 日本 \U0001f600 ﬁ", "a<|startoftext|>b<|endoftext|><|endoftext|>", "ΣΑΣ ς", "\x00\x01 tab\tq", "", "   ", "aaaaaaaaaaaa aaaaaaa!!!!!!!!", "é café it's we'll I'D ''s", "½²³ ٣ Ⅷ x1y2", "<|endoftex", "a" * 3000, "the " * 2000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(WORD), Tokenizer.from_file(WORD)


def same(own, text):
    mine, library = own
    got = mine.encode(text)
    want = library.encode(text, add_special_tokens=False)
    assert " ".join(e[0] for e in got) == " ".join(map(str, want.ids))
    assert " ".join(e[1] for e in got) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_on_every_common_character(own):
    for c in range(0x250):
        same(own, f"{chr(c)}a{chr(c)}{chr(c)} b{chr(c)}\n{chr(c)}'s")
    for text in ODD:
        same(own, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(own, text):
    same(own, text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeinorst", min_size=1, max_size=80))
def test_bpe_on_long_words(own, text):
    same(own, text)


def test_bpe_query(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None, None])] + [(None, "x"), (3, ODD[3])]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).selectExpr("*", "1 AS n_tokens", "2 AS ids")
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False)
        want.append((i, len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op7_bpe(frame, WORD).collect()), key=str) == sorted(want, key=str)
    assert bpe.op7_bpe(frame.limit(0), WORD).count() == 0
    whole = bpe.with_ids(frame.select("doc_id", "text"), WORD).where("doc_id = 0").first()
    assert list(whole.ids) == library.encode(ODD[0], add_special_tokens=False).ids and whole.n_tokens == len(whole.ids)


def test_a_cache_of_words_that_overflows(monkeypatch, own):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    mine = bpe.Encoder(WORD)
    text = " ".join(random.Random(1).choice("abcdefgh") * k for k in range(1, 60))
    assert [e[0] for e in mine.encode(text + " " + text)] == [e[0] for e in own[0].encode(text + " " + text)]
    assert len(mine.new) <= 5 and len(mine.old) <= 5 and len(mine.joins) <= 3


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_token_counts(spark, tmp_path, path):
    rows = [(i, t) for i, t in enumerate([*ODD, None, *ODD[:3]])] + [(None, "y z"), (0, ODD[0])]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).selectExpr("*", "'x' AS digest", "1 AS n_bytes", "2 AS miss")
    if path == BYTE:
        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False))
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    want = sorted([(i, len((t or "").encode()), count(t or "")) for i, t in rows], key=str)
    cache = (tmp_path / "cache").as_uri()
    for _ in range(2):
        assert sorted(map(tuple, token_counts.token_counts(frame, path, cache).collect()), key=str) == want
    stored = token_counts.open_cache(spark, cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})
    assert {r.tokenizer for r in stored.collect()} == {token_counts.tokenizer_digest(path)}


def test_only_misses_are_encoded(spark, tmp_path):
    cache = (tmp_path / "cache").as_uri()
    digest = hashlib.sha256(b"known").hexdigest()
    known = spark.createDataFrame([(digest, token_counts.tokenizer_digest(BYTE), 77), (digest, "another tokenizer", 5)], token_counts.CACHE_SCHEMA)
    known.union(known).write.parquet(cache)  # an append that was repeated
    frame = spark.createDataFrame([(1, "known"), (2, "new")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame, BYTE, cache).collect()}
    assert got == {1: 77, 2: 1}
    assert token_counts.op8_token_counts(frame.limit(0), BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_fast_counts_equal_the_library(text):
    c = token_counts.counter(BYTE)
    assert c.count(text) == len(c.library.encode(text, add_special_tokens=False))


# ------------------------------------------------------------------ op 10


def test_suffix_array():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        n = int(rnd.integers(1, 80))
        t = rnd.integers(1, 4, n) + n
        t[rnd.integers(0, n, n // 6)] = 0
        gaps = np.flatnonzero(t == 0)
        t[gaps] = np.arange(len(gaps))
        t = np.r_[t, -1]
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert decontaminate.suffix_array(t).tolist() == want


def test_fm_index_counts_and_locates():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        t = rnd.integers(0, 5, int(rnd.integers(1, 120)))
        index = decontaminate.FMIndex(t, sample=int(rnd.integers(1, 9)))
        k = int(rnd.integers(1, 5))
        patterns = rnd.integers(1, 7, (40, k))
        which, low, high = index.search(patterns)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        for w, p in enumerate(patterns.tolist()):
            assert found.get(w, []) == [i for i in range(len(t) - k + 1) if t[i : i + k].tolist() == p]


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_contamination(docs, items, k=10):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    windows = {}
    for i, t in items:
        w = WORDS.findall(low(t))
        for j in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, have = WORDS.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                own = windows.get(tuple(w[j : j + n]))
                if own:
                    have |= own
                    hit |= set(range(j, j + n))
        out.append((i, len(w), len(hit), len(have), sha(",".join(sorted(have))), bool(hit)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["alpha", "beta", "é", "x1", "Ünder", "k", "zed", "Ω"]) + str(rnd.randrange(30))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 40)))) for i in range(30)] + [(40, "two, Words"), (41, None), (42, "!!"), (None, "null item here"), (7, "second text of item seven which has more than ten words in it"), (43, "same same same same same same same same same same same same")]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rnd.randrange(20)))]
        for _ in range(rnd.randrange(3)):
            source = (rnd.choice(items)[1] or "").split()
            a = rnd.randrange(len(source) + 1)
            parts += [rnd.choice([" ", "; ", "\n"]).join(source[a : a + rnd.randrange(25)]).upper() if rnd.random() < 0.5 else " ".join(source[a:]), word()]
        docs.append((i, "  ".join(parts)))
    docs += [(500, None), (501, ""), (502, "--"), (503, "same " * 40), (504, "two words"), (504, "two words"), (None, "null item here")]
    return docs, items


@pytest.mark.parametrize("phrase_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, phrase_bytes):
    docs, items = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS items", "3 AS item")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS item")
    found = decontaminate.contamination(frame, bench, shard_bytes=2000, phrase_bytes=phrase_bytes).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.n_hit > 0) for r in found]
    assert sorted(got, key=str) == slow_contamination(docs, items)
    assert all(r.n_hit == sum(s.last - s.first + 1 for s in r.spans) for r in found)
    assert decontaminate.op10_decontamination(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.op10_decontamination(frame, bench.limit(0)).collect()} == {0}


def test_spans_are_cut_out(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminated(frame, bench)
    assert out.columns == frame.columns and out.schema.fields == frame.schema.fields
    clean = {s[0] for s in slow_contamination(docs, items) if not s[5]}
    rows = out.collect()
    assert len(rows) == len(docs)
    before = dict(docs)
    for r in rows:
        if r.doc_id in clean:
            assert r.text == before[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))
    hits = {s[0]: s for s in slow_contamination(docs, items)}
    for r in rows:
        if r.text is not None and r.doc_id is not None:
            assert len(WORDS.findall(re.sub("[A-Z]", "x", r.text))) == hits[r.doc_id][1] - hits[r.doc_id][2]
