"""Benchmark decontamination with an FM-index over every shard of training texts.

A shard is a run of whole documents of one input partition.  Its index covers every word of it, numbered in a dictionary of the shard's own,
so that it answers for any set of phrases: suffix array by prefix doubling, Burrows-Wheeler
transform, rank by a wavelet matrix, suffix positions sampled at the starts of documents and every eighth word.  Backward search takes
many phrases at once, one word a step, and drops those whose range is empty; located occurrences become spans of words, merged for
each document.  A document is in one shard, so nothing is shuffled, however common a phrase is.  Hashes only bring words together:
bytes confirm that words of one number are one word.

Test phrases are broadcast in sets of at most ``phrase_bytes`` of text, packed in arrays and made one set at a time; more sets are more
passes over the same rows.

Defined cases: null and empty texts have no words and no hits; items without words occur nowhere; items of fewer words
than the window are one phrase; an item id that is null counts as the empty string; repeated documents each get their own
row, repeated items with one id count once; empty tables give no rows or no hits; further columns pass or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, U64, arrow, mixed, same_spans, slices, span_hashes, span_index, text_bytes, word_spans

#: Word bytes after lower-casing: digits, a-z, and every byte of a character beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``t`` in order, by prefix doubling that sorts only what is still tied."""
    n = len(t)
    order = np.argsort(t)
    new = np.r_[True, np.diff(t[order]) != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied, k = order[~(new & np.r_[new[1:], True])], 1
    while len(tied):
        after = np.where(tied + k < n, rank[np.minimum(tied + k, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        by = np.argsort(key)
        tied, key = tied[by], key[by]
        old = rank[tied]
        at = np.arange(len(tied))
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(old) != 0], at, 0))
        new = np.r_[True, np.diff(key) != 0]
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - first
        tied, k = tied[~(new & np.r_[new[1:], True])], 2 * k
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Counts and locates patterns in a sequence of symbols from 1 up, in which 0 separates runs."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        text = np.r_[text, 0] if not len(text) or text[-1] else text
        gaps = np.flatnonzero(text == 0)
        ordered = text + len(gaps)
        ordered[gaps] = np.arange(len(gaps))  # each separator is a symbol of its own, so no suffixes tie
        sa = suffix_array(ordered)
        self.n = len(text)
        self.bwt = text[sa - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text))]  # rows before those that start with a symbol
        starts = np.arange(self.n) % sample == 0
        starts[0] = starts[np.minimum(gaps + 1, self.n - 1)] = True
        self.sampled = starts[sa]
        self.sampled_before = np.r_[0, np.cumsum(self.sampled)]
        self.positions = sa[self.sampled]
        self.levels = []
        row = self.bwt.astype(np.int32)
        for bit in range(int(text.max(initial=0)).bit_length() - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, self.n - int(before[-1])))
            row = np.concatenate([row[~ones], row[ones]])
        self.base = self._down(np.arange(len(self.first) - 1), np.zeros(len(self.first) - 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, before, zeros in self.levels:
            ones = before[i]
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows before those of ``symbol`` followed by what the first i rows start with."""
        return self.first[symbol] + self._down(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns, as rows of one length, that occur: their numbers and ranges of rows."""
        known = (patterns < len(self.first) - 1).all(axis=1)
        which = np.flatnonzero(known)
        last = patterns[which, -1]
        low, high = self.first[last], self.first[last + 1]
        for j in range(patterns.shape[1] - 2, -1, -1):
            some = low < high
            which, low, high = which[some], low[some], high[some]
            if not len(which):
                break
            symbol = patterns[which, j]
            low, high = self.step(symbol, low), self.step(symbol, high)
        some = low < high
        return which[some], low[some], high[some]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Start in the text of the suffix in each row, by walking back to a sampled one."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            hit = self.sampled[rows]
            out[at[hit]] = self.positions[self.sampled_before[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            if len(at):
                rows = self.step(self.bwt[rows], rows)
            steps += 1
        return out


class Words:
    """The words of texts, and a number from 0 for each distinct one, in the order of their hashes."""

    def __init__(self, column: pa.Array):
        data, self.offsets = text_bytes(column)
        self.data = LOWER[data]
        self.starts, self.ends, self.row = word_spans(self.data, self.offsets, IS_WORD)
        size, self.seed = self.ends - self.starts, 0
        while True:
            self.hashes, first, self.number = np.unique(span_hashes(self.data, self.starts, self.ends, self.seed), return_index=True, return_inverse=True)
            own = first[self.number]
            other = np.flatnonzero(own != np.arange(len(own)))
            if same_spans(self.data, self.starts[other], self.starts[own[other]], size[other], size[own[other]]).all():
                break
            self.seed += 1
        self.first, self.size = self.starts[first], size[first]


def _groups(numbers: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One start for each distinct run of ``length`` numbers, and which of these the run at each start equals."""
    for seed in range(16):
        h = np.full(len(starts), seed, U64)
        for k in range(length):
            h = mixed(h * U64(0x9E3779B97F4A7C15) + numbers[starts + k].astype(U64))
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        first = starts[first]
        if all((numbers[starts + k] == numbers[first[group] + k]).all() for k in range(length)):
            return first, group
    raise RuntimeError("sixteen hashes in a row collided")


class Phrases:
    """Distinct windows of the test items over one dictionary of words, and the items that hold each, in packed arrays."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items = sorted({i for i, _ in items})
        place = {item: k for k, item in enumerate(self.items)}
        words = Words(pa.array([t.decode() for _, t in items] or [""], pa.large_string()))
        item = np.array([place[i] for i, _ in items], np.int64)
        self.seed, self.hashes, self.sizes = words.seed, words.hashes, words.size
        self.bytes = words.data[span_index(words.first, words.size)]
        self.starts = np.cumsum(words.size) - words.size
        self.numbers = words.number.astype(np.int32)
        n = np.bincount(words.row, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        begin, count = np.cumsum(n) - n, np.where(n > 0, np.maximum(1, n - window + 1), 0)
        del words
        start, owner = span_index(begin, count), np.repeat(item, count)
        length = np.repeat(np.minimum(n, window), count)
        #: length, a start in ``numbers`` for each distinct phrase, and its items as a range of the numbers that come last
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in np.unique(length).tolist():
            own = length == k
            first, group = _groups(self.numbers, start[own], k)
            pair = np.unique(group * len(self.items) + owner[own])
            self.by_length.append((k, first.astype(np.int32), np.searchsorted(pair, np.arange(len(first) + 1) * len(self.items)), (pair % len(self.items)).astype(np.int32)))

    def symbols(self, shard: Words) -> np.ndarray:
        """The symbol in the shard's index of each word of the dictionary, 0 for those that it lacks; hashes find it, bytes confirm it."""
        out = np.zeros(len(self.hashes), np.int64)
        if not len(self.hashes) or not len(shard.hashes):
            return out
        hashes, order = shard.hashes, np.arange(len(shard.hashes))
        if shard.seed != self.seed:
            order = np.argsort(shard.first)
            hashes = span_hashes(shard.data, shard.first[order], (shard.first + shard.size)[order], self.seed)
            order, hashes = order[by := np.argsort(hashes)], hashes[by]
        low, high = np.searchsorted(hashes, self.hashes, "left"), np.searchsorted(hashes, self.hashes, "right")
        both = np.concatenate([shard.data, self.bytes])
        for k in range(int((high - low).max())):  # more than one only where words of the shard collide
            some = np.flatnonzero(low + k < high)
            word = order[low[some] + k]
            same = same_spans(both, shard.first[word], len(shard.data) + self.starts[some], shard.size[word], self.sizes[some])
            out[some[same]] = word[same] + 1
        return out


class Shard:
    """The texts of a column as words and an FM-index over all of them."""

    def __init__(self, column: pa.Array):
        self.words = Words(column)
        row = self.words.row
        shift = np.cumsum(np.r_[0, np.diff(row) != 0]) if len(row) else np.zeros(0, np.int64)  # a separator after each document
        at = np.arange(len(row)) + shift
        text = np.zeros(int(at[-1]) + 2 if len(at) else 1, np.int64)
        text[at] = self.words.number + 1
        self.word = np.zeros(len(text), np.int64)
        self.word[at] = np.arange(len(row))
        self.index = FMIndex(text)

    def hits(self, phrases: Phrases, piece: int = 1 << 18) -> tuple[np.ndarray, list[set[str]]]:
        """Whether each word lies in an occurrence of a phrase, and the items that occur in each text."""
        words, edge, found = self.words, np.zeros(len(self.words.row) + 1, np.int64), [np.zeros(0, np.int64)]
        symbol = phrases.symbols(words)
        known = np.r_[0, np.cumsum(symbol[phrases.numbers] == 0)]
        for length, start, begin, owner in phrases.by_length:
            here = np.flatnonzero(known[start + length] == known[start])
            for at in range(0, len(here), piece):
                own = here[at : at + piece]
                which, low, high = self.index.search(symbol[phrases.numbers[start[own][:, None] + np.arange(length)]])
                count = high - low
                first = self.word[self.index.locate(span_index(low, count))]
                np.add.at(edge, first, 1)
                np.add.at(edge, first + length, -1)
                phrase = own[which]
                pair = np.unique(words.row[first] * (len(start) + 1) + np.repeat(phrase, count))
                row, phrase = pair // (len(start) + 1), pair % (len(start) + 1)
                n = begin[phrase + 1] - begin[phrase]
                found.append(np.unique(np.repeat(row, n) * len(phrases.items) + owner[span_index(begin[phrase], n)]))
        items: list[set[str]] = [set() for _ in range(len(words.offsets) - 1)]
        for pair in np.unique(np.concatenate(found)).tolist():
            items[pair // len(phrases.items)].add(phrases.items[pair % len(phrases.items)])
        return np.cumsum(edge[:-1]) > 0, items


class PhraseSets:
    """The items' phrases, in as many sets as keep each under about ``phrase_bytes`` of text; a set is made when it is asked for."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, window: int, phrase_bytes: int):
        self.rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null")
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n, self.window = -(-total // phrase_bytes) or 1, window

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[Phrases]:
        for k in range(self.n):
            own = self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == k)
            yield Phrases([(r.item, r.text.encode()) for r in own.toLocalIterator()], self.window)


def phrase_sets(benchmark: DataFrame, item_col: str, text_col: str, window: int, phrase_bytes: int) -> PhraseSets:
    return PhraseSets(benchmark, item_col, text_col, window, phrase_bytes)


def _merged(hit: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    """For each row the runs of hit words, as first and last word numbers within the row."""
    base = np.searchsorted(row, np.arange(n))
    first = np.flatnonzero(hit & ~np.r_[False, hit[:-1] & (row[1:] == row[:-1])]) if len(hit) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & ~np.r_[hit[1:] & (row[1:] == row[:-1]), False]) if len(hit) else np.zeros(0, np.int64)
    own = np.searchsorted(row[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, np.int64)
    return [np.stack([first[a:b], last[a:b]], axis=1) - base[k] for k, (a, b) in enumerate(zip(own[:-1], own[1:]))]


def _mark(hit: np.ndarray, base: np.ndarray, column: pa.Array) -> None:
    """Set ``hit`` on the words that the spans of ``column`` hold, whose row k begins at word ``base[k]``."""
    for k, spans in enumerate(column.to_pylist()):
        for s in spans:
            hit[base[k] + s["first"] : base[k] + s["last"] + 1] = True


def _span_array(spans: list[np.ndarray]) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in x.tolist()] for x in spans], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_bytes: int = 2 << 20, phrase_bytes: int = 7 << 20) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` for every row; ``spans`` are merged runs of hit words, as first and last word number."""
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    sets = phrase_sets(benchmark, item_col, item_text_col, window, phrase_bytes)
    for number, phrases in enumerate(sets, 1):
        sent = spark.sparkContext.broadcast(phrases)
        names = [c for c in out.columns if c != "text" or number < len(sets)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", shard_bytes):
                    shard = Shard(batch.column("text"))
                    row, (hit, items) = shard.words.row, shard.hits(sent.value)
                    base = np.searchsorted(row, np.arange(batch.num_rows))
                    _mark(hit, base, batch.column("spans"))
                    items = [sorted(a | set(b)) for a, b in zip(items, batch.column("items").to_pylist())]
                    n, m = (np.bincount(row, minlength=batch.num_rows), np.bincount(row[hit], minlength=batch.num_rows))
                    new = {"n_words": pa.array(n, pa.int64()), "n_hit": pa.array(m, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "spans": _span_array(_merged(hit, row, batch.num_rows))}
                    yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

        out = out.mapInArrow(run, out.select(names).schema)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 2 << 20, phrase_bytes: int = 7 << 20) -> DataFrame:
    """``docs`` with every merged span cut out of ``text``, from its first hit word to its last; other columns and rows stay.

    ``n_chars``, where there is such a column, is the new text's length.
    """
    spans = "__spans"
    while spans in docs.columns:
        spans += "_"
    out = docs.withColumn(spans, F.array().cast("array<struct<first:int,last:int>>"))
    at, held = docs.columns.index("text"), len(docs.columns)
    sets = phrase_sets(benchmark, "item_id", "text", window, phrase_bytes)
    for number, phrases in enumerate(sets, 1):
        # Cut once, after the last set: a cut would break windows of later sets and join words that were apart.
        sent = docs.sparkSession.sparkContext.broadcast(phrases)
        last = number == len(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", shard_bytes):
                    shard = Shard(batch.column("text"))
                    starts, ends, row = shard.words.starts, shard.words.ends, shard.words.row
                    hit, _ = shard.hits(sent.value)
                    base = np.searchsorted(row, np.arange(batch.num_rows))
                    _mark(hit, base, batch.column(held))
                    merged = _merged(hit, row, batch.num_rows)
                    if not last:
                        yield batch.set_column(held, spans, _span_array(merged))
                        continue
                    texts = batch.column("text").to_pylist()
                    data, offsets = text_bytes(batch.column("text"))
                    for k, own in enumerate(merged):
                        if len(own):
                            raw, done, kept = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                            for a, b in (own + base[k]).tolist():
                                kept.append(raw[done : starts[a] - offsets[k]])
                                done = ends[b] - offsets[k]
                            texts[k] = b"".join([*kept, raw[done:]]).decode()
                    cut = batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type))
                    yield cut.select(list(range(held)))

        out = out.mapInArrow(run, docs.schema if last else out.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bi AS (SELECT item_id, words, unnest(generate_series(1, greatest(1, len(words) - 9))) AS i FROM b WHERE len(words) > 0),
k AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i:i + 9], ' ') AS k FROM bi),
di AS (SELECT doc_id, n, words, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(words) >= n),
hit AS (SELECT doc_id, item_id, i, k.n FROM (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS k FROM di) JOIN k USING (n, k)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
q AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
