"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word exactly one token can be the last of its encoding.  An Aho-Corasick automaton over the
vocabulary lists, at each position, all tokens that are suffixes of the prefix; a candidate is the one if it is
compatible with the last token of the prefix before it, which a walk down both tokens' merge trees decides.  The
stored tokens are back-pointers: following them from the end of the word gives its ids.  No merge queue is run.

The tokenizer is a file of the ``tokenizers`` library with a byte-complete BPE model and an end-of-word suffix; it is
a parameter, never trained and never copied.  Its own normaliser and pre-tokeniser cut a text into words, except that texts
of common characters, for which the same cuts are one regular expression, take that.  Strings of added tokens are those tokens.

Defined cases: null text encodes as the empty text, to no ids and the empty string; repeated rows each get their row; long words
take time in proportion to their length; an empty table gives no rows; further columns pass or are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quillon.llm.common import slices

#: Words that a worker keeps encoded: the newest of these many, and as many before them.
CACHE_WORDS = 100_000
#: Pairs of tokens whose compatibility a worker remembers.
CACHE_PAIRS = 300_000
#: Characters that lower-casing and cutting treat alike in all Unicode versions, and that composition leaves alone.
UNCOMMON = re.compile("[^\x00-ɏ‐-‧€]")
#: What the fast cut stands for.
CUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
COMMON_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte, and that byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts as the library does.  A word is a string of symbols: byte b is chr(b), the last one chr(256 + b)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix:
            raise ValueError("a BPE model with an end-of-word suffix is needed")
        self.simple = all(spec[k] == v for k, v in CUT.items())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.name = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        letters = byte_letters()

        def symbols(token: str) -> str:
            end = token.endswith(suffix) and token != suffix
            out = [letters[c] for c in (token.removesuffix(suffix) if end else token)]
            return "".join(map(chr, [*out[:-1], out[-1] + 256 * end]))

        vocab = {symbols(t): i for t, i in model["vocab"].items() if t not in self.added}
        if len({s for s in vocab if len(s) == 1}) != 512:
            raise ValueError("the vocabulary lacks bytes")
        # Rank -1: single symbols.  Else the number of the merge that makes the token.
        self.rank, self.parts, self.pair = {i: -1 for i in vocab.values()}, {}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = (vocab[symbols(x)] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            made = vocab[symbols(self.name[a] + self.name[b])]
            self.rank[made], self.parts[made], self.pair[a, b] = r, (a, b), r
        self.automaton = ahocorasick.Automaton()
        self.sound: dict[int, bool] = {}
        self.joins: dict[tuple[int, int], bool] = {}
        for s, i in vocab.items():
            self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.new: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}

    def _apart(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge over the border of two adjacent tokens comes before the merges inside them.

        Both sides are taken apart from the latest merge back.  Equal merges run from the left, so that one over the
        border precedes an equal one on its right and follows an equal one on its left.  ``before``: only merges of lower rank count.
        """
        left_made = right_made = len(self.rank) if before is None else before
        while True:
            over = self.pair.get((left, right))
            if over is not None and over < left_made and (over <= right_made if right_made != before else over < right_made):
                return False
            lr, rr = self.rank[left], self.rank[right]
            if lr < 0 and rr < 0:
                return True
            if lr > rr:
                left_made, left = lr, self.parts[left][1]
            else:
                right_made, right = rr, self.parts[right][0]

    def _is_sound(self, token: int) -> bool:
        """Whether a word of just this token's symbols is encoded as this token."""
        known = self.sound.get(token)
        if known is None:
            known = self.rank[token] < 0
            if not known:
                a, b = self.parts[token]
                known = self._is_sound(a) and self._is_sound(b) and self._apart(a, b, self.rank[token])
            self.sound[token] = known
        return known

    @cached_property
    def library(self):
        """The library's tokenizer, for its normaliser and its cuts; loaded with the first text that needs them."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def tokens(self, word: str) -> list[int]:
        """Ids of one word, given as UTF-8 text."""
        s = word.encode().decode("latin-1")
        s = s[:-1] + chr(ord(s[-1]) + 256)
        last: list[tuple[int, int] | None] = [None] * (len(s) + 1)
        joins = self.joins
        for end, (token, size) in self.automaton.iter(s):
            end += 1
            if last[end] is not None:
                continue
            if size == end:
                fits = self._is_sound(token)
            else:
                back = last[end - size]
                key = (back[0], token)
                fits = joins.get(key)
                if fits is None:
                    fits = self._is_sound(token) and self._apart(*key)
                    if len(joins) >= CACHE_PAIRS:
                        joins.clear()
                    joins[key] = fits
            if fits:
                last[end] = (token, size)
        out, end = [], len(s)
        while end:
            token, size = last[end]
            out.append(token)
            end -= size
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if self.simple and not UNCOMMON.search(text):
            return COMMON_WORDS.findall(text.lower())
        letters = _LETTERS
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(letters[c] for c in w).decode() for w, _ in cut]

    def entry(self, word: str) -> tuple[str, str, int]:
        """A word's ids as decimal text, its decoding and its number of ids."""
        found = self.old.get(word)
        if found is None:
            ids = self.tokens(word)
            found = " ".join(map(str, ids)), self.decode(ids), len(ids)
        if len(self.new) >= CACHE_WORDS:
            self.old, self.new = self.new, {}
        self.new[word] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder: the tokens' strings, joined by one space."""
        return " ".join([self.name[i] for i in ids])

    def encode(self, text: str) -> list[tuple[str, str, int]]:
        """The entries of a text's words and added tokens, in order."""
        out = []
        for k, part in enumerate(self.cut_added.split(text) if self.cut_added and "<" in text else [text]):
            if k % 2:
                out.append((str(self.added[part]), part, 1))
            else:
                for w in self.words(part):
                    out.append(self.new.get(w) or self.entry(w))
        return out


_LETTERS = byte_letters()
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mapped(docs: DataFrame, path: str, text_col: str, more: str, columns: Callable[[list[tuple[str, str, int]]], tuple]) -> DataFrame:
    """``docs`` with columns computed from each text's entries, in place of columns of those names."""
    added = StructType.fromDDL(more)
    names = added.fieldNames()
    docs = docs.drop(*names)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.dataType.simpleString()] for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            for batch in slices(whole, text_col, 2 << 20):
                rows = [columns(coder.encode(t.as_py() or "")) for t in batch.column(text_col)]
                made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added.fields]))


def with_ids(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded``."""
    def columns(entries):
        ids = " ".join([e[0] for e in entries])
        ids = np.array(ids.split(), np.int32)
        return len(ids), ids, " ".join([e[1] for e in entries])

    return _mapped(docs, path, text_col, "n_tokens long, ids array<int>, decoded string", columns)


def op7_bpe(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""
    def columns(entries):
        ids = " ".join([e[0] for e in entries])
        text = " ".join([e[1] for e in entries])
        return sum([e[2] for e in entries]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs.select("doc_id", "text"), path, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", columns).drop("text")
