"""Token counts through a digest cache: only contents that the cache lacks are encoded, once each.

A content's key is the SHA-256 of its bytes together with a digest of the tokenizer file, so that another tokenizer or a changed file
never finds old counts.  Null content is normalised to the empty text and nothing else is: the tokenizer is sensitive to
every other change.  Misses are the distinct digests that the cache has no row for; one document stands for each, found by its digest and id, so that
copies under different ids don't meet in one task.  Rows that repeat both meet, and only the first of them is encoded.  New counts are
appended to the cache, and all rows get their counts from the cache; without a miss no text is shuffled at all.

The cache is a Parquet table ``digest, tokenizer, n_tokens``.  An append that is repeated after a failure adds equal rows, which the
lookup folds; so do appends of several jobs at once.

Counts are those of the ``tokenizers`` library for the file, strings of special tokens being those tokens.  Texts of common characters are
encoded by ``tiktoken`` from the same vocabulary, which is faster; all others by the library itself.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get their row and cost one encoding in a task; null doc_ids are
counted too, each content's in a task of its own; an empty table gives no rows and an unchanged cache; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import arrow, shared_dir, slices, stored

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
#: Characters that both libraries class alike in all Unicode versions.
UNCOMMON = re.compile("[^\x00-ɏ‐-‧€]")
#: The cut into words that byte-level models make by default.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Counts tokens as the library does."""

    def __init__(self, path: str):
        self.model = path.endswith(".model")
        self.fast = None
        if self.model:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        import tiktoken
        from tokenizers import Tokenizer

        from quillon.llm.bpe import byte_letters

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        plain = model["type"] == "BPE" and not (spec["normalizer"] or spec["post_processor"] or model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model.get("ignore_merges") or model["byte_fallback"])
        if plain and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            merged = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
            if merged == sorted(merged) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):  # ids in order of merges, as ranks must be
                self.fast = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)

    def count(self, text: str) -> int:
        if self.model:
            return len(self.library.encode(text))
        if self.fast is not None and not UNCOMMON.search(text):
            return len(self.fast.encode(text, allowed_special="all"))
        return len(self.library.encode(text, add_special_tokens=False))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def tokenizer_digest(path: str) -> str:
    """Of the tokenizer's file and of the versions of the libraries that encode."""
    with open(path, "rb") as f:
        known = hashlib.sha256(f.read())
    known.update(" ".join(f"{name}={version(name)}" for name in ("sentencepiece", "tiktoken", "tokenizers")).encode())
    return known.hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; an empty cache is made where there is none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text; ``cache`` is the folder of the cache and gains what it lacked."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    place = F.xxhash64("doc_id")  # of documents without an id the same, which only their digest tells apart
    keyed = stored(rows.select("doc_id", "digest", place.alias("place"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    have = open_cache(spark, cache).where(F.col("tokenizer") == tokenizer).select("digest").distinct()
    missing = keyed.groupBy("digest").agg(F.min("place").alias("first")).join(have, "digest", "left_anti")
    missing = stored(missing, "missing").select(F.col("digest").alias("miss"), "first")
    schema = pa.schema([("digest", pa.string()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = counter(path), set()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                new = [k for k, d in enumerate(batch.column("digest").to_pylist()) if d not in done and not done.add(d)]
                batch = batch.take(pa.array(new, pa.int32()))
                yield arrow(schema, digest=batch.column("digest"), n_tokens=[coder.count(t.as_py()) for t in batch.column("text")])

    if not missing.isEmpty():
        once = rows.join(missing, (place == F.col("first")) & (F.col("digest") == F.col("miss")))
        counted = once.select("digest", "text").mapInArrow(count, "digest string, n_tokens long")
        counted.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")).select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = open_cache(spark, cache).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    known = known.select(F.concat(F.col("digest"), F.lit("")).alias("known"), "n_tokens")
    return keyed.join(known, F.col("digest") == F.col("known")).select("doc_id", "n_bytes", "n_tokens")


def op8_token_counts(docs: DataFrame, path: str, limit: int = 1024, cache: str | None = None) -> DataFrame:
    """Counts and whether they exceed ``limit``; without ``cache`` the one named ``token-cache`` in the shared folder, which outlives the session."""
    cache = cache or f"{shared_dir(docs.sparkSession)}/token-cache"
    return token_counts(docs, path, cache).withColumn("over_limit", F.col("n_tokens") > limit)
