"""Token counts through a digest cache.

A text is known by the digest of its normalised content and of the tokenizer file. Stored counts are joined by those
digests; only distinct texts without a count are encoded, and their counts are appended to the cache, which is a
Parquet table. Copies of a text are encoded once, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, written

CACHE = "tokenizer string, digest string, n_tokens bigint"


def normalised(text: Column) -> Column:
    """What the count depends on: the tokenizers used here take characters as they are, so only null changes."""
    return F.coalesce(text.cast("string"), F.lit(""))


def content_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


@lru_cache(4)
def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@lru_cache(2)
def counter(path: str):
    """A function from texts to their numbers of tokens, without begin, end or added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path)
    words.no_padding()
    words.no_truncation()
    return lambda texts: [len(words.encode(t, add_special_tokens=False).ids) for t in texts]


def _counts(path: str):
    def setup():
        count = counter(path)

        def work(texts: list) -> list:
            # a few texts at a time: their ids are held together
            return [[n for t in texts for n in count([t])]]

        return work

    return setup


def open_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The stored counts; a new cache is an empty table."""
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(folder)
    return spark.read.schema(CACHE).parquet(folder)


def add_misses(docs: DataFrame, path: str, cache: str, text: str = "text") -> None:
    """Encodes the distinct texts that the cache lacks for this tokenizer and appends their counts.

    Copies are put together before the shuffle (each task sends a text once) and again after it. An append that is
    lost with its executors is made again by Spark's commit protocol; a text that two runs append has the same count
    twice, which ``token_counts`` reads once.
    """
    version = tokenizer_digest(path)
    known = open_cache(docs.sparkSession, cache).where(F.col("tokenizer") == version).select("digest")
    texts = docs.select(content_digest(F.col(f"`{text}`")).alias("digest"), normalised(F.col(f"`{text}`")).alias("text"))
    misses = texts.join(known, "digest", "left_anti").dropDuplicates(["digest"])
    counted = map_texts(misses, "text", ["digest"], "n_tokens bigint", _counts(path))
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)


def token_counts(
    docs: DataFrame, path: str, cache: str, text: str = "text", keep: Sequence[str] = ("doc_id",), limit: int = 4096
) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every text, by way of the cache.

    The counts of this tokenizer are stored once more without repeats, so that the join reads a table on both sides.

    ``cache`` is a folder that all executors share; it grows by what was missing before the result is returned.
    A null text counts like an empty one. Repeated rows give repeated results, an empty table an empty one. The join
    is left to Spark, which splits the partition of a text that fills much of the table. Kept columns named like a
    result give way to it.
    """
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in keep if c not in made]
    add_misses(docs, path, cache, text)
    counts = docs.sparkSession.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer_digest(path))
    stored = written(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("kept")
    content = F.col(f"`{text}`")
    rows = docs.select(kept, F.octet_length(normalised(content)).cast("bigint").alias("n_bytes"), content_digest(content).alias("digest"))
    return rows.join(stored, "digest", "left").select(
        *[F.col(f"kept.`{c}`") for c in keep], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
