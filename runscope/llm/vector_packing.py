"""Packing by vector bins: every sequence has limits on tokens, segments and loss-bearing tokens at once.

Texts are encoded and cut once; what is packed are small rows of sizes, so no text or id is shuffled. The pieces are
dealt into groups of bounded size, and each group is packed by the dot-product heuristic: of the pieces that fit into
the open sequence, the one whose weighted sizes agree best with the room that is left.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, without, written
from .merge_automaton import byte_symbols


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most, and about how many pieces are packed together."""

    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024
    group: int = 16_384


#: Fixed value: how the byte-level pre-tokeniser splits text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LONG_SPACE = re.compile(r"\s{10000}")


@lru_cache(2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level BPE file, special tokens in it included.

    Where the ids of the file are the ranks of its merges, tiktoken gives the same ids several times faster, so the
    vocabulary is handed to it; any other file, and texts with very long white space, go through tokenizers.
    """
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(path)
    words.no_padding()
    words.no_truncation()

    def plain(text: str) -> np.ndarray:
        return np.array(words.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocabulary = model.get("vocab", {})
    merged = ["".join(m) for m in model.get("merges", [])]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    ranked = (
        model["type"] == "BPE"
        and spec["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and split["use_regex"]
        and not split["add_prefix_space"]
        and not model["ignore_merges"]
        and not any(t[f] for t in spec["added_tokens"] for f in flags)
        and all(vocabulary[t] == 256 + i for i, t in enumerate(merged))
        and len(vocabulary) == 256 + len(merged)
    )
    if not ranked:
        return plain
    import tiktoken

    byte_of = {s: b for b, s in byte_symbols().items()}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items()}
    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    between = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(text: str) -> np.ndarray:
        if len(text) >= 10000 and _LONG_SPACE.search(text):
            return plain(text)
        if between is None or not between.search(text):
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        parts = between.split(text)
        return np.concatenate(
            [
                np.array([special[p]], np.uint32) if i % 2 else np.asarray(fast.encode_to_numpy(p, disallowed_special=()), np.uint32)
                for i, p in enumerate(parts)
            ]
        )

    return encode


PIECE = "struct<start: bigint, length: bigint, loss_tokens: bigint, ids_crc32: bigint>"


def cut_texts(
    docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), tokens: int = 1024, end_id: int = 0
) -> DataFrame:
    """One row per piece: ``keep`` columns, start, length, loss_tokens, ids_crc32, doc_tokens.

    A text is its ids and ``end_id``; it is cut every ``tokens`` ids. All of a piece bears loss but a document's first
    id, which nothing predicts. A null text is cut like an empty one, into a piece of the end id alone.
    """

    def setup():
        encode = encoder(path)

        def pieces(text: str | None) -> tuple[list, int]:
            ids = np.append(encode(text or ""), end_id).astype("<u4")
            parts = [
                {
                    "start": at,
                    "length": len(part := ids[at : at + tokens]),
                    "loss_tokens": len(part) - (at == 0),
                    "ids_crc32": zlib.crc32(part.tobytes()),
                }
                for at in range(0, len(ids), tokens)
            ]
            return parts, len(ids)

        return lambda texts: list(zip(*map(pieces, texts)))

    made = ("pieces", "doc_tokens", "start", "length", "loss_tokens", "ids_crc32")
    keep = without(keep, *made)
    cut = map_texts(docs, text, keep, f"pieces array<{PIECE}>, doc_tokens bigint", setup)
    return cut.select(*[F.col(f"`{c}`") for c in keep], "doc_tokens", F.inline("pieces"))


def pack_sizes(sizes: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in its bin for each row of ``sizes`` (tokens first), by the dot-product heuristic.

    One bin is open at a time. Pieces of equal size are alike, so a choice looks at the distinct sizes only: the
    largest dot product of size and room, both as shares of the capacity and weighted by how much of each the pieces
    ask for in all. Ties go to the first in order of size, and equal pieces are taken in the order given. A piece that
    exceeds the capacity by itself is an error.
    """
    n = len(sizes)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if (sizes > capacity).any():
        raise ValueError("a piece is larger than a sequence")
    kinds, which = np.unique(-sizes, axis=0, return_inverse=True)  # large first
    kinds, which = -kinds, which.ravel()
    queue = np.argsort(which, kind="stable")
    left = np.bincount(which, minlength=len(kinds))
    begin = np.cumsum(left) - left  # the next piece of each kind in the queue
    weight = sizes.sum(axis=0) / capacity
    weight = weight / max(weight.sum(), 1e-12) / capacity**2
    bins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    done = current = 0
    while done < n:
        some = left > 0
        if some.sum() < 0.75 * len(left):
            kinds, left, begin = kinds[some], left[some], begin[some]
        tokens, others = -kinds[:, 0], kinds[:, 1:].T
        room, place = capacity.copy(), 0
        while True:
            low = int(np.searchsorted(tokens, -room[0]))  # kinds are in order of tokens: the rest has few enough
            fits = left[low:] > 0
            score = (weight[0] * room[0]) * -tokens[low:]
            for d, size in enumerate(others, start=1):
                fits &= size[low:] <= room[d]
                score += (weight[d] * room[d]) * size[low:]
            score[~fits] = -1
            best = low + int(score.argmax()) if len(score) else low
            if best == len(left) or not fits[best - low]:
                break
            item = queue[begin[best]]
            begin[best] += 1
            left[best] -= 1
            bins[item], places[item] = current, place
            room -= kinds[best]
            place += 1
            done += 1
            if room[0] <= 0:
                break
        current += 1
    return bins, places


def pack(pieces: DataFrame, key: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (tokens before the piece in its sequence).

    ``pieces`` has length and loss_tokens, and ``key`` columns that tell its rows apart; rows that are alike in all of
    them are interchangeable. Groups are dealt by the hash of the key, their number follows the number of rows, and
    the last sequence of a group may stay part empty. Rows of one key that would fill more than a group are dealt over as
    many groups as they need, by their places in the table. ``pieces`` must be a stored table, as it is counted first.
    """
    groups = max(1, -(-pieces.count() // limits.group))
    home = F.pmod(F.xxhash64(*key), F.lit(groups))
    hashed = pieces.select(F.xxhash64(*key).alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    # bounded: fewer than there are groups
    hot = {r["_hash"]: -(-r["n"] // limits.group) for r in hashed.where(F.col("n") > limits.group).collect()}
    if hot:
        spread = pieces.sparkSession.createDataFrame(list(hot.items()), "hash bigint, parts bigint")
        # which of rows that are all alike goes where does not matter; a stored table numbers them alike on a retry
        rows = pieces.select(F.struct("*").alias("row"), F.xxhash64(*key).alias("hash"), home.alias("home"))
        part = F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1)))
        rows = rows.join(F.broadcast(spread), "hash", "left").withColumn("part", part)
        grouped = rows.select("row.*", F.pmod(F.col("home") + F.col("part"), F.lit(groups)).alias("_group"))
    else:
        grouped = pieces.withColumn("_group", home)
    capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    schema = pieces.drop("sequence_id", "offset").schema.add("sequence_id", "long").add("offset", "long")
    names = schema.fieldNames()

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*key, "length"], kind="stable").reset_index(drop=True)
        length = frame["length"].to_numpy(np.int64)
        sizes = np.column_stack([length, np.ones(len(frame)), frame["loss_tokens"].to_numpy(float)])
        bins, places = pack_sizes(sizes, capacity)
        order = np.lexsort((places, bins))
        before = np.cumsum(length[order]) - length[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(frame), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        frame["sequence_id"] = (np.int64(frame["_group"].iloc[0]) << 32) + bins
        frame["offset"] = offset
        return frame[names]

    return grouped.groupBy("_group").applyInPandas(packed, schema)


def pack_texts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limits: Limits = Limits(),
    end_id: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Encodes, cuts and packs: one row per piece with its place; ``sequence_id`` is the group and a number in it.

    The pieces are stored once (``folder``, by default below ``spark.checkpoint.dir``), so that no text is encoded
    again if an executor is lost while packing. Repeated rows are packed each for itself; an empty table gives an empty
    one; a null text is one end id. Kept columns named like a result give way to it.
    """
    keep = without(keep, "sequence_id", "offset", "_group")
    pieces = written(cut_texts(docs, path, text, keep, limits.tokens, end_id), folder)
    key = [c for c in pieces.columns if c in keep] + ["start", "ids_crc32"]
    return pack(pieces, key, limits)
