"""Near duplicates by SimHash fingerprints, found through Golay-code fuzzy keys.

A fingerprint is cut into three segments. The binary Golay code is perfect: every 23-bit word is within three bits of
exactly one of its 4096 codewords. The keys of a segment are the codeword indices of the segment and of all words one
bit away from it: one key if the segment is within two bits of its codeword, else up to six. Two segments that differ
in at most two bits have a word within one bit of both, so they share a key.

Fingerprints that differ in at most five bits have two segments that differ in at most two bits each, so they share a
pair of keys for one of the three pairs of segments. Fingerprints with an equal pair of keys are brought together and
compared; only links that hold are kept, and of those only as many as connect what is connected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable_on_workers, map_texts, shared_folder, written

SEED = 42
SHINGLE = 4
#: Lowest bit and width of each segment, and the pairs of segments that give keys.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
MOST_BITS = 5

#: Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b110001110101


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator: the syndromes of the words."""
    out = words.astype(np.int32)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@lru_cache(1)
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """The error pattern of each of the 2048 syndromes, and the syndrome of each single bit."""
    bits = 1 << np.arange(23)
    patterns = [np.array([0]), bits]
    for _ in range(2):
        more = (patterns[-1][:, None] | bits[None, :]).ravel()
        weight = np.bitwise_count(patterns[-1][0]) + 1
        patterns.append(np.unique(more[np.bitwise_count(more) == weight]))
    every = np.concatenate(patterns).astype(np.int32)
    table = np.empty(2048, np.int32)
    table[_remainders(every)] = every
    return table, _remainders(bits)


def segment_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and of its neighbours in ``width`` bits, sorted; -1 in place of repeats."""
    table, single = _errors()
    words = words.astype(np.int32)
    flips = np.r_[0, 1 << np.arange(width)].astype(np.int32)
    syndromes = _remainders(words)[:, None] ^ np.r_[0, single[:width]].astype(np.int32)
    index = (words[:, None] ^ flips ^ table[syndromes]) >> 11  # systematic: the message is on top
    index.sort(axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each key of each fingerprint; a key names its pair of segments and the two indices."""
    keys = [segment_keys(fingerprints >> np.uint64(low) & np.uint64((1 << width) - 1), width) for low, width in SEGMENTS]
    # repeats go to the end; six columns hold all indices of a segment
    keys = [-np.sort(-k, axis=1)[:, :6] for k in keys]
    rows, out = [], []
    for pair, (i, j) in enumerate(PAIRS):
        both = (keys[i][:, :, None] >= 0) & (keys[j][:, None, :] >= 0)
        row, a, b = np.nonzero(both)
        rows.append(row)
        out.append((np.int64(pair) << 24) | (keys[i][row, a].astype(np.int64) << 12) | keys[j][row, b])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of word 4-shingles, repeats included: a bit is set if it is in over half of the hashes.

    A-Z is lower-cased; words are separated by the six ASCII white-space characters; a shorter text is one shingle;
    a text without words has fingerprint 0. Hashes are XXH64 with seed 42.
    """
    words = (text or "").encode().lower().split()  # of bytes, both work on ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.r_[0, ends[: n - 1] + 1].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * counts > n).tolist()
    return sum(1 << b for b in bits)


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` as a signed 64-bit integer."""

    def setup():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs, text, keep, "fingerprint bigint", setup)


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes, for links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


#: Buckets up to this size are compared by shifting the whole batch, larger ones each by itself.
_SHIFTED = 32


def _links(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that link, for buckets that lie one after the other."""
    left, right = [], []
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat(sizes <= _SHIFTED, sizes)
    for by in range(1, min(int(sizes.max(initial=0)), _SHIFTED)):
        same = (bucket[by:] == bucket[:-by]) & small[by:]
        i = np.flatnonzero(same)
        if len(i):
            i = i[np.bitwise_count(values[i] ^ values[i + by]) <= bits]
            left.append(i)
            right.append(i + by)
    for k in np.flatnonzero(sizes > _SHIFTED):
        # from each value found, look for others not yet found: no pair is held, and a bucket of copies takes few looks
        rest = np.arange(starts[k], starts[k] + sizes[k])
        found: list[int] = []
        while len(rest):
            if not found:
                found, rest = [int(rest[0])], rest[1:]
                continue
            at = found.pop()
            near = np.bitwise_count(values[rest] ^ values[at]) <= bits
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), at))
                right.append(new)
                found += new.tolist()
                rest = rest[~near]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64)


def links(prints: DataFrame, bits: int = 4, rows_at_once: int = 400_000) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints that connect exactly what links of ``bits`` bits connect.

    ``prints`` has distinct fingerprints. Rows of a bucket hold 8 bytes each; what a task returns for a batch of
    buckets is one row for each fingerprint that is linked to another there.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"segments are cut for at most {MOST_BITS} bits")
    importable_on_workers(prints.sparkSession)
    key_schema = pa.schema([("key", pa.int64()), ("fingerprint", pa.int64())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                values = batch.column(0).slice(at, 4096).to_numpy()
                rows, keys = fuzzy_keys(values.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], schema=key_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys: list[np.ndarray] = []
        held_values: list[np.ndarray] = []

        def flush(last: bool) -> pa.RecordBatch | None:
            keys, values = np.concatenate(held_keys), np.concatenate(held_values)
            stop = len(keys) if last else int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            held_keys[:], held_values[:] = [keys[stop:]], [values[stop:]]
            keys, values = keys[:stop], values[:stop].view(np.uint64)
            if not stop:
                return None
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, stop])
            i, j = _links(values, starts, sizes, bits)
            nodes, inverse = np.unique(np.r_[values[i], values[j]].view(np.int64), return_inverse=True)
            root = _roots(len(nodes), inverse[: len(i)], inverse[len(i) :])
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], schema=link_schema)

        rows = 0
        for batch in batches:
            held_keys.append(batch.column(0).to_numpy())
            held_values.append(batch.column(1).to_numpy())
            rows += batch.num_rows
            if rows >= rows_at_once:
                out = flush(False)
                rows = len(held_keys[0])
                if out is not None:
                    yield out
        if held_keys:
            out = flush(True)
            if out is not None:
                yield out

    keyed = prints.select("fingerprint").mapInArrow(spread, "key bigint, fingerprint bigint")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node of its component.

    Large-star and small-star steps in turn, until a round changes nothing; every step is an aggregate and a join.
    Both are stored in ``folder``, so that the join reads tables and the partition of a node with many links can be
    split. Nothing is gathered but two numbers a round.
    """

    def stored(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{folder}/{name}")

    def to_smallest(both: DataFrame, name: str) -> DataFrame:
        """(u, v, m): m the smallest of u and its neighbours."""
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(stored(least, name), "u")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, before, number = stored(edges.distinct(), "0"), None, 0
    while (after := state(now)) != before:
        before, number = after, number + 1
        both = now.selectExpr("inline(array(struct(a AS u, b AS v), struct(b AS u, a AS v)))")
        large = to_smallest(both, f"{number}-large-least").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stored(large.distinct(), f"{number}-large")
        down = to_smallest(large.selectExpr("a AS u", "b AS v"), f"{number}-small-least")
        small = down.selectExpr("inline(array(struct(u AS a, m AS b), struct(v AS a, m AS b)))").where("a <> b")
        now = stored(small.distinct(), f"{number}-small")
    return now.selectExpr("a AS node", "b AS root")


def classes(rows: DataFrame, bits: int, folder: str) -> DataFrame:
    """(fingerprint, root, component_id) for each distinct fingerprint of ``rows`` (doc_id, fingerprint).

    ``root`` names the component also where all of its ids are null.
    """
    prints = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), f"{folder}/prints")
    found = components(links(prints, bits), f"{folder}/links")
    rooted = prints.join(found, prints["fingerprint"] == found["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return written(rooted.join(smallest, "root").select("fingerprint", "root", "component_id"), f"{folder}/classes")


def _stored_prints(docs: DataFrame, text: str, doc_id: str, folder: str) -> DataFrame:
    made = fingerprints(docs, text, [doc_id]).select(F.col(f"`{doc_id}`").alias("doc_id"), "fingerprint")
    return written(made, f"{folder}/rows")


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 4, folder: str | None = None
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Fingerprints link at ``bits`` or fewer differing bits; ``component_id`` is the smallest doc_id that links reach,
    the row's own included. Copies have one fingerprint and are put together before anything is compared, so a group
    of copies costs one row. A null text counts like an empty one: fingerprint 0, linked like any other. Null ids are
    passed over for ``component_id``, which is null if there is no other; repeated ids give repeated rows; an empty
    table gives an empty one. Other columns are not read. Intermediate tables are stored in ``folder`` (by default
    below ``spark.checkpoint.dir``).
    """
    folder = folder or shared_folder(docs.sparkSession)
    rows = _stored_prints(docs, text, doc_id, folder)
    of_print = classes(rows, bits, folder).drop("root")
    return rows.join(of_print, "fingerprint").select(
        F.col("doc_id").alias(doc_id), hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 4, folder: str | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay when of each group of near duplicates one does: that with the smallest doc_id
    (of equal ids, that with the smallest fingerprint; null ids only where there are no others).

    One pass makes the fingerprints and stores them with the rows and a number for each row. Who stays is worked out on
    numbers, ids and fingerprints; the stored rows then lose those whose number is in the table of the others. Texts are
    shuffled only if that table is too large for Spark to broadcast, and then by their numbers, so that copies do not meet
    in one task.
    """
    folder = folder or shared_folder(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.select(row, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = fingerprints(held, "text", ["row", "doc_id"]).withColumn("row_no", F.monotonically_increasing_id())
    stored = written(made, f"{folder}/rows")
    rows = stored.select("row_no", "doc_id", "fingerprint")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fingerprint", "row_no")).alias("first")
    heads = rows.join(classes(rows, bits, folder), "fingerprint").groupBy("root").agg(first).select("first.row_no")
    others = written(rows.join(heads, "row_no", "left_anti").select("row_no"), f"{folder}/others")
    return stored.join(others, "row_no", "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
