from __future__ import annotations

import hashlib
import random
import zlib

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runscope.llm import merge_automaton as m
from runscope.llm import token_count_cache as c
from runscope.llm import vector_packing as v
from runscope.llm.common import shared_folder
from runscope.llm.queries import QUERIES

from .helpers import awkward, table

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))

ODD = ["a", "B", "ab", "ll", "'s", "'LL", "the", "ing", " ", "  ", "\n", "\t", "1", "99", "!", "...", "é", "é", "ß", "Σ",
       "日本", "😀", "<|endoftext|>", "<|startoftext|>", "</w>", "\x1c", "\xa0", "İ", "_", "aaaaaaaaaaa"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(30))) for _ in range(n)]


# ---- automaton


def plain_bpe(symbols, merges):
    rank = {pair: i for i, pair in enumerate(merges)}
    while True:
        found = [(rank[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in rank]
        if not found:
            return symbols
        best = min(found)[0]
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and rank.get((symbols[i], symbols[i + 1])) == best:
                out.append(symbols[i] + symbols[i + 1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out


@pytest.mark.parametrize("seed", range(12))
def test_automaton_of_random_merges(seed):
    """Merges learned from random words (so that each can occur), then compared with plain merging on other words."""
    r = random.Random(seed)
    letters = "abc"[: 2 + seed % 2]
    corpus = [[*"".join(r.choice(letters) for _ in range(r.randrange(2, 20)))] for _ in range(60)]
    corpus = [[*w[:-1], w[-1] + "$"] for w in corpus]
    merges = []
    for _ in range(25):
        now = [plain_bpe(w, merges) for w in corpus]
        pairs = sorted({pair for w in now for pair in zip(w, w[1:])} - {*merges})
        made = {a + b for a, b in merges}
        pairs = [x for x in pairs if x[0] + x[1] not in made]
        if not pairs:
            break
        merges.append(r.choice(pairs))
    base = [*letters, *(x + "$" for x in letters)]
    vocabulary = {x: i for i, x in enumerate([*base, *(a + b for a, b in merges)])}
    automaton = m.TokenAutomaton(vocabulary, merges, "$")
    for _ in range(400):
        word = "".join(r.choice(letters) for _ in range(r.randrange(1, 30)))
        got = [automaton.labels[i] for i in automaton.encode(word.encode())]
        assert got == plain_bpe([*word[:-1], word[-1] + "$"], merges)


def test_word_tokenizer_like_the_library():
    mine, other = m.load(WORD), library(WORD)
    for text in ["", *odd_texts(1500, 1), "supercalifragilistic " * 50, "x" * 5000]:
        ids, decoded = mine.encode(text)
        expected = other.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == expected, repr(text)
        assert decoded == other.decode(expected, skip_special_tokens=False)


def test_encode_query_and_round_trip(spark):
    other = library(WORD)
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for row in QUERIES["op6_merge_automaton"](spark, SF).collect():
        ids = other.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        decoded = other.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    encoded = m.encode_texts(table(spark, ["Hello  World!", "", None]), WORD, outputs=["ids", "decoded"])
    rows = m.decode_ids(encoded.withColumn("again", F.lit(1)), WORD, into="again").collect()
    assert all(r["again"] == r["decoded"] for r in rows) and rows[0]["decoded"] == "hello</w> world</w> !</w>"
    assert rows[1]["ids"] == rows[2]["ids"] == []


def test_encode_awkward_rows(spark):
    df = awkward(spark, clash=["ids", "_text"])
    rows = m.encode_texts(df, WORD, keep=["doc_id", "ids", "_text"]).collect()
    assert len(rows) == 9 and all(r["_text"] == "clash" for r in rows)
    assert {r["doc_id"]: r["n_tokens"] for r in rows}[2] == 0
    assert m.encode_texts(table(spark, []), WORD).collect() == []


# ---- token counts


def test_counts_like_the_library(spark):
    other = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for row in QUERIES["op7_token_count_cache"](spark, SF).collect():
        text = texts[row["doc_id"]]
        n = len(other.encode(text))
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_cache_keeps_and_adds(spark):
    cache = shared_folder(spark)
    texts = ["one text", "one text", "<s> other </s>", None, ""]
    first = c.token_counts(table(spark, texts), PIECE, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 3 and len(first) == 5
    # what is stored is believed, so a changed count shows that nothing is encoded again
    other = shared_folder(spark)
    stored.withColumn("n_tokens", F.lit(777).cast("bigint")).write.parquet(other)
    again = c.token_counts(table(spark, [*texts, "new"]), PIECE, other, limit=5).collect()
    assert sorted(r["n_tokens"] for r in again) == [1, 777, 777, 777, 777, 777]
    assert spark.read.parquet(other).count() == 4 and sum(r["over_limit"] for r in again) == 5
    # another tokenizer has counts of its own
    by_word = c.token_counts(table(spark, ["one text"]), WORD, other).first()
    assert by_word["n_tokens"] == 2 and spark.read.parquet(other).count() == 5


def test_counts_of_awkward_rows(spark):
    df = awkward(spark, clash=["digest", "n_tokens"])
    rows = c.token_counts(df, PIECE, shared_folder(spark), keep=["doc_id", "digest", "n_tokens"]).collect()
    assert len(rows) == 9 and all(r["digest"] == "clash" and r["n_tokens"] is not None for r in rows)
    assert c.token_counts(table(spark, []), PIECE, shared_folder(spark)).collect() == []


# ---- packing


def test_encoder_like_the_library():
    encode, other = v.encoder(BYTE), library(BYTE)
    for text in ["", *odd_texts(1500, 2), " " * 20_000 + "x", "\n \t" * 10, "x" * 3000]:
        assert encode(text).tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(rows, limits):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(r["loss_tokens"] for r in pieces) <= limits.loss_tokens
    return by


def test_packing_query(spark):
    other = library(BYTE)
    rows = QUERIES["op8_vector_packing"](spark, SF).collect()
    by = check_packing(rows, v.Limits())
    assert sum(r["length"] for r in rows) / (1024 * len(by)) > 0.97
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(texts)
    for doc_id, text in texts:
        ids = np.array([*other.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(docs[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_pack_sizes_keeps_all_limits():
    r = np.random.default_rng(1)
    capacity = np.array([100.0, 6.0, 40.0])
    tokens = r.integers(1, 101, 500)
    sizes = np.column_stack([tokens, np.ones(500), np.minimum(r.integers(0, 41, 500), tokens)]).astype(float)
    bins, places = v.pack_sizes(sizes, capacity)
    for b in np.unique(bins):
        assert (sizes[bins == b].sum(axis=0) <= capacity).all()
        assert sorted(places[bins == b]) == list(range((bins == b).sum()))
    lower = np.ceil((sizes.sum(axis=0) / capacity).max())
    assert len(np.unique(bins)) <= 1.15 * lower
    assert v.pack_sizes(np.empty((0, 3)), capacity)[0].size == 0
    with pytest.raises(ValueError):
        v.pack_sizes(np.array([[101.0, 1, 0]]), capacity)


def slow_pack(sizes, capacity):
    """The heuristic row by row: of all pieces that fit, the one of the greatest dot product of size and room."""
    weight = sizes.sum(axis=0) / capacity
    weight = weight / weight.sum() / capacity**2
    waiting, bins, places, current = list(range(len(sizes))), {}, {}, 0
    while waiting:
        room, place = capacity.copy(), 0
        while room[0] > 0:
            fits = [i for i in waiting if (sizes[i] <= room).all()]
            if not fits:
                break
            # ties: large first by tokens, then segments, then loss, then the order given
            best = max(fits, key=lambda i: (round(float((weight * room * sizes[i]).sum()), 12), *sizes[i], -i))
            waiting.remove(best)
            bins[best], places[best] = current, place
            room, place = room - sizes[best], place + 1
        current += 1
    return [bins[i] for i in range(len(sizes))], [places[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_pack_sizes_against_a_plain_loop(seed):
    r = np.random.default_rng(seed)
    capacity = np.array([64.0, 5.0, 24.0])
    tokens = r.integers(1, 65, 120)
    sizes = np.column_stack([tokens, np.ones(120), np.minimum(r.integers(0, 25, 120), tokens)]).astype(float)
    bins, places = v.pack_sizes(sizes, capacity)
    assert (bins.tolist(), places.tolist()) == slow_pack(sizes, capacity)


def test_rows_of_one_key_are_dealt_over_groups(spark, tmp_path):
    """Copies with one id, or with none: no group holds many times its size."""
    rows = [(None, 0, 7, 20)] * 900 + [(5, 0, 9, 30)] * 400 + [(i, 0, i, 1 + i % 40) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, start bigint, ids_crc32 bigint, length bigint")
    df.selectExpr("*", "length AS loss_tokens", "1 AS _parts").write.parquet(str(tmp_path / "pieces"))
    limits = v.Limits(tokens=64, segments=8, loss_tokens=64, group=100)
    stored = spark.read.parquet(str(tmp_path / "pieces"))
    packed = v.pack(stored, ["doc_id", "start", "ids_crc32"], limits).collect()
    assert Counter((r.doc_id, r.length) for r in packed) == Counter((r[0], r[3]) for r in rows)
    check_packing(packed, limits)
    assert max(Counter(r.sequence_id >> 32 for r in packed).values()) <= 4 * limits.group


def test_packing_instruction_examples(spark):
    """The packer takes any table of sizes: here examples whose answers alone bear loss."""
    limits = v.Limits(tokens=64, segments=3, loss_tokens=20, group=50)
    df = spark.range(200).selectExpr("id AS example", "id % 40 + 1 AS length", "least(id % 15, id % 40 + 1) AS loss_tokens")
    rows = v.pack(df, ["example"], limits).collect()
    assert len(rows) == 200
    check_packing(rows, limits)


def test_packing_awkward_rows(spark):
    df = awkward(spark, clash=["sequence_id", "start", "_group"])
    made = v.pack_texts(df, BYTE, keep=["doc_id", "source", "sequence_id", "start", "_group"])
    rows = made.collect()
    check_packing(rows, v.Limits())
    assert made.columns.count("sequence_id") == 1 and made.columns.count("start") == 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and next(r for r in rows if r["doc_id"] == 2)["doc_tokens"] == 1
    assert v.pack_texts(table(spark, []), BYTE).collect() == []
