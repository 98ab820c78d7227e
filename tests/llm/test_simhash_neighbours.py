from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runscope.llm import golay_simhash as g
from runscope.llm import posting_lists as p
from runscope.llm.queries import QUERIES

from .helpers import awkward, table, words

SF = "/root/testdata/sf0.001"


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 4]), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """Smallest id reachable, for (id, fingerprint) rows; null ids are passed over."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(prints)):
        out.setdefault(find(i), []).append(prints[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in out.items()}
    return [least[find(i)] for i in range(len(prints))]


def test_golay_code_is_perfect():
    words_ = np.arange(1 << 23, dtype=np.int64)[:: 97]
    table_, _ = g._errors()
    code = words_.astype(np.int32) ^ table_[g._remainders(words_)]
    assert (g._remainders(code) == 0).all() and np.bitwise_count(code ^ words_.astype(np.int32)).max() == 3


@pytest.mark.parametrize("bits", range(6))
def test_near_fingerprints_share_a_key(bits):
    r = np.random.default_rng(bits)
    a = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in r.choice(64, bits, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    shared = {i for i, _ in set(zip(*map(np.ndarray.tolist, g.fuzzy_keys(a)))) & set(zip(*map(np.ndarray.tolist, g.fuzzy_keys(b))))}
    assert len(shared) == len(a)


def test_fingerprints_against_brute_force():
    r = random.Random(2)
    texts = ["", " \n", "One", "a b c", "A b C d", "a b c d e", "É É é é x", "tab\tand\x0bvt\xa0nbsp one two", None]
    texts += [" ".join(words(r.randrange(1, 60), i, 30)) for i in range(50)]
    assert [g.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_classes_against_brute_force(spark):
    r = random.Random(9)
    centre = [r.getrandbits(64) for _ in range(6)]
    rows = [(i, r.getrandbits(64)) for i in range(150)]
    for i in range(150, 500):  # chains and clouds of near fingerprints, copies among them
        x = r.choice(centre + [x for _, x in rows[-20:]])
        for b in r.sample(range(64), r.randrange(0, 6)):
            x ^= 1 << b
        rows.append((i if i % 50 else None, x))
    rows += [(5, centre[0]), (5, centre[0])]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    r.shuffle(signed)
    df = spark.createDataFrame(signed, "doc_id bigint, fingerprint bigint").repartition(3)
    got = {x["fingerprint"] & (2**64 - 1): x["component_id"] for x in g.classes(df, 4, g.shared_folder(spark)).collect()}
    rows = [(i, x & (2**64 - 1)) for i, x in signed]
    assert [got[x] for _, x in rows] == brute_components(rows)


def test_large_buckets_link_like_small_ones():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 5, dtype=np.uint64)
    values = base[r.integers(0, 5, 400)].copy()
    for i in range(400):
        for bit in r.choice(64, 3):
            values[i] ^= np.uint64(1) << np.uint64(bit)
    values = np.unique(values)
    i, j = g._links(values, np.array([0]), np.array([len(values)]), 4)
    root = g._roots(len(values), i, j)
    rows = [(k, int(v)) for k, v in enumerate(values)]
    assert root.tolist() == brute_components(rows)
    assert len(i) < len(values)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_print(r["text"])) for r in docs]
    expected = {i: (format(x, "016x"), c) for (i, x), c in zip(prints, brute_components(prints))}
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op5_golay_simhash"](spark, SF).collect()}
    assert got == expected


def test_near_duplicates_on_awkward_rows(spark):
    df = awkward(spark, clash=["fingerprint", "component_id", "root"])
    rows = g.near_duplicates(df).collect()
    assert len(rows) == 9
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[2]["fingerprint"] == "0" * 16 and by[None]["component_id"] is None
    assert g.near_duplicates(table(spark, [])).collect() == []


def test_one_of_each(spark):
    text = " ".join(words(300, 1))
    near = text.replace("w1", "w2", 1)
    df = table(spark, [text, near, text, " ".join(words(300, 2))], first=3).unionByName(table(spark, [text], first=3))
    no_id = table(spark, [" ".join(words(300, 3))] * 2 + [text]).withColumn("doc_id", F.lit(None).cast("bigint"))
    kept = g.one_of_each(df.unionByName(no_id).withColumn("root", F.lit("extra")))
    assert kept.columns == [*df.columns, "root"]
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in kept.collect()) == sorted(
        [(3, len(text)), (6, len(" ".join(words(300, 2)))), (0, len(" ".join(words(300, 3))))]
    )
    assert g.one_of_each(table(spark, [])).collect() == []


# ---- neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_neighbours(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = near[:k]
    return out


def recall(got, expected):
    hits = sum(len({i for _, i in e} & {r["vec_id"] for r in got if r["query_id"] == q}) for q, e in expected.items())
    return hits / sum(map(len, expected.values()))


def test_graph_search_finds_what_is_within_the_ratio():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    index = p.fit_index(x, 100)
    assert np.bincount(p._squared(x, index.centroids).argmin(axis=1), minlength=100).max() < 150
    q, c, d = p.search_graph(index, x[:200], 1.2)
    every = np.sqrt(p._squared(x[:200], index.centroids))
    wanted = every <= every.min(axis=1, keepdims=True) * 1.2
    assert wanted[q, c].mean() > 0.99 and len(q) > 0.97 * wanted.sum()


def test_query_recall(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    expected = brute_neighbours(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    got = QUERIES["op3_posting_lists"](spark, SF).collect()
    assert recall(got, expected) >= 0.9 and len(got) == sum(map(len, expected.values()))


def test_clustered_vectors_and_blocks(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 12)) * 4
    x = (centres[r.integers(0, 20, 2500)] + r.normal(size=(2500, 12))).astype(np.float32)
    x[500:1400] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    fit = p.Fit(target=64, block=100)
    got = p.nearest_neighbours(df, F.col("vec_id") % 100 == 0, fit=fit).collect()
    expected = brute_neighbours(rows, set(range(0, 2500, 100)), 10)
    assert recall(got, expected) >= 0.9
    by = {}
    for r_ in sorted(got, key=lambda r_: r_["rank"]):
        by.setdefault(r_["query_id"], []).append((r_["score"], r_["vec_id"]))
    assert by[600] == expected[600] and by[0] == expected[0]
    assert all(abs(s - e) < 1e-12 for q in by for (s, i), (e, j) in zip(by[q], expected[q]) if i == j)


def test_neighbours_on_awkward_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, None, 1), (200, [0.0, 0.0], 1), (300, [1.0, None], 1),
        (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (600, [1.0, 2.0, 3.0], 1),
        (7, [1.0, 0.0], None), (8, [2.0, 0.0], 1), (9, [0.0, 1.0], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumn("list", F.lit("clash")).withColumn("score", F.lit(1))
    got = p.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 9)]
    assert got[0]["score"] == 0 and got[1]["score"] == 1
    assert p.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
