from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runscope.llm import zone_negatives as z
from runscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS = "vec_id bigint, embedding array<float>, label int"
SMALL = z.Layout(block=32, folder=128, anchors=4, cell=8)


def brute(rows, asked, scale=256, positives=5, negatives=10, low=30, high=90):
    """All scores of every anchor, in Python integers."""
    held = {}
    for i, vector, label in rows:
        if i is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            x = [math.floor(scale * float(np.float32(c))) for c in vector]
            held[i] = min(held.get(i, (label, x)), (label, x))
    out = []
    for a in filter(asked, held):
        label, x = held[a]
        scores = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in held.items() if i != a}
        ranked = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in ranked if held[i][0] == label][:positives]:
            fits = [i for i in ranked if held[i][0] != label and low * scores[p] <= 100 * scores[i] <= high * scores[p]]
            out += [(a, p, no, i, scores[p], scores[i]) for no, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every=10, layout=SMALL, **options):
    df = spark.createDataFrame(rows, ROWS)
    return z.hard_negatives(df, F.col("vec_id") % every == 0, layout=layout, **options)


def clustered(n, seed=1, clusters=12, width=8, noise=0.02):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, width))
    which = r.integers(0, clusters, n)
    x = centres[which] + noise * r.normal(size=(n, width))
    return [(i, [float(c) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, r.integers(0, 3, n)))]


@pytest.mark.parametrize("dimensions,bits", [(1, 4), (2, 4), (3, 2), (4, 2), (5, 1)])
def test_curve_goes_from_neighbour_to_neighbour(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = z.hilbert_keys(cells, bits)
    order = sorted(range(len(keys)), key=keys.__getitem__)
    assert len(set(keys)) == len(keys) and (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_tight():
    r = np.random.default_rng(2)
    a, low = r.integers(-50, 50, (20, 6)), r.integers(-50, 50, (30, 6))
    high = low + r.integers(0, 9, low.shape)
    least, most = z.bounds(a, low, high)
    for i, j in itertools.product(range(20), range(30)):
        corners = [sum(x * y for x, y in zip(a[i], c)) for c in itertools.product(*zip(low[j], high[j]))]
        assert (least[i, j], most[i, j]) == (min(corners), max(corners))


def test_products_of_large_numbers_are_exact():
    r = np.random.default_rng(3)
    a, b = (r.integers(-z.LARGEST, z.LARGEST, (3, 4000)) for _ in range(2))
    wanted = [[sum(x * y for x, y in zip(p.tolist(), q.tolist())) for q in b] for p in a]
    assert z.products(a, b).tolist() == wanted


@pytest.mark.parametrize("noise", [0.02, 3.0])
def test_against_brute_force(spark, noise):
    rows = clustered(600, noise=noise)
    assert sorted(map(tuple, found(spark, rows).collect())) == brute(rows, lambda i: i % 10 == 0)


def test_blocks_left_out(spark, tmp_path):
    """Clustered vectors: most blocks are not read for an anchor, and the result is whole."""
    rows = clustered(4000, clusters=40)
    layout = z.Layout(block=32, folder=512, seeds=2)
    result = found(spark, rows, 200, layout, folder=f"file://{tmp_path}/t")
    assert sorted(map(tuple, result.collect())) == brute(rows, lambda i: i % 200 == 0)
    blocks = spark.read.parquet(f"file://{tmp_path}/t/blocks").count()
    assert blocks >= 4000 // 32
    for name in ("positives", "negatives"):
        read = sum(spark.read.parquet(f"file://{tmp_path}/t/{name}-{part}").count() for part in ("seeds", "rest"))
        assert 20 * layout.seeds <= read < 0.35 * 20 * blocks


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in r.normal(size=4)], i % 3) for i in range(40)]
    rows += [(None, [1.0] * 4, 1), (50, None, 1), (60, [1.0, None, 1.0, 1.0], 1), (70, [nan, 1.0, 1.0, 1.0], 1)]
    rows += [(80, [1.0, inf, 1.0, 1.0], 1), (90, [1.0] * 4, None), (100, [0.0] * 4, 1), (110, [], 2), (120, [1.0, 2.0], 0)]
    rows += [(130, [1.0, -1.0, 0.5, 0.25, 3.0], 2), *[rows[3]] * 4, (140, [2.0] * 4, 1), (140, [1.0] * 4, 1)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5], i % 4) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS score", "2 AS key", "3 AS block", "'x' AS asked", "5 AS rank")
    result = z.hard_negatives(df, F.col("vec_id") % 10 == 0, layout=SMALL)
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, result.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_a_vector_that_fills_the_table(spark):
    rows = [(i, [0.5, -0.25, 1.0], 0 if i % 3 else i % 5) for i in range(500)]
    assert sorted(map(tuple, found(spark, rows, 50, low=0, high=100).collect())) == brute(rows, lambda i: i % 50 == 0, low=0, high=100)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1)], [(10, [1.0], 1), (11, [2.0], 1)]])
def test_too_few_rows(spark, rows):
    assert found(spark, rows).collect() == []


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (k + 1) % 10 if k is not None and i % 7 == 0 else k) for i, v, k in rows]
    result = sorted(map(tuple, QUERIES["op13_zone_negatives"](spark, SF).collect()))
    assert result == brute(moved, lambda i: i % 100 == 0) and len(result) > 100
