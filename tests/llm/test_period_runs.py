from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from runscope.llm import period_runs as p
from runscope.llm.common import words_of
from runscope.llm.queries import QUERIES

from .helpers import awkward, table, words

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=24, times=3):
    """(start, length, smallest period), every period tried along the whole text."""
    found: dict = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(w, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def random_words(r, n):
    kinds = r.choice([1, 2, 3, 5, 50])
    w = [r.randrange(kinds) for _ in range(n)]
    for _ in range(r.randrange(4) if n else 0):
        a, q = r.randrange(n), 1 + r.randrange(max(1, n // 4))
        for i in range(a + q, min(n, a + q * r.randrange(1, 8) + r.randrange(5))):
            w[i] = w[i - q]
    if r.random() < 0.1:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n]
    return w


@pytest.mark.parametrize("limits", [(24, 3), (6, 3), (9, 3), (12, 4)])
def test_runs_against_brute_force(limits):
    r = random.Random(limits[0])
    for _ in range(250):
        texts = [random_words(r, r.randrange(300)) for _ in range(r.choice([1, 1, 3]))]
        flat = np.array([x for w in texts for x in w], np.int64)
        start, end, period = p.find(flat, np.repeat(np.arange(len(texts)), [len(w) for w in texts]), p.Limits(*limits))
        wanted, at = [], 0
        for w in texts:
            wanted += [(s + at, n, q) for s, n, q in brute_runs(w, *limits)]
            at += len(w)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == wanted


def test_grammar_gives_the_text_again():
    """Every place of a symbol holds the same words, and symbols touch no border between parts."""
    r = np.random.default_rng(3)
    text, part = np.tile(r.integers(0, 30, 200), 6), np.repeat([0, 1, 2], 400)
    *made, (at, parts) = p.rules(text, part, 2)
    assert len(at) < 150 and (np.diff(at) > 0).all() and (parts == part[at]).all()
    for places, left, size in made:
        assert 0 < left < size and len(places) > 1
        assert all((text[i : i + size] == text[places[0] : places[0] + size]).all() for i in places)
        assert all(part[i] == part[i + size - 1] for i in places)


@pytest.mark.parametrize("make", [lambda: np.zeros(300_000, np.int64), lambda: np.tile(np.arange(5000), 60)])
def test_long_texts_end_soon(make):
    text = make()
    start, end, period = p.find(text, np.zeros(len(text), np.int64))
    assert (start.tolist(), end.tolist()) == ([0], [len(text)]) and period[0] == (1 if text[1] == 0 else 5000)


def test_find_runs(spark):
    say = "please read this notice with care and sign it today " * 4  # ten words, four times
    texts = ["before the notice " + say + "and after it", "x " * 23, "x " * 24, " \n\t", "", None, " ".join(words(500, 4, 40))]
    rows = {r.doc_id: r for r in p.find_runs(table(spark, texts)).collect()}
    assert [tuple(x) for x in rows[0].runs] == [(3, 40, 10)]
    assert rows[0].collapsed_text == "before the notice please read this notice with care and sign it today and after it"
    assert rows[1].runs == [] and rows[1].n_words == 23
    assert [tuple(x) for x in rows[2].runs] == [(0, 24, 1)] and rows[2].collapsed_text == "x"
    assert all(rows[i].runs == [] and rows[i].collapsed_text == "" and rows[i].n_words == 0 for i in (3, 4, 5))
    assert rows[6].collapsed_text == texts[6]


def test_awkward_rows(spark):
    df = awkward(spark, ("runs", "n_words", "_text"))
    found = p.find_runs(df, keep=("doc_id", "runs", "_text", "lang"))
    assert found.columns == ["doc_id", "_text", "lang", "n_words", "runs", "collapsed_text"]
    rows = sorted(found.collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    wanted = sorted(((r.doc_id or 0, words_of(r.text or "")) for r in df.collect()), key=lambda x: (x[0], len(x[1])))
    for r, (i, w) in zip(rows, wanted, strict=True):
        assert (r.doc_id or 0, r.n_words) == (i, len(w)) and r._text == "clash"
        if len(w) < 1000:
            assert r.collapsed_text == brute_collapsed(w, brute_runs(w))
    # 997 words that are followed by the same three, twenty times over
    assert [tuple(x) for x in next(r for r in rows if r.doc_id == 5).runs] == [(0, 80_000, 4 * 997)]
    assert p.find_runs(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    found = {r.doc_id: r for r in QUERIES["op12_period_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc in docs:
        w = words_of(doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            w = [*w[:a], *(w[a + (i - a) % q] for i in range(a, n))]
        runs = brute_runs(w)
        r = found[doc.doc_id]
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2]) and r.n_runs == len(runs) and r.n_words == n
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in found.values()) > 10
