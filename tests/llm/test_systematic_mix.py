from __future__ import annotations

import hashlib
from collections import Counter
from fractions import Fraction

import pytest

from runscope.llm import systematic_mix as s
from runscope.llm.common import words_of

from .helpers import DOCS, awkward, words


def brute_targets(sizes, weights, most):
    """Shares given out again and again, in fractions, until none is above its limit."""
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full: dict = {}
    while True:
        rest = [n for n in names if n not in full]
        left = sum(sizes.values()) - sum(full.values())
        fair = {n: Fraction(left * weight[n], sum(weight[m] for m in rest)) for n in rest}
        above = [n for n in rest if fair[n] > most * sizes[n]]
        if not above:
            return {**full, **fair}
        full.update({n: most * sizes[n] for n in above})


def brute_mix(rows, weights=(5, 2, 1), most=3, seed=11):
    """(doc_id, size, copies) of (doc_id, text, source) rows, one document after the other."""
    held = [(i, t, n, len(words_of(t or ""))) for i, t, n in rows]
    sizes: dict = {}
    for *_, name, size in held:
        sizes[name] = sizes.get(name, 0) + size
    targets = brute_targets(sizes, weights, most)

    def digest(*parts):
        return hashlib.md5(":".join(str(p) for p in parts if p is not None).encode()).hexdigest()

    def place(row):
        bits = row[3].bit_length() or 1
        return 8 * bits + (row[3] >> max(bits - 4, 0) & 7), digest(row[0], row[1])

    out = []
    for name, size in sizes.items():
        each = int(float(targets[name]) * s.UNIT / size) if size else 0
        at = int(digest(seed, name)[:6], 16)
        for row in sorted((r for r in held if r[2] == name), key=place):
            out.append((row[0], row[3], (at + each) // s.UNIT - at // s.UNIT))
            at += each
    return out, targets, sizes


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", n, 0) for i, t, n in rows], DOCS)


def several():
    rows = []
    for i in range(600):
        name = (None, "", "a", "b", "é", "z", "\U0001f600")[min(i % 11, 6)]
        rows.append((i, " ".join(words(1 + i * 7 % 90, i)), name))
    rows += [(1000 + i, "few words here", "tiny") for i in range(3)] + [(2000, None, "empty"), (2001, " \n ", "empty")]
    return rows


@pytest.mark.parametrize("group", [7, 20_000])
def test_mix_against_brute_force(spark, group):
    rows = several()
    found = s.systematic_mix(documents(spark, rows), group=group).collect()
    wanted, targets, sizes = brute_mix(rows)
    assert Counter((r.doc_id, r["size"], r.copies) for r in found) == Counter(wanted)
    name_of = {i: n for i, _, n in rows}
    for r in found:
        name = name_of[r.doc_id]
        assert r.source_size == sizes[name] and r.target == float(targets[name]) and r.taken == r.copies * r["size"]


def test_words_taken_come_near_the_target(spark):
    rows = several()
    _, targets, sizes = brute_mix(rows)
    assert any(t == 3 * sizes[n] for n, t in targets.items() if sizes[n])  # a source that reaches its limit
    name_of = {i: n for i, _, n in rows}
    taken, largest = Counter(), Counter()
    for r in s.systematic_mix(documents(spark, rows)).collect():
        assert r.taken <= 3 * r["size"]
        taken[name_of[r.doc_id]] += r.taken
        largest[name_of[r.doc_id]] = max(largest[name_of[r.doc_id]], r["size"])
    assert all(abs(taken[n] - t) <= largest[n] for n, t in targets.items())


def test_many_rows_alike_are_dealt_over_groups(spark):
    rows = [(7, "the same words", "a")] * 500 + [(None, "no id at all", "a")] * 300 + several()
    mixed = [s.systematic_mix(documents(spark, rows), group=group) for group in (20, 20_000)]
    few, many = (Counter((r.doc_id, r["size"]) for r in m.collect() for _ in range(r.copies)) for m in mixed)
    wanted, targets, _ = brute_mix(rows)
    whole = Counter((i, n) for i, n, c in wanted for _ in range(c))
    assert many == whole
    # which of the rows alike are taken may differ between sizes of groups, the number taken by at most one a group
    assert abs(few[7, 3] - whole[7, 3]) <= 26 and abs(few.total() - whole.total()) <= len(targets)
    assert mixed[0].count() == len(rows)


def test_reruns_and_dealing_agree(spark):
    df = documents(spark, several())
    first = s.systematic_mix(df.repartition(1)).collect()
    second = s.systematic_mix(df.repartition(5, "text")).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, second))


def test_emitted_copies(spark):
    mixed = s.systematic_mix(documents(spark, several()), keep=("doc_id", "text"))
    rows = s.emitted(mixed).collect()
    wanted, _, _ = brute_mix(several())
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, c in wanted for _ in range(c))
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows) and all(r.text for r in rows if r["size"])


def test_awkward_rows(spark):
    df = awkward(spark, ("size", "target", "key", "source_size", "n", "about"))
    found = s.systematic_mix(df, keep=("doc_id", "size", "key", "n", "about", "source"))
    assert found.columns == ["doc_id", "key", "n", "about", "source", "size", "source_size", "target", "copies", "taken"]
    assert found.count() == df.count()
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    assert Counter((r.doc_id, r["size"], r.copies) for r in found.collect()) == Counter(brute_mix(rows)[0])


def test_empty_tables(spark):
    df = documents(spark, [])
    assert s.systematic_mix(df).count() == 0
    only_empty = s.systematic_mix(documents(spark, [(1, None, None), (2, "", "a")]))
    assert {(r.doc_id, r["size"], r.target, r.copies) for r in only_empty.collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_no_python_on_the_rows(spark):
    plan = s.systematic_mix(documents(spark, several()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
