"""Periodic runs of words, found on a grammar of the text.

The word ids are compressed by Re-Pair: the most frequent pairs of neighbours become symbols, until no pair comes twice.
A run of the text lies across the boundary of exactly one lowest symbol (or of a node of the tree over what is left), so
runs are computed once for each symbol, across its boundary, and carried over to all places that the symbol stands for.
Pieces of one run are then merged into the whole.

Spark deals the documents; a task works on a few megabytes of text at a time, or on one long text, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACES = r"[\x20\x09-\x0D]+"
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Limits:
    """A run has at least ``words`` words and ``times`` periods (3 or more)."""

    words: int = 24
    times: int = 3

    @property
    def gram(self) -> int:
        """Any so many words in a row of a run are found again in it: shifted by a period one way or the other."""
        return self.words - 2 * (self.words // self.times) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(words: np.ndarray, text: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all parts that may hold a run.

    Each ``gram`` words of a run occur again in their text, so a run lies inside one row of neighbouring grams that do.
    Grams are told apart by a 64-bit hash; two grams with one hash would add a part without a run, and lose nothing.
    """
    g = limits.gram
    n = len(words) - g + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    value, hashes = _mixed(words), np.zeros(n, np.uint64)
    for j in range(g):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + value[j : j + n]
    hashes = _mixed(hashes ^ _mixed(text[:n] + 1))
    order = np.argsort(hashes)
    equal = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(n + 2, bool)  # a border on both sides
    again[1 + order[1:][equal]] = True
    again[1 + order[:-1][equal]] = True
    again[1:-1] &= text[:n] == text[g - 1 :]
    # a row of such grams ends where the text does
    first = np.flatnonzero(again[1:-1] & ~(again[:-2] & (np.r_[-1, text[: n - 1]] == text[:n])))
    last = np.flatnonzero(again[1:-1] & ~(again[2:] & (np.r_[text[1:n], -1] == text[:n])))
    long = last - first + g >= limits.words
    return first[long], last[long] + g


def rules(words: np.ndarray, part: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, int] | tuple[np.ndarray, np.ndarray]]:
    """Re-Pair in rounds. Yields (places, words on the left, words) of each symbol of ``least`` words or more, and at the
    end the places and parts of the symbols that remain.

    In a round every pair is replaced wherever no pair that overlaps it is more frequent (a hash decides among equals):
    what replacing one pair after the other would do, but for pairs that do not touch. The most frequent pair always
    goes, so the rounds end. In a row of equal symbols, pairs begin at every other one. No pair crosses two parts.
    """
    symbol, at, size = words.astype(np.int64), np.arange(len(words)), np.ones(len(words), np.int64)
    new = int(symbol.max(initial=0)) + 1
    while len(symbol) > 1:
        joined = part[at[:-1]] == part[at[1:]]
        same = joined & (symbol[:-1] == symbol[1:])
        number = np.arange(len(same))
        begins = np.maximum.accumulate(np.where(same & ~np.r_[False, same[:-1]], number, 0))
        pairs = np.flatnonzero(joined & ~(same & ((number - begins) % 2 == 1)))
        values, which, count = np.unique(symbol[pairs] * new + symbol[pairs + 1], return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((_mixed(values), -count))] = np.arange(len(values))
        priority = np.full(len(symbol) + 1, _FAR)
        priority[pairs + 1] = np.where(count[which] > 1, rank[which], _FAR)
        own = priority[pairs + 1]
        chosen = (own < priority[pairs]) & (own < priority[pairs + 2])
        times = np.bincount(which[chosen], minlength=len(values))
        chosen &= times[which] > 1
        if not chosen.any():
            break
        place, kind = pairs[chosen], (np.cumsum(times > 1) - 1)[which[chosen]]
        left = size[place]
        symbol[place] = new + kind
        size[place] += size[place + 1]
        new += int(kind.max()) + 1
        order = np.argsort(kind, kind="stable")
        order = order[size[place][order] >= least]
        cuts = np.flatnonzero(np.diff(kind[order])) + 1
        for group in np.split(order, cuts) if len(order) else ():
            yield at[place[group]], int(left[group[0]]), int(size[place[group[0]]])
        rest = np.ones(len(symbol), bool)
        rest[place + 1] = False
        symbol, at, size = symbol[rest], at[rest], size[rest]
    yield at, part[at]


def _agree(t: np.ndarray, i: int, j: int, step: int) -> int:
    """How far t[i], t[i + step], ... and t[j], t[j + step], ... are the same."""
    reach = len(t) - max(i, j) if step > 0 else min(i, j) + 1
    done, width = 0, 32
    while done < reach:
        width = min(width, reach - done)
        if step > 0:
            other = t[i + done : i + done + width] != t[j + done : j + done + width]
        else:
            other = (t[i - done - width + 1 : i - done + 1] != t[j - done - width + 1 : j - done + 1])[::-1]
        if other.any():
            return done + int(other.argmax())
        done += width
        width *= 8
    return done


def crossing(t: np.ndarray, u: int, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the runs of ``t`` that hold both t[u - 1] and t[u].

    The two words come again a period further to the left or to the right, so the distances to their other places are the
    only periods to try. The shortest come first; distances inside a run found are multiples of its period.
    """
    n = len(t)
    places = np.flatnonzero((t[:-1] == t[u - 1]) & (t[1:] == t[u])) - (u - 1)
    places = places[(places != 0) & (np.abs(places) <= n // limits.times)]
    if len(places) > 4:
        # the rest of the run agrees with itself a period away, for at least so many words on one of the two sides
        half = -(-(limits.words - limits.words // limits.times) // 2)
        steps = np.arange(half)
        sides = []
        for i in (u - 1 - steps, u + steps):
            j = i[None, :] + places[:, None]
            inside = (i >= 0) & (i < n) & (j >= 0) & (j < n)
            sides.append((inside & (t[np.clip(i, 0, n - 1)] == t[np.clip(j, 0, n - 1)])).all(axis=1))
        places = places[sides[0] | sides[1]]
    places = places[np.argsort(np.abs(places), kind="stable")]
    found: dict[tuple[int, int], int] = {}
    while len(places):
        d, places = int(places[0]), places[1:]
        q = abs(d)
        start = u - _agree(t, u - 1, u - 1 + d, -1) + min(d, 0)
        end = u + _agree(t, u, u + d, 1) + max(d, 0)
        if end - start >= max(limits.words, limits.times * q) and (start, end) not in found:
            found[start, end] = q
            inside = (places % q == 0) & (u - 1 + places >= start) & (u + places < end)
            places = places[~inside]
    return [(s, e, q) for (s, e), q in found.items()]


def _over(at: np.ndarray, end: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, boundary, end) of the nodes of a balanced tree over symbols that begin at ``at``."""
    todo = [(0, len(at), end)]
    while todo:
        a, b, stop = todo.pop()
        if b - a < 2 or stop - at[a] < least:
            continue
        middle = int(np.searchsorted(at[a + 1 : b - 1], (at[a] + stop) // 2)) + a + 1
        yield int(at[a]), int(at[middle]), stop
        todo += [(a, middle, int(at[middle])), (middle, b, stop)]


def find(words: np.ndarray, text: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, by start, then period; ``text`` tells texts apart, which lie in order.

    Places count words over all texts.
    """
    starts, ends = stretches(words, text, limits)
    sizes = ends - starts
    part = np.repeat(np.arange(len(sizes)), sizes)
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    own = words[np.arange(len(part)) + shift] if len(part) else words[:0]
    pieces: list[np.ndarray] = []

    def add(runs: list[tuple[int, int, int]], places: np.ndarray) -> None:
        for s, e, q in runs:
            pieces.append(np.stack([places + s, places + e, np.full(len(places), q), part[places]], axis=1))

    for rule in rules(own, part, limits.words) if len(own) else ():
        if len(rule) == 3:
            places, left, size = rule
            add(crossing(own[places[0] : places[0] + size], left, limits), places)
        else:
            at, parts = rule
            for group in np.split(at, np.flatnonzero(np.diff(parts)) + 1):
                stop = int(group[0]) + int(sizes[part[group[0]]])
                for start, boundary, end in _over(group, stop, limits.words):
                    add(crossing(own[start:end], boundary - start, limits), np.array([start]))
    if not pieces:
        none = np.empty(0, np.int64)
        return none, none, none
    start, end, period, _ = np.concatenate(pieces).T
    # pieces of one run overlap by a period or more; those of one period are merged
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    band = np.r_[0, np.cumsum(np.diff(period) != 0)] * (2 * len(own) + 1)
    reach = np.maximum.accumulate(end + band)
    fresh = np.r_[True, (start + band + period)[1:] > reach[:-1]]
    where = np.flatnonzero(fresh)
    stop = np.r_[reach[where[1:] - 1], reach[-1]] - band[where]
    start, period = start[where] + shift[start[where]], period[where]
    stop = stop - 1 + shift[stop - 1] + 1
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def find_runs(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limits: Limits = Limits(),
    with_text: bool = True,
) -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` (start, length, smallest period; by start, then period) and (``with_text``)
    ``collapsed_text``.

    Words are separated by the six white-space characters and numbered from 0. A run is a stretch of ``limits.words``
    words and ``limits.times`` periods or more that no neighbouring word extends. The collapsed text has the words that no
    run holds after its first period, joined by one space. A null text has no words, like an empty one: no runs and an
    empty collapsed text. Whole texts are read, rows independently of each other: repeated rows give repeated results, an
    empty table an empty one. Kept columns named like a result give way to it.
    """

    def setup():
        def work(texts: list) -> list:
            column = pa.array([t or "" for t in texts], pa.string())
            parts = pc.split_pattern_regex(column, SPACES)
            flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
            filled = pc.not_equal(flat, "")
            flat, parent = flat.filter(filled), parent[filled.to_numpy(zero_copy_only=False)]
            codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            counts = np.bincount(parent, minlength=len(texts))
            first = np.cumsum(counts) - counts
            start, end, period = find(codes, parent.astype(np.int64), limits)
            runs: list[list] = [[] for _ in texts]
            for s, e, q, d in zip(start.tolist(), end.tolist(), period.tolist(), parent[start].tolist()):
                runs[d].append({"start": s - int(first[d]), "length": e - s, "period": q})
            columns = [counts, runs]
            if with_text:
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                stays = np.cumsum(change)[:-1] == 0
                kept = np.bincount(parent[stays], minlength=len(texts))
                offsets = pa.array(np.r_[0, np.cumsum(kept)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, flat.filter(pa.array(stays)))
                columns.append(pc.binary_join(lists, " "))
            return columns

        return work

    added = f"n_words bigint, runs {RUN}" + ", collapsed_text string" * with_text
    return map_texts(docs, text, keep, added, setup)


def best_run(runs: str):
    """The run of the greatest exponent (length over period, compared exactly), the first of several; null if none."""
    better = "r.length * b.period > b.length * r.period"
    return F.expr(f"aggregate(slice({runs}, 2, greatest(size({runs}) - 1, 0)), get({runs}, 0), (b, r) -> IF({better}, r, b))")
