"""Quality of texts by a factorisation machine.

A text is a sparse vector of hashed words, structure statistics and metadata. Every feature has a weight and a short
vector of factors; every pair of features interacts by the product of their factors. The pairs are never listed: half
of (squared sum minus sum of squares) of the factors times values gives all of them in linear time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, words_of

#: Structure statistics, in order.
STATISTICS = (
    "log_words",
    "log_chars",
    "word_length",
    "distinct_words",
    "top_word",
    "repeated_lines",
    "words_a_line",
    "upper",
    "digits",
    "sentence_ends",
    "other_ascii_symbols",
    "not_ascii",
    "words_without_letters",
)


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample and of the training: at most ``texts`` labelled texts are brought to the driver, as
    vectors of at most ``buckets`` entries."""

    texts: int = 4000
    buckets: int = 1 << 14
    factors: int = 8
    passes: int = 12
    rate: float = 0.05
    ridge: float = 1e-4
    seed: int = 11


@dataclass
class Model:
    """Bias, weights and factors; the features are the hash buckets, then the numbers, scaled to mean 0 and spread 1."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


_CLASS = np.zeros(256, np.int64)  # 0: lower case, white space and all else
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[ord(c) for c in ".!?"]] = 3
_CLASS[[ord(c) for c in "\"#$%&()*+,-/:;<=>@[\\]^_`{|}~'"]] = 4
_CLASS[0x80:] = 5


def bucket_of(word: str, buckets: int) -> int:
    return zlib.crc32(word.lower().encode()) % buckets


def statistics(text: str, words: Sequence[str], ids: np.ndarray) -> list[float]:
    """Numbers on the make-up of a text; all are defined for an empty one."""
    data = text.encode()
    n, size = max(1, len(words)), max(1, len(data))
    kinds = np.zeros(6)
    for at in range(0, len(data), 1 << 20):
        kinds += np.bincount(_CLASS[np.frombuffer(data[at : at + (1 << 20)], np.uint8)], minlength=6)
    lines = [line for line in text.split("\n") if line.strip()]
    counts = np.bincount(ids) if len(ids) else np.zeros(1)
    counts = counts[counts > 0]
    in_words = sum(map(len, words))
    bare = sum(not any(map(str.isalpha, w)) for w in words)
    return [
        float(np.log1p(len(words))),
        float(np.log1p(len(text))),
        in_words / n,
        len(counts) / n,
        float(counts.max(initial=0)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(len(words) / max(1, len(lines)))),
        kinds[1] / size,
        kinds[2] / size,
        kinds[3] / n,
        kinds[4] / size,
        kinds[5] / size,
        bare / n,
    ]


@dataclass(frozen=True)
class Metadata:
    """Columns beside the text: True for those that are numbers, False for categories."""

    numeric: tuple[bool, ...] = ()

    @staticmethod
    def of(docs: DataFrame, columns: Sequence[str]) -> Metadata:
        return Metadata(tuple(isinstance(docs.schema[c].dataType, T.NumericType) for c in columns))

    @property
    def numbers(self) -> int:
        return sum(self.numeric)

    def split(self, carried: str | None) -> tuple[str, list[str], list[float]]:
        """Text, categories and numbers of what ``carried`` made."""
        if not self.numeric:
            return carried or "", [], []
        head, _, text = carried.partition("\0")
        values = json.loads(head)
        found = [values.get(f"m{i}") for i in range(len(self.numeric))]
        categories = [f"\0{i}={v}" for i, (v, n) in enumerate(zip(found, self.numeric)) if not n and v is not None]
        numbers = [v if isinstance(v, int | float) else 0.0 for v, n in zip(found, self.numeric) if n]
        return text, categories, [float(np.sign(x) * np.log1p(abs(x))) for x in numbers]


def carried(docs: DataFrame, text: str, metadata: Sequence[str]) -> Column:
    """The text, after its metadata as JSON if there is any (which holds no zero character, so the first one ends it)."""
    whole = F.col(f"`{text}`").cast("string")
    if not metadata:
        return whole
    numeric = Metadata.of(docs, metadata).numeric
    kinds = ["double" if n else "string" for n in numeric]
    values = [F.col(f"`{c}`").cast(k).alias(f"m{i}") for i, (c, k) in enumerate(zip(metadata, kinds))]
    return F.concat(F.to_json(F.struct(*values)), F.lit("\0"), F.coalesce(whole, F.lit("")))


class Vectors:
    """Turns texts into (text, bucket, value) entries and rows of statistics; word buckets are remembered."""

    def __init__(self, buckets: int, metadata: Metadata = Metadata()):
        self.buckets, self.metadata = buckets, metadata
        self._known: dict[str, int] = {}

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        known = self._known
        if len(known) > 300_000:
            known.clear()
        every, sizes, numbers = [], [], []
        for given in texts:
            text, categories, more = self.metadata.split(given)
            words = words_of(text)
            for w in words:
                if w not in known:
                    known[w] = bucket_of(w, self.buckets)
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            entries = np.r_[ids, [bucket_of(c, self.buckets) for c in categories]].astype(np.int64) if categories else ids
            every.append(entries)
            sizes.append(len(entries))
            numbers.append([*statistics(text, words, ids), *more])
        owner = np.repeat(np.arange(len(texts)), sizes)
        key, count = np.unique(owner * self.buckets + np.concatenate(every), return_counts=True)
        owner, bucket = np.divmod(key, self.buckets)
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(owner, value**2, len(texts)))
        return owner, bucket, value / norm[owner], np.array(numbers, float).reshape(len(texts), len(STATISTICS) + self.metadata.numbers)


def interactions(owner: np.ndarray, values: np.ndarray, factors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the interactions of all pairs of entries for each of ``n`` vectors, and the sums by factor."""
    scaled = factors * values[:, None]
    total = np.stack([np.bincount(owner, scaled[:, f], n) for f in range(scaled.shape[1])], axis=1)
    squares = np.bincount(owner, (scaled**2).sum(axis=1), n)
    return 0.5 * ((total**2).sum(axis=1) - squares), total


def raw_scores(model: Model, owner, bucket, value, numbers) -> np.ndarray:
    """Scores before the logistic function."""
    n, wide = numbers.shape
    dense = np.clip((numbers - model.mean) / model.spread, -5, 5) / np.sqrt(wide)
    owner = np.r_[owner, np.repeat(np.arange(n), wide)]
    feature = np.r_[bucket, np.tile(np.arange(len(model.weights) - wide, len(model.weights)), n)]
    value = np.r_[value, dense.ravel()]
    linear = np.bincount(owner, model.weights[feature] * value, n)
    pairs, _ = interactions(owner, value, model.factors[feature], n)
    return model.bias + linear + pairs


def train(
    vectors: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: Sequence[int], fit: Fit = Fit(), more: int = 0
) -> Model:
    """Stochastic gradient steps (AdaGrad) on the logistic loss. ``vectors``: (buckets, values, numbers) of each text;
    ``more``: how many columns of metadata are numbers (told by the vectors, unless there are none)."""
    vectors = list(vectors)
    rng = np.random.default_rng(fit.seed)
    numbers = np.array([v[2] for v in vectors], float) if vectors else np.zeros((1, len(STATISTICS) + more))
    mean, spread = numbers.mean(axis=0), numbers.std(axis=0)
    spread[spread < 1e-9] = 1.0
    wide = numbers.shape[1]
    dense = np.clip((numbers - mean) / spread, -5, 5) / np.sqrt(wide)
    size = fit.buckets + wide
    weights, factors = np.zeros(size), rng.normal(0, 0.05, (size, fit.factors))
    share = min(max(float(np.mean(labels)) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    sum_w, sum_v, sum_b = np.full(size, 1e-2), np.full((size, fit.factors), 1e-2), 1e-2
    tail = np.arange(fit.buckets, size)
    data = [(np.r_[b, tail], np.r_[v, d], y) for (b, v, _), d, y in zip(vectors, dense, labels)]
    for _ in range(fit.passes):
        for i in rng.permutation(len(data)).tolist():
            at, x, y = data[i]
            w, v = weights[at], factors[at]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            raw = bias + w @ x + 0.5 * float((total**2).sum() - (vx**2).sum())
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
            gw = error * x + fit.ridge * w
            gv = error * (x[:, None] * (total - vx)) + fit.ridge * v
            sum_w[at] += gw**2
            sum_v[at] += gv**2
            sum_b += error**2
            weights[at] = w - fit.rate * gw / np.sqrt(sum_w[at])
            factors[at] = v - fit.rate * gv / np.sqrt(sum_v[at])
            bias -= fit.rate * error / np.sqrt(sum_b)
    return Model(bias, weights, factors, mean, spread)


def sample(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    text: str,
    doc_id: str,
    label: str,
    fit: Fit = Fit(),
    metadata: Sequence[str] = (),
) -> tuple[list, list[int]]:
    """Vectors and labels of a bounded sample: the first labelled ids, of those that ``usable`` admits, by their hash.

    ``usable`` is a condition on ``labels``. Labels without a text shrink the sample. An id with contradicting labels has the
    larger of them; of repeated rows with one id, the first by metadata and text is taken. The ids of the sample, and no
    others, are broadcast. ``metadata`` columns of documents become features: numbers by their logarithm, others as hashed
    categories; a null is 0 or no category.
    """
    labelled = (
        labels.where(usable)
        .select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
        .where("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    chosen = labelled.orderBy(F.xxhash64("id"), "id").limit(fit.texts)
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), carried(docs, text, metadata).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    kinds = Metadata.of(docs, metadata)

    def setup():
        vectors = Vectors(fit.buckets, kinds)

        def work(batch: list) -> list:
            owner, bucket, value, numbers = vectors(batch)
            ends = np.searchsorted(owner, np.arange(1, len(batch)))
            return [np.split(bucket, ends), np.split(value, ends), list(numbers)]

        return work

    added = "buckets array<int>, amounts array<float>, numbers array<double>"
    made = map_texts(texts, "text", ["id", "label"], added, setup)
    # bounded: at most `texts` rows
    rows = made.orderBy("id").toPandas()
    vectors = [
        (np.asarray(b, np.int64), np.asarray(a, float), np.asarray(n, float))
        for b, a, n in zip(rows["buckets"], rows["amounts"], rows["numbers"])
    ]
    return vectors, rows["label"].tolist()


def score(
    docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), metadata: Sequence[str] = ()
) -> DataFrame:
    """``keep`` columns, ``score`` (probability of label 1) and ``predicted`` (1 from 0.5 on).

    ``metadata`` must name the columns that the model was trained with, in the same order.
    A null text is scored like an empty one, by the bias and the statistics of no words. Whole texts are read row by
    row: repeated rows give repeated results, an empty table an empty one. Kept columns named like a result give way
    to it.
    """
    buckets = len(model.weights) - len(model.mean)
    kinds = Metadata.of(docs, metadata)
    if len(model.mean) != len(STATISTICS) + kinds.numbers:
        raise ValueError("the model was trained with other metadata")

    def setup():
        vectors = Vectors(buckets, kinds)

        def work(texts: list) -> list:
            raw = raw_scores(model, *vectors(texts))
            p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            return [p, (p >= 0.5).astype(np.int32)]

        return work

    if not metadata:
        return map_texts(docs, text, keep, "score double, predicted int", setup)
    name = next(n for n in ("_carried", *(f"_carried{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    with_metadata = docs.withColumn(name, carried(docs, text, metadata))
    return map_texts(with_metadata, name, keep, "score double, predicted int", setup)
