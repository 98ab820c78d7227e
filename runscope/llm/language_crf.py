"""Language of words and texts by a linear-chain conditional random field.

The words of a line are a chain. What a word says about its language is a sum of weights of its affixes, character
n-grams and lexicon entry; learned transitions say how languages follow each other, so that words of mixed text get
their own language and short ambiguous ones that of their surroundings. Forward-backward gives each word's
probabilities; a text has the language with the most probability over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

UNDETERMINED = "und"

#: Longest chain; a longer line is cut into several.
CHAIN = 256

#: Text looked at together; a longer one is cut at white space, as chains end there or a little later anyway.
PART = 1 << 20

# numerals such as superscripts are word characters, but neither letters nor digits
_NUMERALS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NUMERAL = re.compile(f"[{_NUMERALS}]")
_LATIN_NUMERALS = [c for c in _NUMERALS if ord(c) < 0x100]
_TOKENS = re.compile(r"\n|[^\W\d_]+")
_TOKENS_BESIDE_NUMERALS = re.compile(rf"\n|[^\W\d_{_NUMERALS}]+")


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample and of the training. At most ``texts`` texts of each of at most ``languages`` languages,
    and ``lines`` lines of each text, are brought to the driver."""

    texts: int = 200
    lines: int = 6
    languages: int = 64
    lexicon: int = 3  # a word seen so often has an entry of its own
    rounds: int = 30
    rate: float = 0.15
    ridge: float = 1e-6
    spliced: float = 0.5  # share of the chains that are followed by one in another language
    seed: int = 7


@dataclass
class Model:
    """Labels, weights by feature (a row per feature), transitions."""

    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.empty(0))


def features_of(word: str) -> list[str]:
    """Affixes of one to three letters, trigrams with the word's ends, and the word itself."""
    ends = f"<{word}>"
    out = ["w" + word]
    out += ["p" + word[:k] for k in (1, 2, 3) if k <= len(word)]
    out += ["s" + word[-k:] for k in (1, 2, 3) if k <= len(word)]
    out += ["n" + ends[i : i + 3] for i in range(len(ends) - 2)]
    return out


def _has_numerals(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _NUMERAL.search(text) is not None
    return any(c in text for c in _LATIN_NUMERALS)


def chains_of(text: str) -> tuple[list[str], list[int]]:
    """Words of letters, lower-cased, and the lengths of the chains that they form."""
    words: list[str] = []
    lengths: list[int] = []
    begun = 0
    pattern = _TOKENS_BESIDE_NUMERALS if _has_numerals(text) else _TOKENS
    for token in pattern.findall(text.lower()):
        if token != "\n":
            words.append(token)
        if (token == "\n" and len(words) > begun) or len(words) - begun == CHAIN:
            lengths.append(len(words) - begun)
            begun = len(words)
    if len(words) > begun:
        lengths.append(len(words) - begun)
    return words, lengths


def parts_of(text: str) -> list[str]:
    """The text in parts of about ``PART`` characters, cut at white space where there is some."""
    out, at = [], 0
    while len(text) - at > 2 * PART:
        stop = max(text.rfind(" ", at, at + PART), text.rfind("\n", at, at + PART))
        stop = stop if stop > at else at + PART
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, transitions: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of the labels of every word, and (``pairs``) the expected number of each transition.

    ``scores`` has a row per word, chain after chain. All chains take a step together, longest first, so the number of
    steps is the length of the longest chain and the work is in whole arrays. Each step is scaled to sum to one.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    length = lengths[order]
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(transitions)
    alpha, out = np.empty_like(emit), np.empty_like(emit)
    for t, n in enumerate(active):
        at = first[:n] + t
        now = emit[at] * (alpha[at - 1] @ step if t else np.exp(start))
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    expected = np.zeros_like(step) if pairs else None
    beta = np.ones((len(length), step.shape[0]))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        both = alpha[at] * beta[:n]
        out[at] = both / both.sum(axis=1, keepdims=True)
        if t:
            ahead = emit[at] * beta[:n]
            if pairs:
                joint_total = ((alpha[at - 1] @ step) * ahead).sum(axis=1, keepdims=True)
                expected += (alpha[at - 1].T @ (ahead / joint_total)) * step
            back = ahead @ step.T
            beta[:n] = back / back.sum(axis=1, keepdims=True)
    return out, expected


def train(texts: Sequence[str], languages: Sequence[str], fit: Fit = Fit()) -> Model:
    """Weights by gradient steps (Adam) on the likelihood of the labels, over all chains at once.

    The label of a word is that of its text. Half of the chains are spliced with one of another language, so the
    transitions are learned from mixed chains too.
    """
    labels = sorted(set(languages))
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(fit.seed)
    chains = []
    for text, language in zip(texts, languages):
        words, lengths = chains_of(text)
        at = 0
        for n in lengths:
            chains.append((words[at : at + n], number[language]))
            at += n
    order = rng.permutation(len(chains)).tolist()
    words, truth, lengths = [], [], []
    i = 0
    while i < len(order):
        chain, label = chains[order[i]]
        parts = [(chain, label)]
        if i + 1 < len(order) and rng.random() < fit.spliced and chains[order[i + 1]][1] != label:
            i += 1
            parts.append(chains[order[i]])
        for chain, label in parts:
            words += chain
            truth += [label] * len(chain)
        lengths.append(sum(len(c) for c, _ in parts))
        i += 1
    k = len(labels)
    if not words:
        return Model(labels, {}, np.zeros((1, k)), np.zeros((k, k)), np.zeros(k))
    counts = Counter(words)
    distinct = {w: j for j, w in enumerate(counts)}
    features: dict[str, int] = {}
    rows, columns = [], []
    for word, j in distinct.items():
        for f in features_of(word):
            if f[0] != "w" or counts[word] >= fit.lexicon:
                rows.append(j)
                columns.append(features.setdefault(f, len(features)))
    rows, columns = np.array(rows), np.array(columns)
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
    ids = np.array([distinct[w] for w in words])
    truth, lengths = np.array(truth), np.array(lengths)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(truth), bool)
    inside[first] = False
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (truth[:-1][inside[1:]], truth[1:][inside[1:]]), 1)
    seen_start = np.bincount(truth[first], minlength=k)
    one_hot = np.eye(k)[truth]
    sizes = [len(features) * k, k * k, k]
    flat = np.zeros(sum(sizes))
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, fit.rounds + 1):
        weights, moves, begin = np.split(flat, np.cumsum(sizes)[:2])
        weights, moves = weights.reshape(-1, k), moves.reshape(k, k)
        by_word = np.add.reduceat(weights[columns], starts, axis=0)
        got, expected = forward_backward(by_word[ids], lengths, begin, moves, pairs=True)
        rest = one_hot - got
        gradient = np.empty((len(features), k))
        for label in range(k):
            of_word = np.bincount(ids, rest[:, label], len(distinct))
            gradient[:, label] = np.bincount(columns, of_word[rows], len(features))
        gradient = np.r_[gradient.ravel(), (seen_pairs - expected).ravel(), seen_start - got[first].sum(axis=0)]
        gradient = gradient / len(ids) - fit.ridge * flat
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        flat = flat + fit.rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights, moves, begin = np.split(flat, np.cumsum(sizes)[:2])
    return Model(labels, features, weights.reshape(-1, k), moves.reshape(k, k), begin)


def sample(docs: DataFrame, text: str, language: str, fit: Fit = Fit()) -> tuple[list[str], list[str]]:
    """A bounded sample of lines with their language: distinct texts by a hash of the text, lines by a hash of the line.

    The first hashes of each language are chosen among the distinct ones, so copies take one place together; only then
    are texts moved, those of the chosen hashes, once each. Each task sends at most ``texts`` hashes of a language to
    the ranking, as only the first are wanted. Lines are looked at in the chosen texts alone; a long one counts as
    several.
    """
    rows = (
        docs.select(
            F.col(f"`{language}`").cast("string").alias("language"), F.col(f"`{text}`").cast("string").alias("text")
        )
        .where(F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .withColumn("hash", F.xxhash64("text"))
    )
    by_language = Window.partitionBy("language")
    wanted = (
        rows.select("language", "hash")
        .distinct()
        .withColumn("n", F.row_number().over(by_language.orderBy("hash")))
        .where(F.col("n") <= fit.texts)
        .orderBy("n", "language")
        .limit(fit.texts * fit.languages)
        .drop("n")
    )
    distinct = rows.join(F.broadcast(wanted), ["language", "hash"]).dropDuplicates(["language", "text"])
    # texts that share a hash are told apart here
    first = F.row_number().over(by_language.orderBy("hash", "text"))
    chosen = distinct.withColumn("n", first).where(F.col("n") <= fit.texts)
    lines = F.filter(F.regexp_extract_all("text", F.lit(r"[^\n]{1,1000}"), 0), lambda x: x.rlike(r"\p{L}"))
    hashed = F.transform(F.array_distinct(lines), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))
    rows = (
        chosen.select("language", "n", F.slice(F.array_sort(hashed)["x"], 1, fit.lines).alias("lines"))
        .orderBy("n", "language")
        .limit(fit.texts * fit.languages)
        .collect()
    )
    return ["\n".join(r["lines"]) for r in rows], [r["language"] for r in rows]


def identify(
    docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",), spans: bool = False
) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score``, ``n_letter_words`` and, with ``spans``, runs of words in one language.

    ``score`` is the mean probability of the predicted language over the words; ties go to the first label. A null
    text, or one without letters (or a model without labels), is ``und`` with score 0. ``shares`` has the mean
    probability of each label in the order of the labels. ``spans`` has (language, first word, words). Whole texts are
    read row by row, long ones in parts: repeated rows give repeated results, an empty table an empty one. Kept columns
    named like a result give way to it.
    """

    def setup():
        labels, features = model.labels, model.features
        weights = np.vstack([model.weights, np.zeros((1, len(labels)))])
        none = len(weights) - 1
        index: dict[str, int] = {}
        held = [np.zeros((0, len(labels)))]

        def score_new(words: list[str]) -> None:
            """Adds the scores of words not met so far; the table is begun anew when it is large."""
            flat, starts = [], []
            for word in words:
                index[word] = len(index)
                starts.append(len(flat))
                flat += [features.get(f, none) for f in features_of(word)]
            held[0] = np.vstack([held[0], np.add.reduceat(weights[flat], starts, axis=0)])

        def work(texts: list) -> list:
            if len(index) > 200_000:
                index.clear()
                held[0] = held[0][:0]
            counts = np.zeros(len(texts), np.int64)
            sums = np.zeros((len(texts), len(labels)))
            choices: list[list] = [[] for _ in texts]
            words: list[str] = []
            lengths: list[int] = []
            owners: list[tuple[int, int]] = []

            def flush() -> None:
                """Probabilities of the words gathered, added up by text."""
                if words and labels:
                    new = [w for w in dict.fromkeys(words) if w not in index]
                    if new:
                        score_new(new)
                    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                    got, _ = forward_backward(held[0][ids], np.array(lengths), model.start, model.transitions)
                    at = 0
                    for i, n in owners:
                        sums[i] += got[at : at + n].sum(axis=0)
                        if spans:
                            choices[i].append(got[at : at + n].argmax(axis=1))
                        at += n
                for gathered in (words, lengths, owners):
                    gathered.clear()

            for i, text in enumerate(texts):
                for part in parts_of(text or ""):
                    w, n = chains_of(part)
                    counts[i] += len(w)
                    if w:
                        words += w
                        lengths += n
                        owners.append((i, len(w)))
                    if len(words) > 400_000:
                        flush()
            flush()
            lang, score, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for i in np.flatnonzero(counts).tolist() if labels else []:
                row = sums[i] / counts[i]
                best = int(row.argmax())
                lang[i], score[i], shares[i] = labels[best], min(1.0, float(row[best])), row
            out = [lang, score, counts, shares]
            if spans:
                out.append([_runs(np.concatenate(c), labels) if c else [] for c in choices])
            return out

        return work

    added = "lang_pred string, score double, n_letter_words bigint, shares array<double>"
    if spans:
        added += ", spans array<struct<language: string, first_word: bigint, words: bigint>>"
    return map_texts(docs, text, keep, added, setup)


def _runs(choice: np.ndarray, labels: list[str]) -> list[dict]:
    if not len(choice):
        return []
    at = np.r_[0, np.flatnonzero(np.diff(choice)) + 1]
    return [
        {"language": labels[choice[a]], "first_word": int(a), "words": int(n)}
        for a, n in zip(at, np.diff(np.r_[at, len(choice)]))
    ]
