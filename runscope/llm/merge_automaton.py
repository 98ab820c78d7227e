"""Byte-pair encoding by a tokenisation automaton.

The automaton reads tokens; its paths are exactly the token sequences that the merges can produce. It starts as one
state with an arc back to itself for each base symbol. Each merge ``a b -> c`` is a gadget applied to the automaton
that the merges before it have left:

* wherever an arc ``a`` is followed by an arc ``b``, an arc ``c`` leads to where the two lead together, so ``c`` can
  stand wherever ``a`` could, and what follows ``c`` is what could follow ``b``;
* the arc ``b`` goes from the state after ``a``, as the two would have been merged; states that other tokens lead to
  are left alone, so the state after ``a`` is copied first. (``a a -> aa``: of a run, all but the last are paired from
  the left, so after a single ``a`` there is no ``aa`` either.)

The state after a token depends on that token alone and is named by it. It is stored as a difference: it has the arcs
that the state after the token's second part had just before the merge that made the token, less those it lost since.

Any text has exactly one path. To encode a word, a second table, the trie of the tokens, gives the longest token at a
place; it is taken if the state has its arc, else the next shorter one is tried. A place from which nothing goes on is
left for good, as the path to it is the only one. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

_NEVER = 1 << 40
#: The symbol after the last byte of a word.
_END = 256


def byte_symbols() -> dict[int, str]:
    """The printable stand-in for each byte: itself where Latin-1 has a visible character, else the next from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenAutomaton:
    """The automaton of a list of merges over a vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]], end: str):
        self.size = max(vocabulary.values()) + 2
        self.labels = [""] * (self.size - 1)
        for label, token in vocabulary.items():
            self.labels[token] = label
        self.start = self.size - 1  # the state before the first token
        self.left, self.right, self.made = ([-1] * self.size for _ in range(3))
        self.lost: dict[int, int] = {}  # state * size + token: the merge that took the arc
        for number, (a, b) in enumerate(merges):
            self._gadget(number, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._known: dict[int, bool] = {}
        self._trie = self._trie_of(vocabulary, end)
        self.longest = max(self.length)

    def _trie_of(self, vocabulary: dict[str, int], end: str) -> dict[int, list]:
        """Transitions of the root; a transition is a list of the token that it completes (or -1) and the transitions
        that follow (or None). Also notes each token's length and the longest token that begins it. The end of a word
        is a symbol of its own."""
        number = {s: b for b, s in byte_symbols().items()}
        root: dict[int, list] = {}
        self.length, self.shorter = [0] * self.size, [-1] * self.size
        for label, token in sorted(vocabulary.items(), key=lambda x: len(x[0])):
            symbols = [number[c] for c in label.removesuffix(end)] + [_END] * label.endswith(end)
            self.length[token] = len(symbols)
            step, follow = [-1, root], root
            for symbol in symbols:
                if follow is None:
                    follow = step[1] = {}
                if step[0] >= 0:
                    self.shorter[token] = step[0]
                step = follow.setdefault(symbol, [-1, None])
                follow = step[1]
            step[0] = token
        return root

    def _gadget(self, number: int, a: int, b: int, c: int) -> None:
        if not self.has_arc(a, b, number):
            raise ValueError("the two parts of a merge never meet")
        self.left[c], self.right[c], self.made[c] = a, b, number
        self.lost[a * self.size + b] = number
        if a == b:
            self.lost[a * self.size + c] = number

    def has_arc(self, state: int, token: int, before: int = _NEVER) -> bool:
        """Whether ``state`` has an arc for ``token`` (just before a merge).

        A merged token has one if, just before the merge that made it, its first part had one, and it was not lost
        since.
        """
        lost, right, made, size = self.lost, self.right, self.made, self.size
        while True:
            at, when = state, before
            while at >= 0:
                if lost.get(at * size + token, _NEVER) < when:
                    return False
                if made[at] < when:
                    when = made[at]
                at = right[at]
            if self.left[token] < 0:
                return True
            before, token = made[token], self.left[token]

    def _arc(self, key: int) -> bool:
        if len(self._known) > 400_000:
            self._known.clear()
        known = self._known[key] = self.has_arc(*divmod(key, self.size))
        return known

    def encode(self, word: bytes) -> list[int]:
        """The path over the bytes of a word."""
        symbols = (*word, _END)
        n, size, known, arc = len(symbols), self.size, self._known, self._arc
        length, shorter, root, longest = self.length, self.shorter, self._trie, self.longest
        left: set[int] = set()
        out, at, last = [], 0, self.start
        while at < n:
            token, follow = -1, root
            for symbol in symbols[at : at + longest]:
                step = follow.get(symbol)
                if step is None:
                    break
                ends, follow = step
                if ends >= 0:
                    token = ends
                if follow is None:
                    break
            while True:
                while token >= 0:
                    stop = at + length[token]
                    if stop not in left:
                        key = last * size + token
                        fits = known.get(key)
                        if arc(key) if fits is None else fits:
                            break
                    token = shorter[token]
                if token >= 0:
                    out.append(token)
                    at, last = stop, token
                    break
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                left.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else self.start
        return out


class WordTokenizer:
    """A tokenizer file with lower-cased words, word ends and byte symbols, read into an automaton."""

    CACHED = 250_000  # chunks and words remembered; of chunks, the last full table is kept beside the new one

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if (
            steps != ["NFC", "Replace", "Lowercase"]
            or not split["invert"]
            or level["use_regex"]
            or spec["decoder"]
            or any(t[f] for t in spec["added_tokens"] for f in flags)
        ):
            raise ValueError(f"{path} is not a tokenizer of lower-cased words with plain special tokens")
        model = spec["model"]
        self.automaton = TokenAutomaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels + [""] * (1 + max([*self.special.values(), -1]) - len(self.automaton.labels))
        for label, token in self.special.items():
            self.labels[token] = label
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._pieces = regex.compile(split["pattern"]["Regex"])
        self._chunks = regex.compile(r"\S+")
        self._odd = re.compile("[\x1c-\x1f\x85]")
        self._words: dict[str, bytes] = {}
        self._cache: dict[str, tuple[bytes, str]] = {}
        self._cache_before: dict[str, tuple[bytes, str]] = {}

    def _word(self, word: str) -> bytes:
        found = self._words.get(word)
        if found is None:
            ids = self.automaton.encode(word.encode())
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(word) <= 32:
                if len(self._words) >= self.CACHED:
                    self._words.clear()
                self._words[word] = found
        return found

    def ids_of_chunk(self, chunk: str) -> bytes:
        """Normalises and splits text without white space, which no piece contains, and encodes the pieces."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace(chr(0x3A3), chr(0x3C3))  # sigma is lowered by itself
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._word(chunk)
        return b"".join(map(self._word, self._pieces.findall(chunk)))

    def _encoded(self, chunk: str) -> tuple[bytes, str]:
        out = self._cache_before.get(chunk)
        if out is None:
            ids = self.ids_of_chunk(chunk)
            out = ids, self.decode(struct.unpack(f"<{len(ids) // 4}I", ids))
        if len(chunk) <= 32:
            if len(self._cache) >= self.CACHED:
                self._cache_before, self._cache = self._cache, {}
            self._cache[chunk] = out
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs, space-joined as for a tokenizer without a decoder."""
        return " ".join(map(self.labels.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        parts = self._special.split(text) if self._special else [text]
        got = []
        for i, part in enumerate(parts):
            if i % 2:
                got.append((self.special[part].to_bytes(4, "little"), part))
                continue
            chunks = self._chunks.findall(part) if self._odd.search(part) else part.split()
            got += [self._cache.get(c) or self._encoded(c) for c in chunks]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])


@lru_cache(2)
def load(path: str) -> WordTokenizer:
    """One automaton for each worker process and file; its size is that of the vocabulary."""
    return WordTokenizer(path)


OUTPUTS = {
    "n_tokens": "bigint",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encode_texts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    outputs: Sequence[str] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """``keep`` columns and the chosen ``outputs``: ids of whole texts, the text decoded from them, their digests.

    ``path`` names a tokenizer file that every executor can read. A null text is encoded like an empty one: no tokens,
    an empty decoded text. Every row is encoded, repeated ones too; an empty table gives an empty one. Words of any
    length are encoded in one pass over their symbols. Kept columns named like an output give way to it.
    """
    schema = T._parse_datatype_string(", ".join(f"{c} {OUTPUTS[c]}" for c in outputs))

    def setup():
        tokenizer = load(path)

        def result(text: str | None) -> tuple:
            ids, decoded = tokenizer.encode(text or "")
            made = {
                "n_tokens": lambda: len(ids) // 4,
                "ids": lambda: list(memoryview(ids).cast("I")),
                "decoded": lambda: decoded,
                "ids_sha256": lambda: hashlib.sha256(ids).hexdigest(),
                "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
            }
            return tuple(made[c]() for c in outputs)

        return lambda texts: list(zip(*map(result, texts)))

    return map_texts(docs, text, keep, schema, setup)


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the text that its ids stand for (null for null ids); ``into`` is replaced."""
    from pyspark.sql import functions as F

    from .common import importable_on_workers

    importable_on_workers(docs.sparkSession)

    @F.pandas_udf("string")
    def decoded(column):
        tokenizer = load(path)
        return column.map(lambda x: None if x is None else tokenizer.decode(x))

    return docs.withColumn(into, decoded(F.col(f"`{ids}`")))
