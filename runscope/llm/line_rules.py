"""Quality rules: line-first cleaning.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines are removed; a document that
loses too much of its text, or fails the counts on the whole text, is rejected.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, words_of

#: Symbols counted on the whole text, and separators of menus and breadcrumbs.
SYMBOLS = "#*$%&|<>"
SEPARATORS = frozenset(["|", "||", ">", ">>", "<", "<<", "»", "«", "›", "‹", "•", "·", "::", "/", "→", "←"])

#: Phrases of page furniture.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "we use cookies",
    "privacy policy",
    "terms of service",
    "terms of use",
    "terms and conditions",
    "enable javascript",
    "javascript is disabled",
    "click here",
    "sign up for our",
    "subscribe to our newsletter",
    "skip to content",
    "back to top",
    "page not found",
    "lorem ipsum",
)

WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A short line is only held against the rules that still mean something there."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_lost_share: float = 0.3
    judged_chars: int = 20  # punctuation is judged on lines of so many characters in words
    max_symbol_share: float = 0.3
    min_separators: int = 3
    separator_share: float = 0.15
    boilerplate_words: int = 40  # a phrase condemns lines up to this length


COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_removed_lines bigint, lost_share double, base_failed boolean, kept boolean"
)


def repeated_words(words: Sequence[str]) -> int:
    """Words that lie in a window of five words found twice or more, the first one included.

    Exact: a window is one integer in mixed radix, or two ranks where the radix would not fit 64 bits.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    if len(index) == len(words):
        return 0
    if len(index) < 6000:  # 6000 ** 5 < 2 ** 63
        radix = np.int64(len(index))
        key = ids[:n].copy()
        for k in range(1, WINDOW):
            key = key * radix + ids[k : k + n]
    else:
        size = np.int64(len(words) + 1)
        two = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].astype(np.int64)
        four = np.unique(two[:-2] * size + two[2:], return_inverse=True)[1].astype(np.int64)
        key = four[:n] * size + ids[WINDOW - 1 :]
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    same = in_order[1:] == in_order[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[k : k + n] |= twice
    return int(covered.sum())


_LETTERS = re.compile(r"[^\W_]")


@lru_cache(None)
def _marks() -> re.Pattern:
    """Runs of combining marks after a letter or digit: vowel signs and accents are part of the text, not symbols.

    Variation selectors, which dress up symbols, are left out."""
    codes = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
    marks = "".join(chr(c) for c in codes if not (0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF))
    return re.compile(f"(?<=[^\\W_])[{marks}]+")


def line_fails(line: str, words: Sequence[str], rules: Rules) -> bool:
    """Whether a line with words is punctuation, navigation or boilerplate rather than text."""
    chars = sum(map(len, words))
    letters = len(_LETTERS.findall(line))
    if not letters:
        return True
    if chars - letters > rules.max_symbol_share * chars and not line.isascii():
        letters += sum(map(len, _marks().findall(line)))
    if chars >= rules.judged_chars and chars - letters > rules.max_symbol_share * chars:
        return True
    separators = sum(w in SEPARATORS for w in words)
    if separators >= rules.min_separators and separators >= rules.separator_share * len(words):
        return True
    if len(words) <= rules.boilerplate_words:
        low = line.lower()
        return any(p in low for p in BOILERPLATE)
    return False


def judge(text: str, rules: Rules) -> tuple:
    """Counts on the whole text, counts on its lines, the verdict, and the text without failing lines."""
    words = words_of(text)
    word_chars = sum(map(len, words))
    seen: set[str] = set()
    dup = n_lines = n_removed = lost = 0
    left = []
    for line in text.split("\n"):
        in_line = words_of(line)
        if not in_line:
            left.append(line)
            continue
        n_lines += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, in_line, rules):
            n_removed += 1
            lost += sum(map(len, in_line))
        else:
            left.append(line)
    repeated = repeated_words(words)
    failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)
    share = lost / word_chars if word_chars else 0.0
    kept = not failed and share <= rules.max_lost_share
    symbols = sum(map(text.count, SYMBOLS))
    cleaned = "\n".join(left) if n_removed else text
    return len(words), word_chars, symbols, dup, repeated, n_lines, n_removed, share, failed, kept, cleaned


def clean_lines(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Rules = Rules(), with_text: bool = True
) -> DataFrame:
    """Judges every text; ``keep`` columns, the counts, ``kept`` and (``with_text``) ``cleaned_text``.

    A null text counts as one without words: rejected, ``cleaned_text`` null. An empty text is rejected too. Rows are
    judged one by one, so repeated rows and ids give repeated results and an empty table gives an empty one. Kept
    columns that have the name of a result give way to it.
    """

    def setup():
        def work(texts: list) -> list:
            rows = [judge(t or "", rules) for t in texts]
            columns = list(map(list, zip(*rows)))
            if not with_text:
                return columns[:-1]
            columns[-1] = [c if t is not None else None for c, t in zip(columns[-1], texts)]
            return columns

        return work

    return map_texts(docs, text, keep, COUNTS + ", cleaned_text string" * with_text, setup)
