"""Personal data behind disguises, with spans of the original text.

Transducers rewrite homoglyphs, spelled digits and at/dot disguises; each rewrite remembers which characters it came
from. Identifiers are detected in the text as it is (the base) and in the rewritten text, and spans found there are
mapped back to characters of the source.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# a match can only begin where a run of digits begins, which keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            out.append((start, end := m.end()))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def detect(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, kinds as listed, then by start; failing matches are dropped."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


#: Look-alike letters that compatibility normalisation leaves alone.
CYRILLIC = dict(zip("АВЕКМНОРСТУХаеорсухіјѕһԁԛԝ", "ABEKMHOPCTYXaeopcyxijshdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιορυν", "ABEZHIKMNOPTYXaiopuv"))
DASHES = (0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2043, 0x2212)
DOTS = (0xB7, 0x2024, 0x2219, 0x3002, 0xFF61)
SPACES = (0xA0, 0x2007, 0x2009, 0x202F)
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)

#: Digits as words.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6",
    "siete": "7", "ocho": "8", "nueve": "9", "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7",
    "huit": "8", "neuf": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
}

_AT = "at|arroba|chez"
_DOT = "dot|punto|point|punkt"
_ONE = "|".join(sorted(SPELLED, key=len, reverse=True))
_BETWEEN = r"[\x20,;-]{1,2}"
_RUN = re.compile(rf"(?i)\b(?:(?:{_ONE}){_BETWEEN}(?:[0-9]+{_BETWEEN})*){{2,}}(?:{_ONE})\b")
_IN_RUN = re.compile(rf"(?i){_ONE}|[0-9]+")
# a match begins at the first of a run of spaces, which keeps long runs linear
_BRACKETED_AT = re.compile(rf"(?i)(?<!\x20)\x20*[\[({{<]\x20*(?:{_AT}|@)\x20*[\])}}>]\x20*")
_BRACKETED_DOT = re.compile(rf"(?i)(?<!\x20)\x20*[\[({{<]\x20*(?:{_DOT}|\.)\x20*[\])}}>]\x20*")
_PLAIN_DOT = re.compile(rf"(?i)(?<=[a-z0-9])\x20+(?:{_DOT})\x20+(?=[a-z0-9])")
_PLAIN_AT = re.compile(rf"(?i)(?<=[a-z0-9])\x20+(?:{_AT})\x20+(?=([a-z0-9-]+(?:\.[a-z0-9-]+)+)(/?))")
_PLUS = re.compile(r"(?i)\bplus\x20+(?=[0-9])")
_BRACKET = re.compile(rf"(?i)[\[({{<]\x20*(?:{_AT}|{_DOT}|@|\.)\x20*[\])}}>]")
_A_DOT = re.compile(rf"(?i)\x20(?:{_DOT})\x20")
_AN_AT = re.compile(rf"(?i)\x20(?:{_AT})\x20")
# a plain domain after a plain "at": its last label is of letters ("at 3.5", "at noon.Then"), it is no web address
_MAIL_DOMAIN = re.compile(r"(?!(?i:www)\.)[A-Za-z0-9.-]+\.(?:[a-z]{2,}|[A-Z]{2,})-*")

# what speaks for an address where "at" and the domain are plain: a local part that is no word, a cue before it, or a line that
# begins with it and holds nothing else, or does not begin like a sentence; "arroba" speaks for itself
_NO_WORD = re.compile(r"(?=.{5})[A-Za-z][A-Za-z]*(?:[0-9_%+]|\.[A-Za-z0-9])[A-Za-z0-9._%+-]*")
_CUE = re.compile(
    r"(?i)(?<![a-z])(?:e-?mail|mail|mailto|contact|write|courriel|correo|kontakt|address|adresse|e-?mail-adresse)"
    r"(?:\x20(?:is|to|address|es|est|ist|a|an|à))?[\x20:]{1,3}\Z"
)
_ALONE_BEFORE = re.compile(r"(?:\A|[\n;|<(\[])[\x20\t]{0,8}\Z")
_ALONE_AFTER = re.compile(r"[\x20\t]{0,8}(?:\Z|[\n;|>)\]])")
#: Words that stand before "at" in plain sentences.
_COMMON = frozenset(
    "a about all am and are arrive arrived available back be been buy by book call click down everyone find found from get go had has "
    "have he hello help her here him his home hosted i information is it join joined just learn live lived lives located look looked "
    "looking made me meet meeting met more my new news not now of off office on online only open or order our out over page people "
    "posted read read see seen selling she shop shopping site sold someone start started stay stop store talk team that the their them "
    "there they this those time to today tomorrow up us visit was we website were when where work worked working works you your".split()
)


def _is_address(text: str, at: int, domain: re.Match) -> bool:
    """Whether a word before a plain "at" (that begins at ``at``) and a plain domain are meant as an address."""
    local = _LOCAL.search(text, max(0, at - 64), at)
    if not local or domain[2] or not _MAIL_DOMAIN.fullmatch(domain[1]):
        return False
    if _NO_WORD.fullmatch(local[0]) or "arroba" in domain[0].lower():
        return True
    if local[0].lower() in _COMMON:
        return False
    before = text[max(0, local.start() - 40) : local.start()]
    alone = _ALONE_BEFORE.search(before) and (len(before) == local.start() or before.strip("\x20\t"))
    no_sentence = local[0][0].islower() or domain[1].isupper()
    return bool(_CUE.search(before) or alone and (no_sentence or _ALONE_AFTER.match(text, domain.end(1))))


@lru_cache(None)
def homoglyphs() -> tuple[dict[int, str], re.Pattern]:
    """Characters outside ASCII that stand for one ASCII character, by rule: digits of any script and whatever
    compatibility normalisation maps there; and the fixed look-alikes."""
    table = {}
    for code in range(0x250, 0x1FFFF):
        c = chr(code)
        if (d := unicodedata.decimal(c, None)) is not None:
            table[code] = str(d)
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and "!" <= n <= "~":
            table[code] = n
    for letters in (CYRILLIC, GREEK):
        table.update({ord(a): b for a, b in letters.items()})
    for codes, stands_for in ((DASHES, "-"), (DOTS, "."), (SPACES, " "), (INVISIBLE, "")):
        table.update(dict.fromkeys(codes, stands_for))
    low = "".join(chr(c) for c in table if c < 0x250)
    return table, re.compile(f"[{low}{chr(0x250)}-{chr(sys.maxunicode)}]")


class Rewritten:
    """A text and, for each stretch that was rewritten, where it came from."""

    def __init__(self, text: str):
        self.text = text
        self.edits: list[tuple[int, int, int, int]] = []  # new start, new end, source start, source end
        self._starts: list[int] = []

    def apply(self, changes: list[tuple[int, int, str]]) -> None:
        """``changes``: (start, end, replacement) on the current text, in order and apart from each other.

        One pass over the changes and the earlier edits; a change that cuts into an earlier edit takes in all of it.
        """
        text, old, i = self.text, self.edits, 0
        parts, edits, at, shift = [], [], 0, 0
        for start, end, new in changes:
            while i < len(old) and old[i][1] <= start:
                edits.append((old[i][0] + shift, old[i][1] + shift, *old[i][2:]))
                i += 1
            if i < len(old) and old[i][0] < start:
                start, new = old[i][0], text[old[i][0] : start] + new
            while i < len(old) and old[i][0] < end:
                if old[i][1] > end:
                    end, new = old[i][1], new + text[end : old[i][1]]
                i += 1
            if start < at:
                continue
            parts += [text[at:start], new]
            edits.append((start + shift, start + shift + len(new), *self.source(start, end)))
            shift += len(new) - (end - start)
            at = end
        edits += [(a + shift, b + shift, s, e) for a, b, s, e in old[i:]]
        self.text = "".join([*parts, text[at:]])
        self.edits = edits
        self._starts = [e[0] for e in edits]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span: a rewritten stretch stands for all that it came from."""
        i, j = bisect_right(self._starts, start) - 1, bisect_right(self._starts, end - 1) - 1
        low, high = start, end
        if i >= 0:
            a, b, s, e = self.edits[i]
            low = s if start < b else e + start - b
        if j >= 0:
            a, b, s, e = self.edits[j]
            high = e if end <= b else e + end - b
        return low, high

    def touched(self, start: int, end: int) -> bool:
        """Whether something inside the span was rewritten."""
        i = bisect_right(self._starts, end - 1) - 1
        return i >= 0 and (self.edits[i][1] > start or self.edits[i][0] > start)


def rewrite(text: str) -> Rewritten | None:
    """The text with its disguises undone; None if there are none."""
    out = Rewritten(text)
    table, odd = homoglyphs()
    if not text.isascii() and odd.search(text):
        out.apply([(m.start(), m.end(), table[ord(m[0])]) for m in odd.finditer(text) if ord(m[0]) in table])
    runs = []
    for m in _RUN.finditer(out.text):
        runs.append((*m.span(), "".join(SPELLED.get(x.lower(), x) for x in _IN_RUN.findall(m[0]))))
    out.apply(runs)
    now = out.text
    if _BRACKET.search(now):
        out.apply([(*m.span(), "@") for m in _BRACKETED_AT.finditer(now)])
        out.apply([(*m.span(), ".") for m in _BRACKETED_DOT.finditer(out.text)])
    if _A_DOT.search(out.text):
        out.apply([(*m.span(), ".") for m in _PLAIN_DOT.finditer(out.text)])
    if _AN_AT.search(out.text):
        found = _PLAIN_AT.finditer(out.text)
        text = out.text
        out.apply([(*m.span(), "@") for m in found if out.touched(*m.span(1)) or _is_address(text, m.start(), m)])
    if "plu" in out.text.lower():
        out.apply([(*m.span(), "+") for m in _PLUS.finditer(out.text)])
    return out if out.edits else None


def find(text: str) -> tuple[list, list]:
    """Base spans, and all spans: the base and what only the rewritten text shows (kind, start, end)."""
    base = detect(text)
    new = rewrite(text)
    if new is None:
        return base, base
    more = set()
    for kind, start, end in detect(new.text):
        if new.touched(start, end):
            more.add((kind, *new.source(start, end)))
    if not more:
        return base, base
    return base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: Sequence[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"


def find_personal_data(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), with_text: bool = True
) -> DataFrame:
    """``keep`` columns, ``base_spans``, ``spans`` (base and deobfuscated) and (``with_text``) ``redacted_text``.

    Spans count code points, end exclusive, ordered by kind as in ``KINDS``, then start. A null text has no spans and
    stays null; an empty one has none. Whole texts are read, rows independently of each other: repeated rows give
    repeated results, an empty table an empty one. Kept columns named like a result give way to it.
    """

    def as_rows(spans):
        return [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def setup():
        def work(texts: list) -> list:
            found = [find(t or "") for t in texts]
            columns = [[as_rows(b) for b, _ in found], [as_rows(a) for _, a in found]]
            if with_text:
                columns.append([t and redact(t, a) for t, (_, a) in zip(texts, found)])
            return columns

        return work

    added = f"base_spans {SPAN}, spans {SPAN}" + ", redacted_text string" * with_text
    return map_texts(docs, text, keep, added, setup)
