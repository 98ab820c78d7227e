"""Secret scan: assignments, access keys, hexadecimal keys, and strings whose characters look random.

DataFrame functions only. Matches come from regular expressions; their places are running totals over the lengths of
the matches and of the text between them. Randomness is the Shannon entropy of a sliding window, kept up to date by
the counts of the character that enters and the one that leaves. Every step is linear in the length of the text, and no
pattern repeats a group without a bound, which Java would match by recursion.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = "AKIA[A-Z0-9]+"
_HEX = "[0-9a-f]{32,}"  # runs are matched whole, so shorter ones need no match to be dropped
_CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"

#: Strings that look random and are not secret (whole candidate, unless anchored otherwise).
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)example|placeholder|changeme|dummy|sample|xxxx|\*{4}",
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    r"^(?!.*[-_/=]{2})[A-Za-z][A-Za-z_/=-]*[0-9]{0,4}$",  # words joined, perhaps with a number
    r"^[0-9+/_=-]+$",
    r"(.)\1{7}",
)


@dataclass(frozen=True)
class Limits:
    """Bits of entropy in the fullest window at which a candidate counts as random, by character class."""

    window: int = 20
    hex_bits: float = 3.0
    one_case_bits: float = 3.55
    base64_bits: float = 3.9


#: Elements of an array that are totalled by appending to a growing array.
_CHUNK = 128
#: Whole parts of a bit: terms of the entropy are whole numbers, so that steps back and forth leave no trace.
_PARTS = 1 << 40
_NO_SPANS = "CAST(array() AS array<struct<start: bigint, end: bigint, match: string>>)"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of bigint by ``f`` (from 0): inside chunks, and over the totals of the chunks."""

    def fold(array: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return _let(f(acc["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out")))

        return F.aggregate(array, zero, step, lambda acc: acc["out"])

    zero = F.lit(0).cast("bigint")
    last = F.floor((F.size(values) - 1) / F.lit(_CHUNK)).cast("int")
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), last))
    chunks = F.transform(numbers, lambda i: F.slice(values, i * _CHUNK + 1, F.lit(_CHUNK)))

    def placed(parts: Column) -> Column:
        ends = fold(F.transform(parts, lambda part: F.aggregate(part, zero, lambda a, x: f(a, x))), zero)
        return _let(
            ends,
            lambda e: F.flatten(
                F.transform(parts, lambda part, i: fold(part, F.when(i == 0, zero).otherwise(F.get(e, i - 1))))
            ),
        )

    return F.when(F.size(values) <= _CHUNK, fold(values, zero)).otherwise(_let(chunks, placed))


def spans_of(text: Column, pattern: str, matches: Column) -> Column:
    """(start, end, match) of every match: a running total over the text between matches and the matches."""
    between = F.split(text, pattern, -1)
    widths = F.zip_with(
        matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, b: (F.length(m) + F.length(b)).cast("bigint")
    )

    def spans(ends: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            end = F.get(ends, i)
            return F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"))

        return F.transform(matches, span)

    return F.when(F.size(matches) == 0, F.expr(_NO_SPANS)).otherwise(
        _let(_let(widths, lambda w: running(w, lambda a, x: a + x)), spans)
    )


def window_entropy(s: Column, window: int) -> Column:
    """Largest Shannon entropy, in bits, over the windows of a printable ASCII string (of the whole string if it is shorter).

    With counts c of the characters in a window of w, the entropy is log2 w - sum(c log2 c) / w. The counts are kept as a
    string with a character for each of the alphabet. A step lowers the count of the character that leaves, raises that of
    the one that enters, and changes the sum by those two terms.
    """
    if not 0 < window < 75:
        raise ValueError("a count must fit a printable character")
    terms = F.array(*[F.lit(round(c * math.log2(c) * _PARTS) if c else 0).cast("bigint") for c in range(window + 1)])
    zero = F.struct(
        F.lit(0).cast("bigint").alias("total"), F.lit(0.0).alias("best"), F.lit("0" * 96).alias("counts")
    )

    def changed(acc: Column, slot: Column, by: int) -> Column:
        def put(before: Column) -> Column:
            total = acc["total"] + F.get(terms, before + by) - F.get(terms, before)
            counts = F.overlay(acc["counts"], F.chr((before + (48 + by)).cast("bigint")), slot, F.lit(1))
            return F.struct(total.alias("total"), acc["best"].alias("best"), counts.alias("counts"))

        return _let(F.ascii(F.substr(acc["counts"], slot, F.lit(1))) - 48, put)

    def entropy(slots: Column) -> Column:
        size = F.least(F.size(slots), F.lit(window))

        def seen(acc: Column, i: Column) -> Column:
            bits = F.log2(size) - acc["total"].cast("double") / _PARTS / size
            best = F.when(i + 1 >= size, F.greatest(acc["best"], bits)).otherwise(acc["best"])
            return F.struct(acc["total"].alias("total"), best.alias("best"), acc["counts"].alias("counts"))

        def step(acc: Column, i: Column) -> Column:
            left = F.when(i >= window, changed(acc, F.get(slots, i - window), -1)).otherwise(acc)
            return _let(
                left, lambda before: _let(changed(before, F.get(slots, i), 1), lambda now: seen(now, i))
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(slots) - 1), zero, step, lambda acc: acc["best"])

    slots = F.transform(F.slice(F.split(s, ""), F.lit(1), F.length(s)), lambda c: F.ascii(c) - 31)
    return F.when(s == "", F.lit(0.0)).otherwise(_let(slots, entropy))


def looks_random(s: Column, limits: Limits, allow: Sequence[str]) -> Column:
    """Digits and letters together, no allow-listed form, and a window over the limit of its character class."""
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    for pattern in allow:
        mixed = mixed & ~s.rlike(pattern)
    limit = (
        F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(limits.hex_bits))
        .when(s.rlike("^([^A-Z]+|[^a-z]+)$"), F.lit(limits.one_case_bits))
        .otherwise(F.lit(limits.base64_bits))
    )
    return F.when(mixed, window_entropy(s, limits.window) >= limit).otherwise(F.lit(False))


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limits: Limits = Limits(),
    allow: Sequence[str] = ALLOW,
) -> DataFrame:
    """``keep`` columns, ``base_spans`` and ``spans`` (start, kind_no, end), ordered by start, then kind.

    ``kind_no`` counts ``KINDS`` from 0; places count code points, ends exclusive. Base matches are leftmost and
    non-overlapping for each kind; entropy spans are added where they meet no base span. A null text has none, like an
    empty one. There is no shuffle and no Python on the rows: repeated rows give repeated results, an empty table an
    empty one, and whole texts are scanned. Kept columns named like a result give way to it.
    """
    keep = [c for c in keep if c not in ("base_spans", "spans")]
    patterns = dict(zip(KINDS, (_ASSIGN, _ACCESS, _HEX, _CANDIDATE)))
    # `keep` travels in one struct, so that no name of its columns can meet a name used here
    kept = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("kept")
    frame = docs.select(kept, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    frame = frame.select("*", *[F.regexp_extract_all("text", F.lit(p), 0).alias(f"m_{k}") for k, p in patterns.items()])
    # a candidate is worth its place only if one of its kind looks random; each is judged once
    frame = frame.withColumn("random", F.transform("m_entropy", lambda s: looks_random(s, limits, allow)))
    some = F.exists("random", lambda r: r)
    frame = frame.withColumn("m_entropy", F.when(some, F.col("m_entropy")).otherwise(F.expr("CAST(array() AS array<string>)")))
    frame = frame.select(
        "kept", "random", *[spans_of(F.col("text"), p, F.col(f"m_{k}")).alias(k) for k, p in patterns.items()]
    )
    ok = {
        "assign": lambda s: F.length(F.regexp_extract(s["match"], _ASSIGN, 1)) >= 8,
        "access": lambda s: F.length(s["match"]) >= 16,
        "hex": lambda s: F.lit(True),
    }

    def place(no: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"))

    base = [F.transform(F.filter(k, ok[k]), place(no)) for no, k in enumerate(KINDS[:3])]
    # no column is named inside a function on elements: Spark may compute it anew for each of them
    judged = F.filter(F.zip_with("entropy", "random", lambda s, r: F.when(r, place(3)(s))), lambda s: s.isNotNull())
    random = F.when(F.size("entropy") > 0, judged).otherwise(F.expr("CAST(array() AS array<struct<start: bigint, kind_no: int, end: bigint>>)"))
    frame = frame.select("kept", F.array_sort(F.concat(*base)).alias("base_spans"), random.alias("random"))
    frame = frame.select("kept", "base_spans", "random", F.array_sort(F.concat("base_spans", "random")).alias("all"))
    # a base span that meets a random one begins before its end: the last end of those before, or the next one, shows it
    reach = running(
        F.transform("all", lambda s: F.when(s["kind_no"] < 3, s["end"]).otherwise(F.lit(0).cast("bigint"))), F.greatest
    )
    later = F.slice("all", F.lit(2), F.size("all"))
    lined = F.arrays_zip(F.col("all").alias("span"), reach.alias("reach"), later.alias("later"))

    def apart(s: Column) -> Column:
        met = (s["later"]["kind_no"] < 3) & (s["later"]["start"] < s["span"]["end"])
        return (s["span"]["kind_no"] < 3) | ((s["reach"] <= s["span"]["start"]) & ~F.coalesce(met, F.lit(False)))

    chosen = F.transform(F.filter(lined, apart), lambda s: s["span"])
    spans = F.when(F.size("random") == 0, F.col("base_spans")).otherwise(chosen)
    return frame.select(*[F.col(f"kept.`{c}`") for c in keep], "base_spans", spans.alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end, comma-joined in the order of the spans."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ","
    )


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind))).cast("bigint")
