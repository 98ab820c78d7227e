"""Small tables with the awkward cases of every operator."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, first=0, lang="en"):
    rows = [(first + i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark, clash=()):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 997} and more text." for i in range(20_000))
    rows = [
        (1, "The cat sat on the mat and looked at the birds outside.", "en", "a", 55),
        (1, "The cat sat on the mat and looked at the birds outside.", "en", "a", 55),
        (2, None, None, None, None),
        (None, "A text without an id that is long enough to be kept here.", "en", None, 10),
        (3, "", "en", "a", 0),
        (4, " \n\t ", "de", "a", 4),
        (5, long, "en", "a", len(long)),
        (6, "x" * 100_000, "en", "a", 100_000),
        (7, "éàü ß 日本語 😀 \u0301", "fr", "a", 10),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in clash:
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


def words(n, seed, vocabulary=2000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]
