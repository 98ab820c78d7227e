"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies: the source's target over its size. Along an order of the
documents the expected copies are summed up, one random offset of the source is added, and a document is taken once for
each whole number that its stretch of the sums crosses. The order goes by size class first, so that short and long
documents are taken in proportion and the words taken come near the target.

DataFrame functions only. Numbers are whole multiples of 1 / UNIT, so sums do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, written

WORD = r"[^\x20\x09-\x0D]+"
#: Expected copies and offsets are counted in these parts of a copy: six hexadecimal digits.
UNIT = 1 << 24
#: Rows of one group of the running sums, on average; identical rows beyond it get groups of their own.
GROUP = 20_000

_RESULTS = ("size", "source_size", "target", "copies", "taken")


def size_class(size: str) -> Column:
    """Grows with the size, eight classes for each power of two."""
    bits = f"length(bin({size}))"
    return F.expr(f"8 * {bits} + (shiftright({size}, greatest({bits} - 4, 0)) & 7L)")


def numbered(df: DataFrame, by: str, into: str, folder: str) -> DataFrame:
    """Numbers 0, 1, ... by the order of a string column, nulls last, without sorting all rows in one task."""
    order = F.asc_nulls_last(by)
    dealt = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), folder)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_at"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_no", place).join(starts, "_part").withColumn(into, F.col("_at") + F.col("_no")).drop("_part", "_no", "_at")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int, folder: str) -> DataFrame:
    """``source``, ``source_size`` and ``target`` for rows of (source, source_size), one for each source.

    Sources in the order of their names, null last, take the ``weights`` in turn and share the sum of all sizes by them.
    A target stops at ``most`` times its source's size, and the others share what is over, until none is above. Each round
    is one sum over the sources; shares are kept as fractions of whole numbers.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("bigint")
    sources = numbered(sizes, "source", "no", f"{folder}/order").select("source", "source_size", weight.alias("weight"))
    sources = written(sources.withColumn("cap", F.col("source_size") * most), f"{folder}/weights")

    def number(c: Column) -> Column:
        return c.cast("decimal(19,0)")

    total, parts = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    shared, above, known = total or 0, F.lit(False), 0
    while parts:
        above = number(F.col("cap")) * number(F.lit(parts)) < number(F.col("weight")) * number(F.lit(shared))
        over = F.when(above, F.col("cap")).otherwise(0)
        found, capped, rest = sources.agg(
            F.count_if(above), F.sum(over), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if found == known:
            break
        known, shared, parts = found, total - capped, rest
    fair = (F.col("weight") * F.lit(shared)).cast("double") / F.lit(float(parts or 1))
    target = F.when(above if parts else F.lit(True), F.col("cap").cast("double")).otherwise(fair)
    return sources.select("source", "source_size", target.alias("target"))


def systematic_mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    source: str = "source",
    text: str = "text",
    doc_id: str = "doc_id",
    keep: Sequence[str] = ("doc_id",),
    seed: int = 11,
    group: int = GROUP,
    folder: str | None = None,
) -> DataFrame:
    """``keep`` columns of every document with ``size`` (words), ``source_size``, ``target`` (of its source, in words),
    ``copies`` (how often the mix takes it, at most ``most`` times) and ``taken`` (copies times size).

    A null text has no words, like an empty one; such documents take part and take no words. A null source is a source
    of its own. Order and offset come from digests of id, text, source and seed, so a rerun takes the same documents;
    rows alike in id, text, size and ``keep`` are counted together and their copies dealt among them. An empty table gives
    an empty one. ``keep`` columns (of a type that can be sorted) named like a result give way to it. Intermediate tables
    are stored in ``folder`` (by default below ``spark.checkpoint.dir``).
    """
    folder = folder or shared_folder(docs.sparkSession)
    keep = [c for c in keep if c not in _RESULTS]
    words, name = F.col(f"`{text}`").cast("string"), F.col(f"`{source}`").cast("string")
    # `keep` travels in one struct, so that no name of its columns can meet a name used here; a struct is never null
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("kept"),
        F.struct(name.alias("name")).alias("source"),
        F.coalesce(F.regexp_count(words, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.col(f"`{doc_id}`").cast("string"), words)).alias("key"),
    )
    same = written(rows.groupBy("kept", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), f"{folder}/rows")

    totals = same.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(totals.select("source.name", "source_size").toDF("source", "source_size"), weights, most, folder)
    expects = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") * float(UNIT) / F.col("source_size"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "source"))
    targets = targets.select(
        F.struct(F.col("source").alias("name")).alias("source"),
        F.struct(
            "source_size",
            "target",
            F.floor(expects).alias("each"),
            F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint").alias("offset"),
        ).alias("about"),
    )

    # groups of neighbours in the order: size class, first digits of the key, and pieces of rows that are all alike
    count = same.agg(F.sum("n")).first()[0] or 0
    digits = 0
    while count > group * 16**digits:
        digits += 1
    last = F.floor((F.col("n") - 1) / group)
    pieces = same.select(
        "kept", "source", "size", "key", "n", size_class("size").alias("class"), F.substring("key", 1, digits).alias("sub"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"),
    ).withColumn("n", F.least(F.lit(group), F.col("n") - F.col("piece") * group))
    sums = pieces.groupBy("source", "class", "sub", "piece").agg(F.sum("n").alias("n"))
    before = (Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("class").rowsBetween(*before)
    in_class = Window.partitionBy("source", "class").orderBy("sub", "piece").rowsBetween(*before)
    classes = sums.groupBy("source", "class").agg(F.sum("n").alias("n"))
    classes = classes.select("source", "class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("earlier"))
    heads = sums.withColumn("inside", F.coalesce(F.sum("n").over(in_class), F.lit(0)))
    heads = heads.join(classes, ["source", "class"]).join(targets, "source")

    # the head of a group brings its number and targets into the group's window, so that rows need no join on hot keys
    number = (F.col("earlier") + F.col("inside")).alias("start")
    head = F.struct(number, "about")
    place = ["source", "class", "sub", "piece"]
    heads = heads.select(*place, head.alias("head"), F.lit(0).cast("bigint").alias("n"))
    stretch = Window.partitionBy(*place).orderBy(F.asc_nulls_first("key"), "kept").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        pieces.unionByName(heads, allowMissingColumns=True)
        .withColumn("first", F.sum("n").over(stretch) - F.col("n"))
        .withColumn("head", F.first("head", ignorenulls=True).over(stretch))
        .where(F.col("n") > 0)
        .select("kept", "size", "head.about", (F.col("head.start") + F.col("first")).alias("first"), "n")
        .withColumn("no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    )
    crossed = F.expr(f"(no * about.each + about.each + about.offset) div {UNIT} - (no * about.each + about.offset) div {UNIT}")
    return placed.withColumn("copies", crossed).select(
        *[F.col(f"kept.`{c}`") for c in keep],
        "size",
        "about.source_size",
        "about.target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, numbered from 1 in ``copy``."""
    taken = mixed.where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
