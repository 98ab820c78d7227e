"""Building blocks that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sketches import SKETCH, quantile_of

def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join whose hot keys are spread over ``salts`` tasks.

    Rows of ``big`` get a salt from ``salt_by`` (columns that vary within a key, so a re-run task makes the same
    choice), rows of ``small`` are repeated once per salt (a power of two). They are repeated by a join, whose size Spark
    puts at that of both sides multiplied; an explode counts as no larger than its input, and what the driver then
    broadcasts is many times the session threshold. No broadcast is forced: Spark still broadcasts a ``small`` far below
    the threshold. ``how`` may be inner, left, left_semi or left_anti.
    """
    left = big.withColumn("_salt", _one_of(salts, salt_by))
    right = small.crossJoin(F.broadcast(small.sparkSession.range(salts).withColumnRenamed("id", "_salt")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _one_of(parts: int, columns: Sequence[str]) -> Column:
    """0 .. parts - 1 by hash; never null, so that joins on it add no filter below (``parts``: a power of two)."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(parts - 1))


def top_rows(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """Ordered head of ``df`` (all of it when ``n`` is None)."""
    ordered = df.orderBy(*order)
    return ordered if n is None else ordered.limit(n)


# monotonic log-scale slot of the number _v, never null: 0.0125 % wide, so that even the slot of a day in microseconds holds some
# ten million values; some 110 000 slots up to a million
_MAGNITUDE = "coalesce(floor(signum(CAST(_v AS DOUBLE)) * log1p(abs(CAST(_v AS DOUBLE))) * 8000D), 0L)"


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolated percentiles per key, exact, without bringing a key's values together.

    1. Rows are counted per (key, value): partial aggregation, shuffled by both, so a hot key spreads out.
    2. Counts are totalled per log-scale slot; a running total over the slots (bounded in number) shows which slots
       hold the wanted ranks.
    3. Only the values of those slots are ranked.
    ``wanted`` maps output column to fraction. ``weight`` names a column of repeat counts. Null keys are keys like
    others. Inside, a key is one struct: never null, like the slot, so both uses of the counts stay alike, and they are
    shuffled once and reused.
    """
    group = "_key"
    n = f"sum({weight})" if weight else "count(1)"
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.struct(*keys).alias("_key"), F.col(value).alias("_v"))
        .agg(F.expr(f"{n} AS _n"))
        .selectExpr("_key", "_v", "_n", f"{_MAGNITUDE} AS _slot")
    )
    ranks = {f"{up}({p}D * (_total - 1))" for p in wanted.values() for up in ("floor", "ceil")}
    by_slot = f"PARTITION BY {group} ORDER BY _slot ROWS UNBOUNDED PRECEDING"
    slots = (
        counts.groupBy("_key", "_slot")
        .agg(F.expr("sum(_n) AS _slot_n"))
        .selectExpr(
            "_key",
            "_slot",
            "_slot_n",
            f"sum(_slot_n) OVER ({by_slot}) - _slot_n AS _before",
            f"sum(_slot_n) OVER (PARTITION BY {group}) AS _total",
        )
        .where(" OR ".join(f"({r} >= _before AND {r} < _before + _slot_n)" for r in sorted(ranks)))
        .drop("_slot_n")
    )
    in_slot = f"PARTITION BY {group}, _slot ORDER BY _v ROWS UNBOUNDED PRECEDING"
    ranked = counts.join(slots, ["_key", "_slot"]).selectExpr(
        "_key", "_v", "_n", "_total", f"_before + sum(_n) OVER ({in_slot}) - _n AS _first"
    )

    def value_at(rank: str) -> str:
        return f"CAST(max(CASE WHEN {rank} >= _first AND {rank} < _first + _n THEN _v END) AS DOUBLE)"

    marks = []
    for name, p in wanted.items():
        position = f"{p}D * (max(_total) - 1)"
        low, high = (value_at(f"{up}({p}D * (_total - 1))") for up in ("floor", "ceil"))
        marks.append(F.expr(f"{low} + ({high} - {low}) * ({position} - floor({position})) AS `{name}`"))
    return ranked.groupBy("_key").agg(*marks).select(*[F.col(f"_key.`{key}`") for key in keys], *wanted)


def with_percentiles(
    stats: DataFrame, source: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """``stats`` (one row per key, which may be null) with percentiles of ``source.value``, null where it has none."""
    key = F.struct(*keys).alias("_top")
    marks = exact_percentiles(source, keys, value, wanted).select(key, *wanted)
    return stats.select("*", key).join(marks, "_top", "left").drop("_top")


def top_with_percentiles(
    stats: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    order: Sequence[Column],
    limit: int | None,
) -> DataFrame:
    """The first ``limit`` rows of ``stats`` (one row per key) with percentiles of ``source.value`` added, in order.

    The rows are those of the uncut result, cut: null keys count as keys, and a key without values has null
    percentiles. With a limit, rows of other keys are dropped before anything is shuffled for the percentiles: one pass
    for the statistics, one for the percentiles. How the top rows are joined is left to Spark. All columns of
    ``stats`` take part in the order (after the keys they no longer matter), so both uses of the top rows need the same
    statistics and Spark computes them once.
    """
    keys = list(keys)
    if SKETCH in stats.columns:
        marks = {name: quantile_of(SKETCH, p) for name, p in wanted.items()}
        return top_rows(stats, order, limit).withColumns(marks).drop(SKETCH)
    if limit is None:
        return with_percentiles(stats, source, keys, value, wanted).orderBy(*order)
    rest = [F.asc(c) for c in stats.columns if c not in keys]
    top = stats.orderBy(*order, *rest).limit(limit)
    key = F.struct(*keys).alias("_top")
    kept = source.select("*", key).join(top.select(key), "_top", "left_semi")
    return with_percentiles(top, kept, keys, value, wanted).orderBy(*order)


def sliced_gaps(df: DataFrame, key: str, ts: str, slice_seconds: int = 3600) -> DataFrame:
    """Seconds from each row to the one before it with the same key, for all rows but a key's first.

    A key is cut into time slices: gaps inside a slice come from a window over (key, slice), gaps across slices from
    the first and last time of each slice. No key is ever sorted in one task; the second window sees one row per
    slice.
    """
    sliced = df.select(key, ts).withColumn("_slice", F.floor(F.unix_seconds(ts) / F.lit(slice_seconds)))
    order = Window.partitionBy(key, "_slice").orderBy(ts)
    inside = sliced.select(key, F.col(ts).alias("_ts"), F.lag(ts).over(order).alias("_prev"))
    edges = sliced.groupBy(key, "_slice").agg(F.min(ts).alias("_ts"), F.max(ts).alias("_last"))
    across = edges.select(
        key, "_ts", F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_prev")
    )
    micros = F.unix_micros("_ts") - F.unix_micros("_prev")
    return (
        inside.unionByName(across)
        .where(F.col("_prev").isNotNull())
        .select(key, (micros / F.lit(1_000_000.0)).alias("gap_seconds"))
    )


def interval_load(spans: DataFrame, window_start: Column, window_end: Column, window_days: int) -> DataFrame:
    """How many closed intervals cover each of their starts and ends inside the window.

    ``spans`` has columns start, end (null: still open) and counted. Starts and ends of all rows are time points;
    only rows that are counted, and start inside the window, add to the load. Instead of joining points with
    intervals, each row gives one event at its start and one at its end. The window is cut into at most 100 000
    slices; what is open at the start of each slice is a running total over the slices (one small row each), the rest
    a running total inside the slice.
    """
    slice_seconds = max(60, -(-window_days * 86_400 // 100_000))
    inside = {c: F.coalesce((F.col(c) >= window_start) & (F.col(c) < window_end), F.lit(False)) for c in ("start", "end")}
    adds = "CAST(counted AND starts_inside AND (`end` IS NULL OR `end` >= start) AS BIGINT)"
    events = (
        spans.withColumns({"starts_inside": inside["start"], "ends_inside": inside["end"]})
        .selectExpr(
            f"""inline(array(
                CASE WHEN starts_inside THEN named_struct('t', start, 'opened', {adds}, 'closed', 0L) END,
                CASE WHEN ends_inside THEN named_struct('t', `end`, 'opened', 0L, 'closed', {adds}) END))"""
        )
        .where("t IS NOT NULL")
    )
    moments = (
        events.groupBy("t")
        .agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))
        .withColumn("slice", F.expr(f"coalesce(floor(unix_seconds(t) / {slice_seconds}), 0L)"))
    )
    before = "ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    carried = (
        moments.groupBy("slice")
        .agg(F.expr("sum(opened - closed) AS net"))
        .selectExpr("slice", f"coalesce(sum(net) OVER ({before}), 0L) AS carried")
    )
    so_far = "PARTITION BY slice ORDER BY t ROWS UNBOUNDED PRECEDING"
    return moments.join(F.broadcast(carried), "slice").selectExpr(
        "t", f"carried + sum(opened) OVER ({so_far}) - sum(closed) OVER ({so_far}) + closed AS load"
    )


def with_previous(df: DataFrame, key: str, ts: str, value: str, into: str, slice_seconds: int = 86_400) -> DataFrame:
    """Adds ``into``: ``value`` of the row before (same key, by ``ts``), null for a key's first row.

    Works in time slices like ``sliced_gaps``; the first row of each slice gets the last value of the slice before. Rows
    of one time are taken in the order of ``value``.
    """
    sliced = df.withColumn("_slice", F.floor(F.unix_seconds(ts) / F.lit(slice_seconds)))
    order = Window.partitionBy(key, "_slice").orderBy(ts, value)
    inside = sliced.withColumn("_no", F.row_number().over(order)).withColumn(into, F.lag(value).over(order))
    last = sliced.groupBy(key, "_slice").agg(F.max_by(F.struct(value), F.struct(ts, value))[value].alias("_last"))
    before = last.select(key, "_slice", F.lag("_last").over(Window.partitionBy(key).orderBy("_slice")).alias("_before"))
    first = inside.where(F.col("_no") == 1).drop(into)
    first = first.join(before.withColumnRenamed("_before", into), [key, "_slice"], "left")
    rest = inside.where(F.col("_no") > 1)
    return first.select(*rest.columns).unionByName(rest).drop("_slice", "_no")


def with_row_numbers(df: DataFrame, by: Sequence[str], into: str, buckets: int = 1024) -> DataFrame:
    """Adds dense numbers 1..n without a global sort; ``by`` identifies a row, so a re-run gives the same numbers.

    ``buckets``: a power of two, 65536 at most, as there is a small row for each in every task.
    """
    if buckets > 65_536:
        raise ValueError("too many buckets")
    bucketed = df.withColumn("_bucket", _one_of(buckets, by))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*by))
    # at most ``buckets`` offsets, so the broadcast is bounded
    return (
        bucketed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(into, F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_place", "_offset")
    )
