"""Approximate percentiles and distinct counts from sketches that can be stored and merged.

Quantile sketches are KLL, distinct counts HyperLogLog; both are partial aggregates, so a task sends one sketch of bounded
size for each key. The error is chosen by the caller; exact results stay the default of all operators.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column that holds a quantile sketch until its percentiles are taken.
SKETCH = "_sketch"


def quantile_size(error: float) -> int:
    """Smallest size of a KLL sketch whose ranks are within ``error`` (a share of the values) in 99 of 100 cases."""
    if not 0 < error < 1:
        raise ValueError("the rank error is a share between 0 and 1")
    # fixed values: published fit of the rank error of one value, 2.296 / k**0.9021
    return min(65_535, max(8, math.ceil((2.296 / error) ** (1 / 0.9021))))


def distinct_size(error: float) -> int:
    """Smallest binary logarithm of the number of HyperLogLog registers whose relative standard error is ``error``."""
    if not 0 < error < 1:
        raise ValueError("the relative error is a share between 0 and 1")
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))


def quantile_sketch(value: str | Column, error: float) -> Column:
    """Aggregate: a sketch of the values that are not null."""
    column = F.col(value) if isinstance(value, str) else value
    return F.kll_sketch_agg_double(column.cast("double"), F.lit(quantile_size(error)))


def merged_quantiles(sketch: str) -> Column:
    """Aggregate: one sketch from stored ones."""
    return F.kll_merge_agg_double(sketch)


def quantile_of(sketch: str | Column, share: float) -> Column:
    """The value at ``share`` of the ranks; null for a sketch of no values."""
    column = F.col(sketch) if isinstance(sketch, str) else sketch
    found = F.kll_sketch_get_quantile_double(column, F.lit(float(share)))
    return F.when(F.kll_sketch_get_n_double(column) > 0, found)


def sketched(value: str, error: float | None) -> list[Column]:
    """What an operator adds to its aggregates for approximate percentiles: nothing where they are to be exact."""
    return [] if error is None else [quantile_sketch(value, error).alias(SKETCH)]


def distinct_count(value: str | Column, error: float | None = None) -> Column:
    """Aggregate: distinct values, exact unless a relative error is allowed."""
    column = F.col(value) if isinstance(value, str) else value
    if error is None:
        return F.countDistinct(column)
    return F.coalesce(F.hll_sketch_estimate(distinct_sketch(column, error)), F.lit(0).cast("bigint"))


def distinct_sketch(value: str | Column, error: float) -> Column:
    """Aggregate: a sketch of the distinct values that are not null."""
    column = F.col(value) if isinstance(value, str) else value
    return F.hll_sketch_agg(column.cast("string"), F.lit(distinct_size(error)))


def merged_distinct(sketch: str) -> Column:
    """Aggregate: the distinct count over stored sketches of one size."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketch, F.lit(False)))


def percentile_sketches(df: DataFrame, keys: Sequence[str], value: str, error: float) -> DataFrame:
    """``keys`` and a sketch of ``value``, to be stored, for instance for each day, and merged over any range of them."""
    return df.groupBy(*keys).agg(quantile_sketch(value, error).alias(SKETCH))


def percentiles_of(sketches: DataFrame, keys: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """Percentiles for each key over stored sketches."""
    merged = sketches.groupBy(*keys).agg(merged_quantiles(SKETCH).alias(SKETCH))
    return merged.select(*keys, *[quantile_of(SKETCH, p).alias(name) for name, p in wanted.items()])
