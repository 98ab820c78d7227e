"""The register of queries: how each one is built and, where SQL can say it, its twin."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runscope.plans.settle import ensure_checkpoint_dir

from .bindings import AS_OF, EVENTS_AS_OF, ORDERS_AS_OF, table, twin

ORDERS_DAYS = 365
LOAD_DAYS = 60
EVENTS_DAYS = 30

Get = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Callable[[Get], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(self.build(lambda name: table(spark, sf_dir, name)))


REGISTER: dict[str, Query] = {}


def query(name: str, tables: list[str] | None = None, sql: str | None = None) -> Callable:
    """Registers a builder taking a table getter; ``sql`` reads the tables named."""

    def add(build: Callable[[Get], DataFrame]) -> Callable[[Get], DataFrame]:
        REGISTER[name] = Query(build, twin(tables or [], sql) if sql else None)
        return build

    return add


def uncut(cte: str) -> str:
    """A table expression that ends in ORDER BY and LIMIT, without them."""
    return re.sub(r"\s+ORDER BY (?:(?!ORDER BY).)* LIMIT \d+\)\Z", ")", cte, flags=re.S)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; where it names none, one of this run."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return ensure_checkpoint_dir(spark, None if named else tempfile.mkdtemp(prefix="checks-"))


def comparable(df: DataFrame) -> DataFrame:
    """Plain types both engines agree on: 64-bit integers, doubles to 4 places, arrays as joined text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 4)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), 4)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def rnd(expr: str, digits: int = 4) -> str:
    """Half-up rounding on decimals, as a double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def sec(end: str, start: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1e6)"


def within(column: str, as_of: str, days: int) -> str:
    return f"({column} >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY AND {column} < TIMESTAMP '{as_of}')"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


__all__ = [
    "AS_OF",
    "EVENTS_AS_OF",
    "EVENTS_DAYS",
    "Get",
    "LOAD_DAYS",
    "ORDERS_AS_OF",
    "ORDERS_DAYS",
    "REGISTER",
    "big",
    "checkpoint_folder",
    "query",
    "rnd",
    "sec",
    "uncut",
    "within",
]
