"""Text expressions. All of them read the whole text; only ``json_depth`` leaves the JVM side."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def occurrences(text: str | Column, part: str | Column) -> Column:
    """Non-overlapping occurrences of ``part``; a plain string is taken literally."""
    t = _col(text)
    p = F.lit(part) if isinstance(part, str) else part
    removed = F.length(t) - F.length(F.replace(t, p, F.lit("")))
    return (removed / F.length(p)).cast("long")


def first_contained(text: str | Column, labels: list[tuple[str, str]], otherwise: str) -> Column:
    """Label of the first marker found in the text; the order of ``labels`` matters."""
    t = _col(text)
    out = F.lit(otherwise)
    for marker, label in reversed(labels):
        out = F.when(t.contains(marker), F.lit(label)).otherwise(out)
    return out


def shorten_end(text: str | Column, limit: int) -> Column:
    """Keep the head: texts over ``limit`` characters end in ``...``."""
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def shorten_start(text: str | Column, limit: int) -> Column:
    """Keep the tail: texts over ``limit`` characters begin with ``...``."""
    t = _col(text)
    tail = F.right(t, F.lit(limit - 3))
    return F.when(F.length(t) > limit, F.concat(F.lit("..."), tail)).otherwise(t)


def group_list(claim: str | Column) -> Column:
    """``[a, b]`` or ``a`` to an array of names."""
    return F.split(F.translate(_col(claim), "[] ", ""), ",")


def file_extension(path: str | Column) -> Column:
    """Lower-case extension with its dot, or ``no_extension`` (leading dots do not start one)."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    ext = F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)
    return F.when(ext == "", F.lit("no_extension")).otherwise(F.lower(ext))


def connection_parts(url: str | Column, *, default_port: int = 5432, default_database: str = "airflow") -> Column:
    """``scheme://user:password@host:port/database?options`` to a struct; the password is not kept."""
    u = _col(url)
    server = F.regexp_extract(u, r"@([^?]*)", 1)
    host_port = F.split(server, "/")[0]
    database = F.get(F.split(server, "/"), F.lit(1))
    port = F.try_element_at(F.split(host_port, ":"), F.lit(2))
    return F.struct(
        F.regexp_extract(u, r"//([^:@]*)", 1).alias("username"),
        F.split(host_port, ":")[0].alias("host"),
        F.coalesce(port.try_cast("int"), F.lit(default_port)).alias("port"),
        F.coalesce(database, F.lit(default_database)).alias("database"),
    )


_STRICT = {
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "maxNestingDepth": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "maxStringLen": str(2**31 - 1),
}


def json_is_valid(text: str | Column) -> Column:
    """True if the whole text is one JSON value, however deep and with numbers however long.

    The text is put into an object, once as the value of a field and once between brackets, and a last field with its
    hash must be found each time. Of what the first form lets through, one value or a value and further fields, the
    second one takes only the single value. The reader steps over the text itself, so its depth does not matter.
    """
    t = _col(text)
    mark = F.xxhash64(t).cast("string")

    def reads(before: str, after: str) -> Column:
        wrapped = F.concat(F.lit('{"text":' + before), t, F.lit(after + ',"mark":"'), mark, F.lit('"}'))
        return F.from_json(wrapped, "mark string", _STRICT)["mark"] == mark

    return F.coalesce(reads("", "") & reads("[", "]"), F.lit(False))


def json_depth(text: str | Column) -> Column:
    """Deepest nesting of objects and lists in valid JSON; empty ones add no level.

    Escaped characters go first, so a quote left over afterwards always opens or closes a literal. What is left of the
    text in the end are its brackets, whose running total is taken piece by piece.
    """
    escape, literal = re.compile(rb"(?s)\\."), re.compile(rb'"[^"\x00-\x1f]*"')
    opening, closing, white, piece = b"[{", b"]}", b" \t\n\x0b\f\r", 1 << 20
    others = bytes(i for i in range(256) if i not in opening + closing)
    steps = bytes.maketrans(opening + closing, b"\x01\x01\xff\xff")

    def deepest(t: bytes) -> int:
        t = literal.sub(b"s", escape.sub(b"", t) if b"\\" in t else t).translate(None, white)
        t = t.replace(b"{}", b"0").replace(b"[]", b"0").translate(steps, others)
        now = most = 0
        for i in range(0, len(t), piece):
            levels = now + np.cumsum(np.frombuffer(t[i : i + piece], np.int8), dtype=np.int64)
            now, most = int(levels[-1]), max(most, int(levels.max()))
        return most

    # inside this function, so that it reaches the workers by value
    def depths(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else deepest(t) for t in texts.cast(pa.large_binary()).to_pylist()], pa.int32())

    return F.arrow_udf(depths, "int")(_col(text))
