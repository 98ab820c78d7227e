"""Shared by the operators on texts: Arrow batches in, Arrow batches out, and the shared working folder."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text handed to a function at once; a longer text is handed over alone.
PIECE_BYTES = 4 << 20

_SPACE = "\x20\x09-\x0d"
#: What ``str.split`` takes for white space besides those six.
_ODD = [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD)) + "]")
_WORDS = re.compile(f"[^{_SPACE}]+")


def words_of(text: str) -> list[str]:
    """Runs without the six ASCII white-space characters (``str.split`` splits at more)."""
    return _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()


def importable_on_workers(spark: SparkSession) -> None:
    """Local sessions find this package wherever Python was started; a cluster gets it with its job."""
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if top not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([top, *paths])


def small_pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes in a text column (or a single row)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    added: str | T.StructType,
    setup: Callable[[], Callable[[list], list]],
) -> DataFrame:
    """``keep`` columns of ``docs`` and the ``added`` ones, computed from ``text`` without a shuffle.

    ``setup`` runs once for each task and returns a function from a list of texts (None where null) to one sequence
    for each added column. A kept column with the name of an added one gives way to it. Pieces of the input are small
    whatever the batch size, so a worker holds a few megabytes of text or one long text.
    """
    added = T._parse_datatype_string(added) if isinstance(added, str) else added
    keep = [c for c in keep if c not in added.fieldNames()]
    taken = {*keep}
    name = next(n for n in ("_text", *(f"_text{i}" for i in range(len(keep) + 1))) if n not in taken)
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(name))
    schema = T.StructType([*(frame.schema[c] for c in keep), *added.fields])
    into = to_arrow_schema(schema)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for piece in small_pieces(batch, k):
                columns = work(piece.column(k).to_pylist())
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(into)[k:], strict=True)]
                kept = [piece.column(i).cast(into.field(i).type) for i in range(k)]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=into.names)

    importable_on_workers(docs.sparkSession)
    return frame.mapInArrow(run, schema)


def without(columns: Sequence[str], *names: str) -> list[str]:
    return [c for c in columns if c not in names]


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may lack that setting; it gets a folder on its only machine.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        top = "file://" + tempfile.mkdtemp(prefix="llm-")
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)
