"""Hard negatives for anchors, read from blocks of candidates that lie along a Hilbert curve.

Candidates are stored as Parquet in the order of label and place on the curve, cut into blocks of neighbours; a block keeps
the least and the greatest value of each dimension. Interval arithmetic on these gives bounds for the scores in a block,
and only blocks that can still hold a row for one of an anchor's windows are read. Bounds are exact, so nothing is lost:
vectors without any order among them make every block worth reading, clustered ones leave most blocks out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable_on_workers, shared_folder, written

#: Scaled components beyond this count as this, so that scores and their windows fit 64 bits.
LARGEST = 1 << 22
_LOW, _HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Layout:
    """``block`` rows are bounded together, and a folder holds about ``folder`` rows, but there are no more than
    ``folders`` of them. Up to ``anchors`` anchors meet a block in one task, and ``cell`` anchors and as many blocks when
    blocks are chosen. ``seeds`` blocks are read first, so that their scores can rule out others. A place on the curve
    has ``bits`` bits over all dimensions, at most eight each."""

    block: int = 1024
    folder: int = 16_384
    folders: int = 4096
    anchors: int = 512
    cell: int = 2048
    seeds: int = 2
    bits: int = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places along the Hilbert curve through a grid of 2**bits cells in each dimension, as bytes that sort like them.

    The transposed place is found bit by bit by reflections and exchanges of axes (Skilling's construction) for all rows at
    once; its bits, the highest of every dimension first, are the place.
    """
    x = cells.astype(np.int64).T.copy()  # a row for each dimension
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for axis in x:
            turned = (axis >> b) & 1
            swap = (x[0] ^ axis) & low & (turned - 1)
            x[0] ^= swap | (low & -turned)
            if axis is not x[0]:
                axis ^= swap
    np.bitwise_xor.accumulate(x, axis=0, out=x)
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= ((1 << b) - 1) & -((x[-1] >> b) & 1)
    x ^= turn
    planes = (x[None, :, :] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # bit, dimension, row
    packed = np.packbits(planes.reshape(-1, x.shape[1]).astype(np.uint8), axis=0)
    return [row.tobytes() for row in np.ascontiguousarray(packed.T)]


def _padded(vectors: pa.Array, width: int) -> np.ndarray:
    """One row for each list, zeros after its end."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def _matrix(packed, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i4").reshape(-1, width).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact: in floating point where every partial sum is a whole number below 2**53."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with any vector of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def best_rows(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest scores of each row among those that fit, ties to the smaller id."""
    held = np.where(fits, scores, _LOW - 1)
    if held.shape[1] > k:
        least = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        fits = fits & (held >= least[:, None])
    row, column = np.nonzero(fits)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    number = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
    return row[number < k], column[number < k]


class Table:
    """Candidates in blocks, and the anchors, stored below ``folder``."""

    def __init__(self, rows: DataFrame, layout: Layout, folder: str):
        """``rows``: vec_id, label, vector (whole numbers), asked; one row for each vec_id, nothing null."""
        self.layout, self.folder, self.spark = layout, folder, rows.sparkSession
        rows = written(rows, f"{folder}/rows")
        spread = rows.mapInArrow(_extremes, "pos int, low int, high int").groupBy("pos")
        # a row for each dimension
        sides = spread.agg(F.min("low"), F.max("high")).orderBy("pos").collect()
        self.n = rows.count()
        self.width = max(1, len(sides))
        keyed = written(rows.mapInArrow(_with_keys(sides, layout), f"{_ROW}, key binary, packed binary"), f"{folder}/keyed")
        self.blocks_path = f"{folder}/blocks"
        parts = max(1, min(layout.folders, -(-self.n // layout.folder)))
        order = ["label", "key", "vec_id"]
        along = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("vec_id", "label", "packed")
        cut = along.mapInArrow(_cut(layout.block, self.width), _BLOCK)
        cut.write.partitionBy("zone").parquet(self.blocks_path)
        self.blocks = self.spark.read.schema(cut.schema).parquet(self.blocks_path)
        asked = keyed.where("asked")
        self.n_anchors, self.n_blocks = asked.count(), self.blocks.count()
        order = ["key", "vec_id"]
        parts = max(1, -(-self.n_anchors // (4 * layout.anchors)))
        lined = asked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.anchors = written(
            lined.select("vec_id", "label", "packed").mapInArrow(
                _numbered(layout.anchors), "anchor_id bigint, label bigint, packed binary, shard bigint"
            ),
            f"{folder}/anchors",
        )

    def chosen(self, anchors: DataFrame, same: bool, seeds: bool) -> DataFrame:
        """(anchor_id, shard, zone, block): the blocks worth reading for an anchor; with ``seeds`` the first few of them, without
        it the rest.

        ``anchors`` have windows of scores (``lows``, ``highs``) and what they have found so far (``floors``). A block is
        worth reading if it may hold a row of the same label, or of another one, with a score in a window and not below its
        floor. Anchors meet the bounds of all blocks, without their rows, in cells of bounded size.
        """
        layout, width = self.layout, self.width
        a, z = -(-self.n_anchors // layout.cell), -(-self.n_blocks // layout.cell)

        def dealt(df: DataFrame, by: str, own: str, parts: int, other: str, others: int) -> DataFrame:
            df = df.withColumn(own, F.pmod(F.xxhash64(by), F.lit(max(1, parts))))
            return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(max(0, others - 1)))))

        left = dealt(anchors, "anchor_id", "a", a, "z", z).groupBy("a", "z")
        sides = self.blocks.select("zone", "block", "label_low", "label_high", "low", "high")
        right = dealt(sides, "block", "z", z, "a", a).groupBy("a", "z")

        def choose(asks: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
            if not len(asks) or not len(boxes):
                return pd.DataFrame({"anchor_id": [], "shard": [], "zone": [], "block": []})
            boxes = boxes.sort_values("block")
            least, most = bounds(_matrix(asks["packed"], width), _matrix(boxes["low"], width), _matrix(boxes["high"], width))
            label = asks["label"].to_numpy()[:, None]
            first, last = boxes["label_low"].to_numpy()[None, :], boxes["label_high"].to_numpy()[None, :]
            allowed = (first <= label) & (label <= last) if same else (first != last) | (first != label)
            held = least + most
            open_, worth = np.zeros_like(allowed), np.zeros_like(allowed)
            for low, high, floor in _windows(asks):
                inside = allowed & (most >= low[:, None]) & (least <= high[:, None]) & (low <= high)[:, None]
                open_ |= inside
                worth |= inside & (most >= floor[:, None])
            begun = np.zeros_like(allowed)
            begun[best_rows(held, open_, boxes["block"].to_numpy(), layout.seeds)] = True
            row, column = np.nonzero(begun if seeds else worth & ~begun)
            picked = asks.iloc[row][["anchor_id", "shard"]].reset_index(drop=True)
            taken = boxes.iloc[column][["zone", "block"]].reset_index(drop=True)
            return pd.concat([picked, taken], axis=1)

        return left.cogroup(right).applyInPandas(choose, "anchor_id bigint, shard bigint, zone int, block bigint")

    def read(self, anchors: DataFrame, pairs: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, no, vec_id, score): of each block read for an anchor, its k best rows in each of its windows."""
        width = self.width
        # bounded: one number for each folder
        zones = [r[0] for r in pairs.select("zone").distinct().collect()]
        wanted = self.blocks.where(F.col("zone").isin(zones) if zones else F.lit(False))
        wanted = wanted.select("block", "ids", "labels", "matrix")
        right = wanted.join(pairs.select("block", "shard").distinct(), "block").groupBy("block", "shard")
        left = anchors.join(pairs.select("anchor_id", "block"), "anchor_id").groupBy("block", "shard")

        def compare(asks: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asks) and len(block):
                ids = np.concatenate([np.asarray(x, np.int64) for x in block["ids"]])
                labels = np.concatenate([np.asarray(x, np.int64) for x in block["labels"]])
                scores = products(_matrix(asks["packed"], width), _matrix(block["matrix"], width))
                own = asks["anchor_id"].to_numpy()
                fits = (labels[None, :] == asks["label"].to_numpy()[:, None]) == same
                fits &= ids[None, :] != own[:, None]
                for no, (low, high, floor) in enumerate(_windows(asks)):
                    start = np.maximum(low, floor)[:, None]
                    row, column = best_rows(scores, fits & (scores >= start) & (scores <= high[:, None]), ids, k)
                    out.append(
                        pd.DataFrame(
                            {"anchor_id": own[row], "no": no, "vec_id": ids[column], "score": scores[row, column]}
                        )
                    )
            return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "no": [], "vec_id": [], "score": []})

        return left.cogroup(right).applyInPandas(compare, "anchor_id bigint, no int, vec_id bigint, score bigint")

    def best(self, windows: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(anchor_id, no, rank, vec_id, score): the k best rows of each window of ``windows`` (anchor_id, lows, highs)."""
        anchors = self.anchors.join(windows, "anchor_id").withColumn("floors", F.col("lows"))
        anchors = written(anchors, f"{self.folder}/{name}-asks")
        pairs = written(self.chosen(anchors, same, seeds=True), f"{self.folder}/{name}-seeds")
        some = written(self.read(anchors, pairs, same, k), f"{self.folder}/{name}-first")

        in_window = Window.partitionBy("anchor_id", "no").orderBy(F.desc("score"), "vec_id")
        full = some.withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") == k)
        floors = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("no", "score"))).alias("known"))
        raised = F.transform("lows", lambda low, no: F.coalesce(F.element_at("known", no), low))
        anchors = written(
            anchors.drop("floors").join(floors, "anchor_id", "left").withColumn("floors", raised).drop("known"),
            f"{self.folder}/{name}-floors",
        )
        rest = written(self.chosen(anchors, same, seeds=False), f"{self.folder}/{name}-rest")
        more = written(self.read(anchors, rest, same, k), f"{self.folder}/{name}-more")
        ranked = some.unionByName(more).withColumn("rank", F.row_number().over(in_window)).where(F.col("rank") <= k)
        return written(ranked.select("anchor_id", "no", "rank", "vec_id", "score"), f"{self.folder}/{name}")


_ROW = "vec_id bigint, label bigint, asked boolean"
_BLOCK = (
    "zone int, block bigint, label_low bigint, label_high bigint, low binary, high binary, "
    "ids array<bigint>, labels array<bigint>, matrix binary"
)


def _windows(asks: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Low, high and floor of the first window of all anchors, then of the second, ...; an empty window where one has no more."""
    columns = []
    count = max(map(len, asks["lows"]))
    for name, missing in (("lows", 1), ("highs", 0), ("floors", 1)):
        columns.append(np.array([[*x, *[missing] * (count - len(x))] for x in asks[name]], np.int64).reshape(-1, count))
    for no in range(count):
        yield columns[0][:, no], columns[1][:, no], columns[2][:, no]


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = high = np.empty(0, np.int64)
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("vector"))
        width = max(len(low), int(np.diff(vectors.offsets.to_numpy()).max(initial=0)))
        x = _padded(vectors, width)
        blank = np.zeros(width - len(low), np.int64)
        low, high = np.r_[low, blank], np.r_[high, blank]
        if len(x) and width:
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
    columns = [np.arange(len(low)), low, high]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["pos", "low", "high"])


def _with_keys(sides: list, layout: Layout) -> Callable:
    """Adds the place on the curve, over the dimensions of the widest ranges if there are more than bits."""
    low, high = np.array([r[1] for r in sides] or [0]), np.array([r[2] for r in sides] or [0])
    used = np.argsort(low - high, kind="stable")[: layout.bits]
    bits = max(1, min(8, layout.bits // len(used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, label, vector, asked = batch.columns
            x = _padded(vector, len(low))
            cells = ((x - low)[:, used] << bits) // (high - low + 1)[used]
            keys = pa.array(hilbert_keys(cells, bits), pa.binary())
            packed = pa.array([_packed(row) for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [vec_id, label, asked, keys, packed], names=["vec_id", "label", "asked", "key", "packed"]
            )

    return run


def _cut(size: int, width: int) -> Callable:
    """Rows in order to blocks of ``size`` of them."""

    def made(zone: int, number: int, ids: list, labels: list, packed: list) -> pa.RecordBatch:
        x = _matrix(packed, width)
        values = [zone, zone << 32 | number, min(labels), max(labels), _packed(x.min(axis=0)), _packed(x.max(axis=0))]
        fields = ["zone", "block", "label_low", "label_high", "low", "high", "ids", "labels", "matrix"]
        kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 2, *[pa.list_(pa.int64())] * 2, pa.binary()]
        rows = [*values, ids, labels, b"".join(packed)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(rows, kinds)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        zone, number = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list] = [], [], []
        for batch in batches:
            for column, values in zip(held, batch.columns):
                column.extend(values.to_pylist())
            while len(held[0]) >= size:
                yield made(zone, number, *[c[:size] for c in held])
                held, number = tuple(c[size:] for c in held), number + 1
        if held[0]:
            yield made(zone, number, *held)

    return run


def _numbered(size: int) -> Callable:
    """Anchors in order, ``size`` of them with one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        seen = 0
        for batch in batches:
            shard = first + (seen + np.arange(batch.num_rows)) // size
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=["anchor_id", "label", "packed", "shard"])

    return run


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    limit = F.lit(float(LARGEST))
    return F.transform(
        vector, lambda x: F.greatest(-limit, F.least(limit, F.floor(x.cast("double") * scale).cast("double"))).cast("int")
    )


def hard_negatives(
    embeddings: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    layout: Layout = Layout(),
    folder: str | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for the rows that ``anchors`` selects.

    Components become floor(scale * x); scores are integer inner products, higher first, ties to the smaller id. An anchor's
    positives are the ``positives`` best other rows of its label; for each of them, the ``negatives`` best rows of other
    labels are returned whose score is ``low`` to ``high`` percent of the positive's (no score is, if that is negative).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Labels are whole numbers. Rows
    of one id count once, as the least by label, then vector. A vector shorter than the longest goes on with zeros; scaled
    components beyond +-2**22 count as that. An empty table, or one without anchors, gives an empty result; an anchor
    without positives or negatives has no rows. The result is exact whatever the layout. Intermediate tables are stored in
    ``folder`` (by default below ``spark.checkpoint.dir``).
    """
    spark = embeddings.sparkSession
    importable_on_workers(spark)
    folder = folder or shared_folder(spark)
    held = F.col(f"`{vector}`")
    finite = F.forall(held, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{label}`").cast("bigint").alias("label"),
        F.when(finite, scaled(held, scale)).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    again = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        one = F.min(F.struct("label", "vector", "asked"))
        rows = rows.groupBy("vec_id").agg(one.alias("row")).select("vec_id", "row.label", "row.vector", "row.asked")
    table = Table(rows, layout, folder)

    every = table.anchors.select(
        "anchor_id", F.array(F.lit(_LOW)).alias("lows"), F.array(F.lit(_HIGH)).alias("highs")
    )
    near = table.best(every, True, positives, "positives").where("score >= 0")
    # at most ``positives`` rows for each anchor; low and high are rounded inwards
    ranked = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")
    near = near.groupBy("anchor_id").agg(ranked)
    near = written(
        near.select(
            "anchor_id",
            "near",
            F.expr(f"transform(near, p -> (p.score * {low} + 99) div 100)").alias("lows"),
            F.expr(f"transform(near, p -> p.score * {high} div 100)").alias("highs"),
        ),
        f"{folder}/windows",
    )
    hard = table.best(near.drop("near"), False, negatives, "negatives")
    positive = F.element_at("near", F.col("no") + 1)
    return hard.join(near.select("anchor_id", "near"), "anchor_id").select(
        "anchor_id",
        positive["vec_id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        positive["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
