"""Approximate nearest neighbours by balanced posting lists.

Centroids of about equal lists are fitted on a bounded sample and kept in memory as a graph. Every vector goes to the
list of its nearest centroid and, if it lies near a boundary, to further lists in other directions. A query searches
the graph for the centroids not much further than its nearest one, and is compared exactly with their lists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import importable_on_workers, shared_folder, written


@dataclass(frozen=True)
class Fit:
    """Size of the index and the ratios of the search.

    At most ``lists`` centroids, and no more than fit ``index_bytes`` as 32-bit numbers; ``sample`` vectors for each
    of them are brought to the driver. A list has about ``target`` vectors until ``lists`` is reached, and grows with
    the table from then on; it is searched in blocks.
    """

    target: int = 128
    lists: int = 2048
    index_bytes: int = 16 << 20
    sample: int = 8
    rounds: int = 8
    degree: int = 16
    copies: int = 4  # lists a boundary vector may be in
    boundary: float = 1.10  # centroids up to this ratio of the nearest one's distance take a copy
    probe: float = 1.28  # lists up to this ratio of the nearest centroid's distance are searched
    block: int = 4096  # vectors of a list, and queries of a list, that meet in one task
    seed: int = 5


@dataclass
class Index:
    """Centroids, the graph on them (rows of neighbours), and the centroids where a search begins."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = (x**2).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids**2).sum(axis=1)[None, :]
    return np.maximum(out, 0)


def fit_index(vectors: np.ndarray, lists: int, fit: Fit = Fit()) -> Index:
    """Balanced k-means on a sample: a centroid pays for the size of its cluster, so crowded ones give members away."""
    rng = np.random.default_rng(fit.seed)
    x = np.asarray(vectors, np.float64)
    lists = max(1, min(lists, len(x)))
    centroids = x[rng.choice(len(x), lists, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    fine = np.zeros(lists)
    for _ in range(fit.rounds if len(x) else 0):
        label, near = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):
            d = _squared(x[at : at + 4096], centroids)
            label[at : at + 4096] = (d + fine).argmin(axis=1)
            near[at : at + 4096] = d.min(axis=1)
        size = np.bincount(label, minlength=lists)
        fine = 0.5 * fine + 0.1 * near.mean() * np.clip(size * lists / len(x) - 1, -1, 4)
        order = np.argsort(label, kind="stable")
        some = np.flatnonzero(size)
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[some], axis=0)
        centroids[some] = sums / size[some, None]
        empty = np.flatnonzero(size == 0)
        centroids[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    degree = min(fit.degree, lists - 1)
    between = _squared(centroids, centroids)
    np.fill_diagonal(between, np.inf)
    near = np.argpartition(between, degree - 1, axis=1)[:, :degree] if degree else np.zeros((lists, 0), np.int64)
    linked: list[set] = [set(row) for row in near.tolist()]
    for a, row in enumerate(near.tolist()):
        for b in row:
            linked[b].add(a)
    width = max(map(len, linked))
    neighbours = np.array([[*sorted(s), *[a] * (width - len(s))] for a, s in enumerate(linked)], np.int64).reshape(lists, width)
    entries = rng.choice(lists, min(lists, max(4, int(lists**0.5))), replace=False)
    return Index(centroids, neighbours, entries)


def search_graph(index: Index, queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, centroid, distance) of the centroids within ``ratio`` of the nearest found, by query, nearest first.

    All queries walk together. A round looks at the neighbours of every centroid that is within the ratio and has not
    been left yet, until there is none: no limit is set on how many are found.
    """
    n, lists = len(queries), len(index.centroids)
    distance = np.full((n, lists), np.inf)
    left = np.zeros((n, lists), bool)
    best = np.full(n, np.inf)

    def look(q: np.ndarray, c: np.ndarray) -> None:
        for at in range(0, len(q), 65_536):
            qa, ca = q[at : at + 65_536], c[at : at + 65_536]
            d = np.sqrt(((queries[qa] - index.centroids[ca]) ** 2).sum(axis=1))
            distance[qa, ca] = d
            np.minimum.at(best, qa, d)

    look(np.repeat(np.arange(n), len(index.entries)), np.tile(index.entries, n))
    while True:
        q, c = np.nonzero((distance <= best[:, None] * ratio) & ~left)
        if not len(q):
            break
        left[q, c] = True
        new = np.zeros((n, lists), bool)
        new[np.repeat(q, index.neighbours.shape[1]), index.neighbours[c].ravel()] = True
        look(*np.nonzero(new & np.isinf(distance)))
    q, c = np.nonzero(distance <= best[:, None] * ratio)
    d = distance[q, c]
    order = np.lexsort((c, d, q))
    return q[order], c[order], d[order]


def boundary_lists(index: Index, vectors: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(vector, list): the nearest centroid's, and those of boundary centroids in other directions.

    A further centroid is passed over if one already taken is nearer to it than the vector is.
    """
    q, c, d = search_graph(index, vectors, fit.boundary)
    rows, lists = [], []
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    for start, stop in zip(starts, np.r_[starts[1:], len(q)]):
        taken: list[int] = []
        for i in range(start, stop):
            if taken:
                gap = ((index.centroids[taken] - index.centroids[c[i]]) ** 2).sum(axis=1)
                if gap.min() < d[i] ** 2:
                    continue
            taken.append(int(c[i]))
            if len(taken) == fit.copies:
                break
        rows += [int(q[start])] * len(taken)
        lists += taken
    return np.array(rows, np.int64), np.array(lists, np.int64)


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), np.float64)


def _top(distance: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k smallest distances, ties by ``first``."""
    if len(distance) > k:
        limit = np.partition(distance, k - 1)[k - 1]
        some = np.flatnonzero(distance <= limit)
    else:
        some = np.arange(len(distance))
    return some[np.lexsort((first[some], distance[some]))][:k]


def _shards(index: Index, postings: dict[int, int], probes: dict[int, int], block: int) -> list[tuple[int, int, int, int]]:
    """(list, shard, v, q): lists near each other share a shard of up to ``block`` vectors; a longer list is a shard of
    its own, cut into v blocks. The queries of a shard are cut into q blocks. A row per list."""
    entries = index.entries
    home = _squared(index.centroids, index.centroids[entries])
    order = np.lexsort((home.min(axis=1), home.argmin(axis=1))).tolist()
    shard_of: dict[int, int] = {}
    shard, held = -1, block
    for number in order:
        size = postings.get(number, 0)
        if size and number in probes:
            if held + size > block:
                shard, held = shard + 1, 0
            shard_of[number] = shard
            held += size
    asked: dict[int, int] = {}
    for number, shard in shard_of.items():
        asked[shard] = asked.get(shard, 0) + probes[number]
    return [(n, s, max(1, -(-postings[n] // block)), max(1, -(-asked[s] // block))) for n, s in shard_of.items()]


def _compared(index: Index, probes: DataFrame, postings: DataFrame, k: int, fit: Fit) -> DataFrame:
    """(query_id, vec_id, score): of each block, the k nearest to each query in the lists that it probes there.

    Every block of a shard meets every block of its queries, so a task holds about ``block`` vectors and as many
    probes. What goes on is k rows for each query and block, not for each list.
    """
    spark = probes.sparkSession

    def sizes(df: DataFrame) -> dict[int, int]:
        # bounded: as many rows as there are centroids
        return {r["list"]: r["count"] for r in df.groupBy("list").count().collect()}

    rows = _shards(index, sizes(postings), sizes(probes), fit.block)

    def dealt(df: DataFrame, by: str, own: str, other: str) -> DataFrame:
        shards = F.broadcast(spark.createDataFrame(rows, "list int, shard int, v int, q int"))
        df = df.join(shards, "list").withColumn(f"{own}_no", F.pmod(F.xxhash64(by), F.col(own)).cast("int"))
        return df.withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("v", "q")

    left = dealt(probes, "query_id", "q", "v").groupBy("shard", "v_no", "q_no")
    right = dealt(postings, "ids", "v", "q").groupBy("shard", "v_no", "q_no")

    def nearest(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            vectors = vectors.sort_values("list", kind="stable")
            matrix, ids = _matrix(vectors["vector"]), vectors["ids"].tolist()
            first = np.array([x[0] for x in ids])
            number = vectors["list"].to_numpy()
            for query_id, asked in queries.groupby("query_id", sort=False):
                lists = np.unique(asked["list"].to_numpy())
                ranges = zip(np.searchsorted(number, lists), np.searchsorted(number, lists, side="right"))
                at = np.concatenate([np.arange(a, b) for a, b in ranges])
                query = np.asarray(asked["vector"].iloc[0], np.float64)
                distance = np.sqrt(((matrix[at] - query) ** 2).sum(axis=1))
                best = _top(distance, first[at], (k + 1) * fit.copies)
                # a vector that is in several of the lists counts once
                found = {int(x): distance[i] for i in best.tolist() for x in ids[at[i]] if x != query_id}
                for score, vec_id in sorted((d, x) for x, d in found.items())[:k]:
                    out["query_id"].append(query_id)
                    out["vec_id"].append(vec_id)
                    out["score"].append(score)
        return pd.DataFrame(out)

    return left.cogroup(right).applyInPandas(nearest, "query_id bigint, vec_id bigint, score double")


def nearest_neighbours(
    embeddings: DataFrame,
    queries: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    fit: Fit = Fit(),
    folder: str | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found to each row that ``queries`` selects.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. Rows with a null id, or a
    vector that is null, zero or holds null or non-finite components, take no part; nor do vectors whose length is not
    the commonest in the sample. Equal vectors are put together first: of each vector the k + 1 smallest ids are kept,
    which is all that a list of k neighbours can show, so a vector that fills much of the table costs one row.
    A query's own id is never returned, repeated rows of an id count as one, and an empty table gives an empty one.
    A query whose lists hold fewer than k others is compared with all lists. Intermediate tables are stored in
    ``folder`` (by default below ``spark.checkpoint.dir``).
    """
    spark = embeddings.sparkSession
    importable_on_workers(spark)
    folder = folder or shared_folder(spark)
    rows = embeddings.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("vector"), queries.alias("asked")
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    kind = rows.schema["vector"].dataType.simpleString()

    # the limit on ranks takes effect in each task before the shuffle and again after it
    smallest = Window.partitionBy("vector").orderBy("id")
    few = rows.select("id", "vector").withColumn("n", F.dense_rank().over(smallest)).where(F.col("n") <= k + 1)
    vectors = written(few.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")), f"{folder}/vectors")
    asked = written(
        rows.where(F.coalesce("asked", F.lit(False))).select(F.col("id").alias("query_id"), "vector"), f"{folder}/asked"
    )

    n = vectors.count()
    if n == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    widest = vectors.agg(F.max(F.size("vector"))).first()[0]
    lists = max(1, min(fit.lists, -(-n // fit.target), fit.index_bytes // (4 * widest)))
    wanted = fit.sample * lists
    share = min(1.0, 1.25 * wanted / n)
    chosen = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))
    sampled = [r[0] for r in vectors.where(chosen).select("vector").limit(2 * wanted).collect()]
    if not sampled:
        sampled = [r[0] for r in vectors.select("vector").limit(wanted).collect()]
    sizes = pd.Series([len(v) for v in sampled]).value_counts()
    length = int(sizes.index[sizes == sizes.max()].min())
    index = fit_index(np.array([v for v in sampled if len(v) == length], np.float64), lists, fit)
    vectors, asked = (df.where(F.size("vector") == length) for df in (vectors, asked))

    def searched(choose, names: Sequence[str]):
        """A row for each list chosen for a row; ``names`` are the columns, the vector last."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    row, which = choose(_matrix(part.column(len(names) - 1)))
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(which, pa.int32())], names=[*names, "list"])

        return run

    to_lists = searched(lambda x: boundary_lists(index, x, fit), ["ids", "vector"])
    postings = written(
        vectors.select("ids", "vector").mapInArrow(to_lists, f"ids array<bigint>, vector {kind}, list int"),
        f"{folder}/postings",
    )
    probing = searched(lambda x: search_graph(index, x, fit.probe)[:2], ["query_id", "vector"])
    probes = written(asked.mapInArrow(probing, f"query_id bigint, vector {kind}, list int"), f"{folder}/probes")
    found = written(_compared(index, probes, postings, k, fit), f"{folder}/found")

    # exact way for queries whose lists were too short
    counts = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    reach = min(k, n - 1) if n <= k else k
    short = asked.join(counts.where(F.col("n") >= reach).select("query_id"), "query_id", "left_anti")
    short = written(short, f"{folder}/short")
    if short.limit(1).count():
        every = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(index.centroids) - 1))))
        found = found.unionByName(_compared(index, every, postings, k, fit))

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
