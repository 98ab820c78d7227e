"""Listing a folder tree in tasks: folders are rows, and are listed in rounds until no folder is left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settle import settled


def list_tree(spark: SparkSession, folder: str, *, budget: int = 20_000, tasks: int = 64) -> DataFrame:
    """path (relative to ``folder``) and size_bytes of all files below it, whatever their names begin with.

    Each round a task walks down from the folders it was dealt and leaves the folders that it has not reached after
    ``budget`` entries to the next round, where they are dealt anew over ``tasks`` tasks. So a deep or lopsided tree spreads
    out, a small one takes one round, and the driver sees only whether folders are left. A task holds the entries of one
    folder at a time. Rounds are stored in the checkpoint folder.

    Folders that vanish meanwhile are passed over, like links to folders on a local disk and its checksum files. File
    systems that Arrow cannot open are listed by the driver, through Hadoop's iterator.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(top).toUri().toString().rstrip("/") or "/"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    try:
        opened, root = arrow_fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _by_driver(spark, folder)
    if opened.get_file_info(root).type != arrow_fs.FileType.Directory:
        raise FileNotFoundError(folder)

    walk = _walker(uri, budget)
    frontier = spark.createDataFrame([("",)], "folder string")
    found = None
    while True:
        level = settled(frontier.mapInArrow(walk, "path string, size_bytes bigint, is_folder boolean"))
        files = level.where("NOT is_folder").select("path", "size_bytes")
        found = files if found is None else found.unionByName(files)
        folders = level.where("is_folder").select(F.col("path").alias("folder"))
        if folders.isEmpty():
            return found
        frontier = folders.repartition(tasks, "folder")


def _walker(uri: str, budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that runs in tasks. It names nothing of this module, so workers need not import it."""

    def walk(batches):
        import os

        import pyarrow
        from pyarrow import fs

        opened, root = fs.FileSystem.from_uri(uri)
        root = root.rstrip("/")
        local = isinstance(opened, fs.LocalFileSystem)

        def entries(folder):
            selector = fs.FileSelector(f"{root}/{folder}" if folder else root or "/", allow_not_found=True)
            for info in opened.get_file_info(selector):
                path = f"{folder}/{info.base_name}" if folder else info.base_name
                if info.type == fs.FileType.Directory:
                    if not (local and os.path.islink(info.path)):
                        yield path, None, True
                elif not (local and info.base_name.startswith(".") and info.base_name.endswith(".crc")):
                    yield path, info.size, False

        def rows(batch):
            for start in batch.column(0).to_pylist():
                todo, seen = [start], 0
                while todo:
                    here = todo.pop()
                    if seen >= budget:
                        yield here, None, True
                        continue
                    for path, size, is_folder in entries(here):
                        seen += 1
                        if is_folder:
                            todo.append(path)
                        else:
                            yield path, size, False

        def made(held):
            path, size, is_folder = zip(*held)
            columns = [pyarrow.array(path, "string"), pyarrow.array(size, "int64"), pyarrow.array(is_folder, "bool")]
            return pyarrow.RecordBatch.from_arrays(columns, names=["path", "size_bytes", "is_folder"])

        held = []
        for batch in batches:
            for row in rows(batch):
                held.append(row)
                if len(held) == 8192:
                    yield made(held)
                    held = []
        if held:
            yield made(held)

    return walk


def _by_driver(spark: SparkSession, folder: str) -> DataFrame:
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(top).toString().rstrip("/") + "/"
    files, rows = system.listFiles(top, True), []
    while files.hasNext():
        status = files.next()
        rows.append((status.getPath().toString().removeprefix(root), status.getLen()))
    return spark.createDataFrame(rows, "path string, size_bytes bigint")
