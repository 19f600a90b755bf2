"""File listings made on the executors, hidden names included, and file digests."""

from __future__ import annotations

import datetime
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FILE_ENTRY_DDL
from ..session import materialize

MARKERS = ("zarr.json", ".zmetadata", ".zgroup", ".zattrs")
STORE_MARKERS = ("zarr.json", ".zgroup", ".zmetadata")
CHUNK_ROWS = 10_000
CHUNK_BYTES = 1 << 20
FILES_PER_TASK = 500  # a path is short, what it costs to open is not: small tables of paths are dealt to many tasks
SMALL_FILES_PER_TASK = 2_000  # a task itself costs as much as some hundred small files
FOLDERS_APART = 64  # so many folders are listed by a task each, for a few folders may hold most of the files
MOST_TASKS = 1024
_COLUMNS = ["path", "name", "parent", "kind", "suffix", "byte_size", "modified_at"]


def _entries(directory: str) -> Iterator[tuple[str, str, int, float]]:
    """Name, kind, size and change time of the entries of one directory.

    A directory that cannot be read, or is gone by now, has none. A link to a directory is a
    ``link`` and is not entered; a link to a file stands for the file.
    """
    if "://" not in directory:
        try:
            with os.scandir(directory) as found:
                for entry in found:
                    try:
                        stat = entry.stat()
                        kind = "file" if not entry.is_dir() else "link" if entry.is_symlink() else "directory"
                    except OSError:
                        continue
                    yield entry.name, kind, stat.st_size, stat.st_mtime
        except OSError:
            return
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(directory)
    try:
        infos = store.get_file_info(fs.FileSelector(path, recursive=False))
    except OSError:
        return
    for info in infos:
        kind = "directory" if info.type == fs.FileType.Directory else "file"
        yield info.base_name, kind, info.size or 0, info.mtime.timestamp() if info.mtime else 0.0


def _list(root: str):
    base = root.rstrip("/")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for parent in batch["path"]:
                for name, kind, size, changed in _entries(f"{base}/{parent}" if parent else base):
                    if name.startswith("._") or name == ".DS_Store":
                        continue
                    suffix = os.path.splitext(name)[1].lower()
                    stamp = datetime.datetime.fromtimestamp(changed, datetime.timezone.utc).isoformat()
                    rows.append((
                        f"{parent}/{name}" if parent else name, name, parent, kind,
                        suffix if kind == "file" else None, size if kind == "file" else None, stamp,
                    ))
                    if len(rows) >= CHUNK_ROWS:
                        yield pd.DataFrame(rows, columns=_COLUMNS)
                        rows = []
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return task


def dealt(files: DataFrame, each: int = FILES_PER_TASK) -> DataFrame:
    """Rows (``path`` and others) dealt to tasks by the number of their files; ``files`` is counted for that."""
    tasks = -(-files.count() // each)
    return files.repartition(max(1, min(MOST_TASKS, tasks)), "path")


def listing_tasks(folders: int) -> int:
    """Tasks that list so many folders: one each while they are few, since their sizes are not known."""
    return min(MOST_TASKS, max(min(folders, FOLDERS_APART), -(-folders // SMALL_FILES_PER_TASK)))


def inventory(spark: SparkSession, root: str, start: str = "") -> DataFrame:
    """All files and directories below ``root``/``start``, with paths relative to ``root``.

    Spark's own file sources skip names that start with ``.`` or ``_`` and keep the
    listing on the driver. Here each level of directories is one distributed job and
    the rows stay on the executors; the number of jobs is the depth of the tree.
    """
    if not start and "://" not in root and not os.path.isdir(root):
        return spark.createDataFrame([], FILE_ENTRY_DDL)
    frontier = spark.createDataFrame([(start,)], "path STRING")
    levels = []
    while True:
        level = materialize(frontier.mapInPandas(_list(root), FILE_ENTRY_DDL))
        levels.append(level)
        frontier = level.filter("kind = 'directory'").select("path")
        folders = frontier.count()
        if not folders:
            break
        frontier = frontier.repartition(listing_tasks(folders))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def checksums(files: DataFrame, root: str) -> DataFrame:
    """(path, checksum_sha256) of each file; files are read in pieces, so their size does not matter."""
    base = root.rstrip("/")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _open(f"{base}/{path}") as stream:
                    while piece := stream.read(CHUNK_BYTES):
                        digest.update(piece)
                out.append((path, digest.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "checksum_sha256"])

    return dealt(files.select("path")).mapInPandas(task, "path STRING, checksum_sha256 STRING")


def _open(path: str):
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def array_stores(spark: SparkSession, root: str, layer: str = "arrays") -> DataFrame:
    """Array stores below a layer: marker documents, file and directory counts, bytes, newest change.

    A store is a directory named ``*.zarr`` or one that holds a marker file. Files
    count for every store above them.
    """
    base = root.rstrip("/")
    if "://" not in base and not os.path.isdir(f"{base}/{layer}"):
        return spark.createDataFrame([], "path STRING, name STRING, metadata MAP<STRING, STRING>, file_count BIGINT, directory_count BIGINT, byte_size BIGINT, modified_at STRING")
    listing = inventory(spark, root, layer)  # its levels are written already
    named = listing.filter((F.col("kind") == "directory") & F.col("name").endswith(".zarr")).select("path")
    marked = listing.filter((F.col("kind") == "file") & F.col("name").isin(*STORE_MARKERS)).select(F.col("parent").alias("path"))
    stores = named.union(marked).distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for parent, name, path in zip(batch["parent"], batch["name"], batch["path"]):
                try:
                    with _open(f"{base}/{path}") as stream:
                        document = stream.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    document = None
                out.append((parent, name, document))
            yield pd.DataFrame(out, columns=["path", "marker", "document"])

    markers = listing.filter((F.col("kind") == "file") & F.col("name").isin(*MARKERS))
    documents = dealt(markers.select("parent", "name", "path"), SMALL_FILES_PER_TASK).mapInPandas(read, "path STRING, marker STRING, document STRING")
    unreadable = F.lit('{"error": "metadata could not be read"}')
    checked = F.when(F.try_parse_json("document").isNotNull(), F.col("document")).otherwise(unreadable)
    metadata = documents.groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("marker", checked)))).alias("metadata"))

    # every entry meets the stores among its ancestors by equality
    segments = F.split("parent", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
    inside = listing.select("kind", "byte_size", "modified_at", F.explode(above).alias("path")).join(stores, "path")
    stats = inside.groupBy("path").agg(
        F.count_if(F.col("kind") == "file").alias("file_count"), F.count_if(F.col("kind") == "directory").alias("directory_count"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("byte_size"), F.max("modified_at").alias("modified_at"),
    )
    zero = F.lit(0).cast("bigint")
    return stores.join(metadata, "path", "left").join(stats, "path", "left").select(
        "path", F.substring_index("path", "/", -1).alias("name"),
        F.coalesce("metadata", F.create_map().cast("map<string, string>")).alias("metadata"),
        *[F.coalesce(c, zero).alias(c) for c in ("file_count", "directory_count", "byte_size")], "modified_at",
    )


def files_named(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path) of the files below ``root`` that have this name, folders listed by the executors."""
    found = inventory(spark, root)
    return found.filter((F.col("kind") == "file") & (F.col("name") == name)).select("path")


def texts(files: DataFrame, root: str) -> DataFrame:
    """(path, value) of small files: their whole text, read by many tasks and passed on in bounded batches."""
    base = root.rstrip("/")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for path in batch["path"]:
                with _open(f"{base}/{path}") as stream:
                    value = stream.read().decode("utf-8", "replace")
                rows.append((path, value))
                held += len(value)
                if held >= CHUNK_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "value"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "value"])

    return dealt(files.select("path")).mapInPandas(task, "path STRING, value STRING")
