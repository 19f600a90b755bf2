"""Search pages packed into files of bounded size, as a Spark data source: batch and stream reader, writer.

A page is one gzip member; a file holds many pages, up to a number of bytes, and has an
index of them beside it. What a write has made is listed in a numbered commit once all its
tasks are done, and only listed files are read: a write that fails leaves nothing to see.
Readers plan page ranges of about equal bytes; a stream counts commits as its offsets.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from . import shared_files
from .shared_files import file_system

FORMAT = "search_pages"
FILE_BYTES = 128 << 20  # a file is closed once it holds so much
SPLIT_BYTES = 2 << 20  # compressed bytes that one task reads and parses
ROWS = "run_id STRING, page_number INT, commit BIGINT, value STRING"
INDEX = "run_id STRING, page_number INT, commit BIGINT, path STRING, offset BIGINT, byte_size BIGINT, items BIGINT, checksum_sha256 STRING"
_INDEX_FILE = pa.schema([
    ("run_id", pa.string()), ("page_number", pa.int32()), ("offset", pa.int64()), ("byte_size", pa.int64()), ("items", pa.int64()), ("checksum_sha256", pa.string()),
])

# The driver's processes that plan reads and streams do not see shipped packages.
cloudpickle.register_pickle_by_value(shared_files)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: name, pages, bytes."""

    files: list[tuple[str, int, int]]


class _Packer:
    """Appends pages to files, a new one after ``limit`` bytes."""

    def __init__(self, root: str, system: fs.FileSystem, limit: int):
        self.root, self.system, self.limit = root, system, limit
        self.files: list[tuple[str, int, int]] = []
        self.name, self.out, self.index, self.size = "", None, [], 0

    def add(self, run_id: str | None, page: int | None, lines: list[str | None]) -> None:
        if self.out is None:
            self.system.create_dir(f"{self.root}/data", recursive=True)
            self.name, self.index, self.size = f"data/{uuid.uuid4().hex}.pages", [], 0
            self.out = self.system.open_output_stream(f"{self.root}/{self.name}")
        packed = gzip.compress("\n".join(line or "" for line in lines).encode(), 3, mtime=0)
        self.out.write(packed)
        self.index.append((run_id, page, self.size, len(packed), len(lines), hashlib.sha256(packed).hexdigest()))
        self.size += len(packed)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.index), _INDEX_FILE)]
            with self.system.open_output_stream(f"{self.root}/{self.name}.index") as out:
                pq.write_table(pa.Table.from_arrays(columns, schema=_INDEX_FILE), out)
            self.files.append((self.name, len(self.index), self.size))

    def discard(self) -> None:
        if self.out is not None:
            self.out.close()
        _remove(self.system, self.root, [*self.files, (self.name, 0, 0)])


def _remove(system: fs.FileSystem, root: str, files: Sequence[tuple[str, int, int]]) -> None:
    for name, _, _ in files:
        for path in (f"{root}/{name}", f"{root}/{name}.index"):
            if name and system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)


def _page_ends(runs: pa.Array, numbers: pa.Array) -> list[int]:
    """Rows at which another page begins, but the first."""
    n, starts = len(runs), False
    if n < 2:
        return []
    for column in (runs, numbers):
        one, other = column.slice(0, n - 1), column.slice(1)
        same = pc.or_(pc.fill_null(pc.equal(one, other), False), pc.and_(pc.is_null(one), pc.is_null(other)))
        starts = starts | ~np.asarray(same, dtype=bool)
    return [int(k) + 1 for k in np.flatnonzero(starts)]


class PageWriter(DataSourceArrowWriter):
    """Rows (run_id, page_number, value), those of a page one after another in one task."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        packer = _Packer(root, system, self.file_bytes)
        try:
            page, lines = None, []
            for batch in iterator:
                runs, numbers, values = (batch.column(n) for n in ("run_id", "page_number", "value"))
                ends = [*_page_ends(runs, numbers), batch.num_rows]
                for start, end in zip([0, *ends[:-1]], ends):
                    if start == end:
                        continue
                    if (key := (runs[start].as_py(), numbers[start].as_py())) != page:
                        if page is not None:
                            packer.add(*page, lines)
                        page, lines = key, []
                    lines += values.slice(start, end - start).to_pylist()
            if page is not None:
                packer.add(*page, lines)
            packer.close()
        except BaseException:
            packer.discard()
            raise
        return Written(packer.files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        system.create_dir(f"{root}/_commits", recursive=True)
        made = f"{root}/_commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(made) as out:
            out.write(json.dumps({"files": files}).encode())
        system.move(made, f"{root}/_commits/{_last_commit(system, root) + 1:012d}.json")  # one writer at a time

    def abort(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None:
                _remove(system, root, m.files)


def _commits(system: fs.FileSystem, root: str) -> list[int]:
    found = system.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return sorted(int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(".json") and f.base_name[:1].isdigit())


def _last_commit(system: fs.FileSystem, root: str) -> int:
    return max(_commits(system, root), default=0)


def _planned(path: str, after: int, upto: int | None, split: int) -> list[InputPartition]:
    """Page ranges (commit, file, first, last) of the commits, packed to about ``split`` bytes a task."""
    system, root = file_system(path)
    ranges, held, size = [], [], 0
    for commit in _commits(system, root):
        if commit <= after or (upto is not None and commit > upto):
            continue
        with system.open_input_stream(f"{root}/_commits/{commit:012d}.json") as file:
            files = json.loads(file.read())["files"]
        for name, pages, size_ in files:
            parts = max(1, min(pages, -(-size_ // split)))
            for part in range(parts):
                held.append((commit, name, pages * part // parts, pages * (part + 1) // parts))
                size += size_ // parts
                if size >= split:
                    ranges.append(InputPartition(held))
                    held, size = [], 0
    return [*ranges, InputPartition(held)] if held else ranges


def _index(system: fs.FileSystem, root: str, name: str, first: int, last: int) -> pa.Table:
    with system.open_input_file(f"{root}/{name}.index") as file:
        return pq.read_table(file).slice(first, last - first)


def _read_pages(path: str, partition: InputPartition) -> Iterator[pa.RecordBatch]:
    system, root = file_system(path)
    for commit, name, first, last in partition.value:
        index = _index(system, root, name, first, last).to_pylist()
        with system.open_input_file(f"{root}/{name}") as file:
            for at in range(0, len(index), 50):
                pages, texts = index[at : at + 50], []
                for page in pages:
                    file.seek(page["offset"])
                    texts.append(gzip.decompress(file.read(page["byte_size"])).decode())
                lines = pc.split_pattern(pa.array(texts, pa.string()), "\n")
                of = pa.array(np.repeat(np.arange(len(pages)), np.asarray(pc.list_value_length(lines))))
                columns = [pa.array([page[c] for page in pages], kind).take(of) for c, kind in (("run_id", pa.string()), ("page_number", pa.int32()))]
                columns += [pa.array(np.full(len(of), commit, np.int64)), lines.flatten()]
                yield pa.RecordBatch.from_arrays(columns, names=["run_id", "page_number", "commit", "value"])


class PageReader(DataSourceReader):
    def __init__(self, path: str, split: int, index: bool):
        self.path, self.split, self.index = path, split, index

    def partitions(self) -> list[InputPartition]:
        return _planned(self.path, 0, None, self.split) or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not self.index:
            yield from _read_pages(self.path, partition)
            return
        system, root = file_system(self.path)
        for commit, name, first, last in partition.value:
            rows = _index(system, root, name, first, last)
            rows = rows.add_column(2, "commit", pa.array([commit] * len(rows), pa.int64())).add_column(3, "path", pa.array([f"{self.path}/{name}"] * len(rows)))
            yield from rows.to_batches()


class PageStreamReader(DataSourceStreamReader):
    """A micro-batch takes the commits made since the last one; an offset is the number of the last commit read."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": _last_commit(*file_system(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _planned(self.path, start["commit"], end["commit"], self.split)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read_pages(self.path, partition)


class PageSource(DataSource):
    """Options: path, ``index`` (rows are the pages themselves), ``fileBytes`` and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return INDEX if self._indexed() else ROWS

    def _indexed(self) -> bool:
        return self.options.get("index", "false").lower() == "true"

    def _split(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], self._split(), self._indexed())

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options["path"], self._split())

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the data source known to it."""
    spark.dataSource.register(PageSource)
    return spark
