"""Archives as a Spark data source: a filter on names of parts reads those parts and nothing else.

    register(spark)
    spark.read.format("archives").load(path).where("part_uri = 'word/document.xml'")
    frame.write.format("archives").mode("append").save(path)      # (doc_id, content)

Files are packed into partitions by size. Of each archive its directory is read, then the
bytes of the entries that the filters let through, by seeking; everything else stays on
disk. Paths are those that ``pyarrow.fs`` opens (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .archives import ENTRIES, MAX_ENTRY_BYTES

_SCHEMA = pa.schema([("doc_id", pa.string()), ("part_uri", pa.string()), ("is_directory", pa.bool_()), ("compressed_bytes", pa.int64()), ("uncompressed_bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
_BATCH_BYTES = 16 << 20
_FILTERED = ("doc_id", "part_uri")


@dataclass
class Files(InputPartition):
    """Archives of one task: (name below the folder, bytes)."""

    names: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    where, root = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return where, root.rstrip("/")


def _holds(condition: Filter, value: str | None) -> bool:
    if value is None:
        return False
    if isinstance(condition, StringStartsWith):
        return value.startswith(condition.value)
    return value in condition.value if isinstance(condition, In) else value == condition.value


class ArchiveReader(DataSourceReader):
    """Which files and entries are read is settled by the filters that it takes over."""

    def __init__(self, path: str, task_bytes: int, with_content: bool) -> None:
        self.path, self.task_bytes, self.with_content = path, task_bytes, with_content
        self.taken: dict[str, list[Filter]] = {c: [] for c in _FILTERED}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in _FILTERED:
                self.taken[f.attribute[0]].append(f)
            else:
                yield f

    def _wanted(self, column: str, value: str | None) -> bool:
        return all(_holds(f, value) for f in self.taken[column])

    def partitions(self) -> list[Files]:
        where, root = _opened(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True))
        names = [(f.path[len(root) + 1 :], f.size) for f in found if f.type == fs.FileType.File]
        # hidden files and those of a write that has not ended are no archives
        names = sorted((n, s) for n, s in names if not any(p.startswith(("_", ".")) for p in n.split("/")) and self._wanted("doc_id", unquote(n)))
        out, size = [Files([])], 0
        for name, n in names:
            if out[-1].names and size + n > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].names.append((name, n))
            size += n + (1 << 16)  # opening a file is work as well
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, root = _opened(self.path)
        rows, size = [], 0
        for name, _ in partition.names:
            for row in self._entries(where, f"{root}/{name}", unquote(name)):
                rows.append(row)
                size += len(row[5] or b"") + 256
                if size >= _BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _entries(self, where: fs.FileSystem, path: str, doc: str) -> Iterator[tuple]:
        try:
            with where.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                for e in z.infolist():
                    if self._wanted("part_uri", e.filename):
                        over = self.with_content and e.file_size > MAX_ENTRY_BYTES
                        content = z.read(e) if self.with_content and not over and not e.is_dir() else None
                        yield (doc, e.filename, e.is_dir(), e.compress_size, e.file_size, content, "entry too large" if over else None)
        except (zipfile.BadZipFile, pa.ArrowInvalid, NotImplementedError, RuntimeError) as error:  # a failed read is no such row: its task runs again
            if self._wanted("part_uri", None):
                yield (doc, None, None, None, None, None, str(error))

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


class ArchiveWriter(DataSourceWriter):
    """One file for each row, named by its doc_id.

    A file is written under a hidden name and then moved, so a task that is lost leaves
    none that a reader takes for whole, and one that runs again replaces its own.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = path
        if overwrite:
            raise ValueError("archives are only appended; a row of a known doc_id replaces its file")

    def write(self, iterator: Iterator) -> Written:
        where, root = _opened(self.path)
        where.create_dir(root, recursive=True)
        names = []
        for row in iterator:
            if row.doc_id is None or row.content is None:
                raise ValueError("an archive needs a doc_id and content")
            # a sign that would make a name hidden or a folder is quoted, and read back
            name = quote(row.doc_id, safe=" ()")
            name = f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in ("_", ".") else name
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with where.open_output_stream(hidden, compression=None) as out:
                out.write(bytes(row.content))
            where.move(hidden, f"{root}/{name}")
            names.append(name)
        return Written(names)

    def commit(self, messages: list) -> None:
        """Every file is in place already."""

    def abort(self, messages: list) -> None:
        """Files that were replaced cannot be brought back, so those in place stay."""


class Archives(DataSource):
    """``archives``: options ``path``, ``maxPartitionBytes`` (128 MB of files a task) and ``content`` (false: directories alone)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("maxPartitionBytes", 128 << 20)), self.options.get("content", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        if not {"doc_id", "content"} <= set(schema.names):
            raise ValueError("archives are written from doc_id and content")
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``archives`` known to the session, and lets Python sources take over filters."""
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
