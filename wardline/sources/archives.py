"""Lines of archives as a Spark data source, read and written as streams.

``spark.read.format("archive_lines")`` has one partition for each archive and
decompresses it as a stream, so a task holds a batch of lines and never an
archive or a member.  Writing makes archives of bounded size in each task; they
become visible together, when the job is committed.
"""

from __future__ import annotations

import gzip
import io
import itertools
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SUFFIXES = (".tgz", ".gz", ".tar")
BATCH_LINES, BATCH_BYTES = 10_000, 4 << 20
ARCHIVE_BYTES = 32 << 20
MEMBER = ".db"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """Addresses of the files of a file, a folder (not below it) or a pattern in a last path part; hidden ones are left out."""
    store, inner = filesystem(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else path.partition(":")[0] + "://" if "://" in path else "file:"
    folder, _, last = inner.rstrip("/").rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch(f.base_name, last)]
    else:
        info = store.get_file_info(inner.rstrip("/"))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner.rstrip("/")))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def archive_lines(stream_of, name: str, member_text: str) -> Iterator[tuple[str, bytes]]:
    """(member, line) of the first member whose name holds ``member_text``; of a file that is no archive, all its lines.

    ``stream_of`` opens the file anew; a ``.gz`` file may hold an archive or plain lines.
    """
    if not name.endswith(SUFFIXES):
        with stream_of() as stream:
            yield from (("", line) for line in io.BufferedReader(stream, 1 << 20))
        return
    with stream_of() as stream:
        try:
            archive = tarfile.open(fileobj=stream, mode="r|*")
        except tarfile.ReadError:
            # Not an archive; damage further on is an error.
            archive = None
        if archive:
            for member in archive:
                if member.isfile() and member_text in member.name:
                    yield from ((member.name, line) for line in archive.extractfile(member))
                    return
            return
    with stream_of() as stream, gzip.GzipFile(fileobj=stream) as plain:
        yield from (("", line) for line in plain)


@dataclass
class ArchivePart(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.member_text = options.get("member", MEMBER)

    def partitions(self) -> list[InputPartition]:
        return [ArchivePart(path) for path in files_of(self.path)]

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        store, inner = filesystem(partition.path)
        found = archive_lines(lambda: store.open_input_file(inner), inner, self.member_text)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        rows: list[tuple[str, str, int, str]] = []
        size = 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "member", "line_no", "line"]
            )

        for number, (member, line) in enumerate(found, start=1):
            rows.append((partition.path, member, number, line.removesuffix(b"\n").decode("utf-8", errors="replace")))
            size += len(line)
            if len(rows) >= BATCH_LINES or size >= BATCH_BYTES:
                yield told()
                rows, size = [], 0
        if rows:
            yield told()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceWriter):
    """Writes the column ``line`` of each task's rows, in order, into ``.tgz`` archives."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.member = options.get("member", MEMBER)
        self.most = int(options.get("bytes", ARCHIVE_BYTES))
        self.overwrite = overwrite
        self.aside = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, aside = filesystem(self.aside)
        store.create_dir(aside, recursive=True)
        files: list[str] = []
        lines, size = [], 0
        for row in itertools.chain(rows, [None]):
            if row is not None:
                line = (row["line"] or "").encode() + b"\n"
                lines.append(line)
                size += len(line)
            if lines and (row is None or size >= self.most):
                name = f"part-{context.partitionId():05d}-{len(files):05d}.tgz"
                # The attempt is part of the name aside: a repeated task never meets the files of another one.
                self._archive(store, f"{aside}/{context.taskAttemptId()}-{name}", lines, size)
                files.append(f"{context.taskAttemptId()}-{name}")
                lines, size = [], 0
        return Written(files)

    def _archive(self, store: fs.FileSystem, path: str, lines: list[bytes], size: int) -> None:
        with store.open_output_stream(path, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as archive:
            note = b"lines\n"
            info = tarfile.TarInfo("about.txt")
            info.size = len(note)
            archive.addfile(info, io.BytesIO(note))
            info = tarfile.TarInfo(f"lines{self.member}")
            info.size = size
            archive.addfile(info, io.BytesIO(b"".join(lines)))

    def commit(self, messages: list[Written | None]) -> None:
        store, aside = filesystem(self.aside)
        _, folder = filesystem(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        for path in old:
            store.delete_file(path)
        store.create_dir(folder, recursive=True)
        for name in (f for message in messages if message for f in message.files):
            store.move(f"{aside}/{name}", f"{folder}/{name.partition('-')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, aside = filesystem(self.aside)
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)


class ArchiveLines(DataSource):
    """``archive_lines``: options ``path``, ``member`` (text in the member's name) and, to write, ``bytes`` an archive."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "path string, member string, line_no bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options, overwrite)


def read_archives(spark: SparkSession, path: str, member_text: str = MEMBER) -> DataFrame:
    """Lines of archives as ``(path, member, line_no, line)``.

    Of each ``.tar``, ``.tgz`` or ``.gz`` archive the first member whose name
    holds ``member_text`` is read; a ``.gz`` file without an archive, and any
    other file, is read as plain lines.
    """
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("member", member_text).load(path)


def write_archives(lines: DataFrame, path: str, member_text: str = MEMBER, archive_bytes: int = ARCHIVE_BYTES, mode: str = "append") -> None:
    """Write the column ``line`` into archives of about ``archive_bytes`` of text; ``mode`` is append (to no archives) or overwrite."""
    lines.sparkSession.dataSource.register(ArchiveLines)
    writer = lines.select("line").write.format("archive_lines").mode(mode)
    writer.option("member", member_text).option("bytes", str(archive_bytes)).save(path)
