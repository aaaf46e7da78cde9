"""Folders of ``<stem>.txt`` files as a data source, ``label_files``.

Rows are (stem, content, batch): ``batch`` is n for files in a subfolder batch_<n>, null for those beside them.
Folders are paths or URIs of any store that pyarrow opens, and all executors must see the same one. Rows that are written
with ``archive``, a number, are packed: their files are the members of labels-<archive>.tar.gz in their folder, as a file of
its own takes a block of the disk for some ten bytes. A folder's files are either all packed or all loose.

    spark.dataSource.register(LabelFiles)
    spark.read.format("label_files").load(folder)
    df.write.format("label_files").mode("append").save(folder)
"""

from __future__ import annotations

import gzip
import re
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "stem string, content string, batch int"
#: Files that one task reads of a folder, and rows that it hands on at a time.
FILES, ROWS = 1_000, 200
#: Where tasks put files together before they show them.
STAGING = "_staging"

_FILE = re.compile(r"(.*)\.txt", re.I | re.S)
_FOLDER = re.compile(r"batch_(\d+)")
_ARCHIVE = re.compile(r"labels-\d+\.tar\.gz")
#: Beside archives, so that no loose files are put there.
PACKED = "_packed"
#: Bytes that go to an archive's compression at a time, and its level.
CHUNK, LEVEL = 1 << 18, 6


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, inside.rstrip("/")


def folder_of(batch: int | None) -> str:
    return "" if batch is None else f"batch_{batch:04d}"


def members(store: fs.FileSystem, path: str) -> Iterator[tuple[str, bytes]]:
    """Names and contents of an archive's files, read once and in order."""
    with store.open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|gz") as tar:
        while (member := tar.next()) is not None:
            if member.isfile():
                yield member.name, tar.extractfile(member).read()
            tar.members.clear()


class Archive:
    """An archive that is being written at ``path``."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.names: set[str] = set()
        self._file, self._held = store.open_output_stream(path, compression=None), bytearray()
        self._zip = gzip.GzipFile(fileobj=self._file, mode="wb", compresslevel=LEVEL, mtime=0)

    def add(self, name: str, data: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        self.names.add(name)
        self._held += info.tobuf(tarfile.PAX_FORMAT) + data + bytes(-len(data) % tarfile.BLOCKSIZE)
        if len(self._held) >= CHUNK:
            self._zip.write(self._held)
            self._held.clear()

    def close(self) -> None:
        self._zip.write(self._held + bytes(2 * tarfile.BLOCKSIZE))
        self._zip.close()
        self._file.close()


@dataclass
class Files(InputPartition):
    """Files of one folder: those named, or all if None, as a batch's folder is listed by the task that reads it."""

    folder: str
    batch: int | None
    names: tuple[str, ...] | None


class Reader(DataSourceReader):
    def __init__(self, path: str, files: int = FILES):
        self.path, self.files = path, files

    def partitions(self) -> list[Files]:
        store, inside = opened(self.path)
        found = store.get_file_info(fs.FileSelector(inside))
        names = sorted(f.base_name for f in found if f.type == fs.FileType.File and _FILE.fullmatch(f.base_name))
        parts = [Files("", None, tuple(names[k : k + self.files])) for k in range(0, len(names), self.files)]
        parts += [Files("", None, (name,)) for name in sorted(f.base_name for f in found if f.type == fs.FileType.File and _ARCHIVE.fullmatch(f.base_name))]
        folders = sorted((int(m[1]), f.base_name) for f in found if f.type == fs.FileType.Directory and (m := _FOLDER.fullmatch(f.base_name)))
        return parts + [Files(name, batch, None) for batch, name in folders] or [Files("", None, ())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, inside = opened(self.path)
        folder = f"{inside}/{partition.folder}".rstrip("/")
        names = partition.names
        if names is None:
            names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and (_FILE.fullmatch(f.base_name) or _ARCHIVE.fullmatch(f.base_name)))
        for some in batched(self._contents(store, folder, names), ROWS):
            stems, texts = zip(*((_FILE.fullmatch(name)[1], data.decode("utf-8", "replace")) for name, data in some))
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array(texts, pa.string()), pa.array([partition.batch] * len(some), pa.int32())], ["stem", "content", "batch"]
            )

    def _contents(self, store: fs.FileSystem, folder: str, names: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        for name in names:
            if _ARCHIVE.fullmatch(name):
                yield from members(store, f"{folder}/{name}")
                continue
            with store.open_input_stream(f"{folder}/{name}") as f:
                yield name, f.read()


@dataclass
class Written(WriterCommitMessage):
    """What one task has put in place."""

    files: int
    bytes: int


class Writer(DataSourceArrowWriter):
    """Each task writes its files to a folder of its own and, when all are there, moves them into place.

    A move replaces a file of the same name, so that a task that runs twice leaves no duplicate, and one that fails
    leaves nothing or whole files. Nothing but counts goes through the driver.
    """

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.run = path, columns, uuid.uuid4().hex
        store, inside = opened(path)
        if overwrite:
            for f in store.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
                if f.type == fs.FileType.File and (_FILE.fullmatch(f.base_name) or _ARCHIVE.fullmatch(f.base_name) or f.base_name in ("_SUCCESS", PACKED)):
                    store.delete_file(f.path)
                elif f.type == fs.FileType.Directory and _FOLDER.fullmatch(f.base_name):
                    store.delete_dir(f.path)
        store.create_dir(inside, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inside = opened(self.path)
        own = f"{inside}/{STAGING}/{self.run}/{uuid.uuid4().hex}"
        rows = self._rows(iterator)
        return self._packed(store, inside, own, rows) if "archive" in self.columns else self._loose(store, inside, own, rows)

    def _rows(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int | None, bytes]]:
        """(folder, stem, archive, content) of the rows, whose stems must be names."""
        for rows in iterator:
            stems, contents, batches, archives = (rows.column(self.columns.index(c)).to_pylist() if c in self.columns else [None] * rows.num_rows for c in ("stem", "content", "batch", "archive"))
            for stem, content, batch, archive in zip(stems, contents, batches, archives):
                if not stem or "/" in stem or "\0" in stem or stem in (".", ".."):
                    raise ValueError(f"{stem!r} can't name a label file")
                yield folder_of(batch), stem, archive, (content or "").encode()

    def _loose(self, store: fs.FileSystem, inside: str, own: str, rows: Iterator[tuple]) -> Written:
        placed: set[tuple[str, str]] = set()
        folders: set[str] = set()
        size = 0
        for folder, stem, _, data in rows:
            if (folder, stem) in placed:
                raise ValueError(f"{stem!r} is there twice")
            if folder not in folders:
                folders.add(folder)
                store.create_dir(f"{own}/{folder}".rstrip("/"), recursive=True)
                store.create_dir(f"{inside}/{folder}".rstrip("/"), recursive=True)
                if store.get_file_info(f"{inside}/{folder}/{PACKED}").type == fs.FileType.File:
                    raise ValueError(f"the files of {inside}/{folder} are packed")
            placed.add((folder, stem))
            with store.open_output_stream(f"{own}/{folder}/{stem}.txt" if folder else f"{own}/{stem}.txt") as f:
                f.write(data)
            size += len(data)
        for folder, stem in sorted(placed):
            name = f"{folder}/{stem}.txt" if folder else f"{stem}.txt"
            store.move(f"{own}/{name}", f"{inside}/{name}")
        return Written(len(placed), size)

    def _packed(self, store: fs.FileSystem, inside: str, own: str, rows: Iterator[tuple]) -> Written:
        """Archives one after the other, as rows are in order of them; each takes over the files of the one it replaces."""
        done: list[str] = []
        files = size = 0
        for (folder, archive), some in groupby(rows, lambda r: (r[0], r[2])):
            name = f"{folder}/labels-{archive:05d}.tar.gz".lstrip("/")
            if name in done:
                raise ValueError("rows of one archive must follow each other")
            there = f"{inside}/{folder}".rstrip("/")
            if not done or not done[-1].startswith(f"{folder}/"):
                store.create_dir(f"{own}/{folder}".rstrip("/"), recursive=True)
                self._mark(store, there)
            new = Archive(store, f"{own}/{name}")
            for _, stem, _, data in some:
                if f"{stem}.txt" in new.names:
                    raise ValueError(f"{stem!r} is there twice")
                new.add(f"{stem}.txt", data)
                files, size = files + 1, size + len(data)
            if store.get_file_info(f"{inside}/{name}").type == fs.FileType.File:
                written = frozenset(new.names)
                for kept, data in members(store, f"{inside}/{name}"):
                    if kept not in written:
                        new.add(kept, data)
            new.close()
            done.append(name)
        for name in done:
            store.move(f"{own}/{name}", f"{inside}/{name}")
        return Written(files, size)

    def _mark(self, store: fs.FileSystem, folder: str) -> None:
        """Note in ``folder`` that its files are packed; it must not have loose ones."""
        store.create_dir(folder, recursive=True)
        if store.get_file_info(f"{folder}/{PACKED}").type == fs.FileType.File:
            return
        if any(f.type == fs.FileType.File and _FILE.fullmatch(f.base_name) for f in store.get_file_info(fs.FileSelector(folder))):
            raise ValueError(f"the files of {folder} are loose")
        store.open_output_stream(f"{folder}/{PACKED}").close()

    def commit(self, messages: list[Written | None]) -> None:
        store, inside = opened(self.path)
        self._clear(store, inside)
        with store.open_output_stream(f"{inside}/_SUCCESS") as f:
            f.write(f"{sum(m.files for m in messages if m)} files, {sum(m.bytes for m in messages if m)} bytes\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, inside: str) -> None:
        for folder in (f"{inside}/{STAGING}/{self.run}", f"{inside}/{STAGING}"):
            found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
            if folder.endswith(self.run) or not found:
                if store.get_file_info(folder).type == fs.FileType.Directory:
                    store.delete_dir(folder)


class LabelFiles(DataSource):
    """The source; option ``path`` names the folder, ``files_per_task`` bounds the files beside the batches that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "label_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._path(), int(self.options.get("files_per_task", FILES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        columns = schema.fieldNames()
        if not {"stem", "content"} <= set(columns) <= {"stem", "content", "batch", "archive"}:
            raise ValueError("label files are written from stem, content and, if they go to folders, batch; if they are packed, archive")
        return Writer(self._path(), columns, overwrite)

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("label_files needs a path")
        return self.options["path"]
