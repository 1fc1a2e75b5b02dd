"""A data source of repository files: what a profile leaves out is never opened, what can't be read is a row.

    spark.read.format("repository").option("root", folder).option("profile", json).load()

Planning lists names and sizes only. Folders that a profile excludes aren't even listed. The files
that it takes are dealt to partitions of about equal size, and tasks open these alone, each on its own: a file
that can't be read gives a row without content, with the error's text. Roots can be any file system that Arrow
opens: local and mounted folders, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cipherlode.sources.globs import excludes, glob_regex

SCHEMA = "file_id string, path string, length long, content binary, error string"
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 2_000
BATCH_BYTES = 16 << 20
MAX_BYTES = 1 << 30
"""Longer files become failures: a row, with its hits, has to fit into memory."""


@dataclass(frozen=True)
class Found:
    path: str
    length: int | None
    """None where the listing couldn't tell."""


@dataclass
class FilePartition(InputPartition):
    files: tuple[Found, ...]

    def __init__(self, files: tuple[Found, ...]):
        super().__init__(None)
        self.files = files


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, and its path there."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def listed(root: str, profile: dict) -> list[Found]:
    """The files that a profile takes, by name: of paths that differ in case only the first one, max_files at most."""
    system, top = opened(root)
    top = top.rstrip("/")
    include = [re.compile(glob_regex(g)) for g in profile["include_globs"]]
    leaves_out = excludes(profile["exclude_globs"])
    taken: dict[str, Found] = {}
    folders = [top]
    while folders:
        for info in system.get_file_info(fs.FileSelector(folders.pop())):
            path = info.path[len(top) + 1 :]
            if info.type == fs.FileType.Directory:
                if not leaves_out(path + "/", folder=True):
                    folders.append(info.path)
            elif any(rx.search(path) for rx in include) and not leaves_out(path):
                one = Found(path, info.size if info.type == fs.FileType.File else None)
                key = path.lower()
                if key not in taken or path < taken[key].path:
                    taken[key] = one
    return sorted(taken.values(), key=lambda f: f.path)[: profile["max_files"]]


def dealt(files: list[Found]) -> list[FilePartition]:
    """Files in order, in partitions of about PARTITION_BYTES and at most PARTITION_FILES each."""
    out: list[FilePartition] = []
    part: list[Found] = []
    size = 0
    for f in files:
        if part and (size + (f.length or 0) > PARTITION_BYTES or len(part) == PARTITION_FILES):
            out.append(FilePartition(tuple(part)))
            part, size = [], 0
        part.append(f)
        size += f.length or 0
    return [*out, FilePartition(tuple(part))]


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, profile: dict, most: int):
        self.root, self.profile, self.most = root, profile, most

    def partitions(self) -> list[FilePartition]:
        return dealt(listed(self.root, self.profile))

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        system, top = opened(self.root)
        rows: list[tuple] = []
        size = 0
        for f in partition.files:
            content, error, length = None, None, f.length
            try:
                with system.open_input_stream(f"{top.rstrip('/')}/{f.path}") as stream:
                    # one byte more tells a file that is longer, whatever its listing said
                    content = stream.read(self.most + 1)
                length = len(content)
                if length > self.most:
                    content, error, length = None, f"longer than {self.most} bytes", max(length, f.length or 0)
            except Exception as e:
                error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else 'no reason given'}"
            rows.append((hashlib.sha256(f.path.encode("utf-8", "replace")).hexdigest()[:16], f.path, length, content, error))
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class RepositorySource(DataSource):
    """Options: root; profile, as JSON with include_globs, exclude_globs and max_files; maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        for name in ("root", "profile"):
            if name not in self.options:
                raise ValueError(f"option {name!r} is missing")
        return RepositoryReader(self.options["root"], json.loads(self.options["profile"]), int(self.options.get("maxBytes", MAX_BYTES)))
