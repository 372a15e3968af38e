"""ZIP archives read member by member; small members share a task."""

from __future__ import annotations

import io
import json
import re
import sys
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tierscope.sources.text import _parse_member, _read_header, text_schema

# The source travels with its tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL_HEADER_BYTES = 30  # of a member, before its name and extra field
ORIGIN = "origin_"  # column that names archive and member
READ_BYTES = 1 << 20  # fetched from the store at a time
# Members of an archive share a task up to so many bytes, packed as they are; opening one counts
# as so many. Where that gives fewer tasks than this for all archives, tasks get less each.
TASK_BYTES, OPEN_BYTES, TASKS = 4 << 20, 4 << 10, 64
BATCH_ROWS = 10_000  # rows of small members that are passed on together


@dataclass
class Member(InputPartition):
    """A member of an archive and where it lies, as the archive's directory says."""

    path: str
    info: zipfile.ZipInfo


@dataclass
class Members(InputPartition):
    """Members that one task reads, one after the other."""

    members: list[Member]


def shared(found: Sequence[Member]) -> list[Members]:
    """Members dealt to tasks, in their order; a large one has a task of its own."""
    costs = [member.info.compress_size + OPEN_BYTES for member in found]
    most = min(TASK_BYTES, sum(costs) / TASKS)
    tasks, held = [], 0
    for member, cost in zip(found, costs):
        if not tasks or held + cost > most:
            tasks.append(Members([]))
            held = 0
        tasks[-1].members.append(member)
        held += cost
    return tasks


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, by the names that Spark uses for it."""
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path))
    return fs.FileSystem.from_uri(uri)


def archive_paths(path: str) -> list[str]:
    """The archives at a path, which may be one archive or a folder of them."""
    store, place = _opened(path)
    found = store.get_file_info(place)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [path]
    inside = store.get_file_info(fs.FileSelector(place, recursive=True))
    names = [f.path for f in inside if f.is_file and f.base_name.lower().endswith(".zip")]
    return sorted(path.rstrip("/") + name[len(place.rstrip("/")):] for name in names)


def members(path: str) -> list[Member]:
    """The members of an archive; reads its directory, at the end of the file, and no data."""
    store, place = _opened(path)
    with store.open_input_file(place) as file, zipfile.ZipFile(file) as archive:
        return [Member(path, info) for info in archive.infolist() if not info.is_dir()]


def open_member(member: Member) -> io.BufferedReader:
    """A member's text: its bytes are fetched by range and unpacked piece by piece."""
    store, place = _opened(member.path)
    file = store.open_input_file(place)
    file.seek(member.info.header_offset)
    header = file.read(LOCAL_HEADER_BYTES)
    if member.info.flag_bits & 1:
        raise ValueError(f"{member.path}: member {member.info.filename} is encrypted")
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.path} has changed, or is no ZIP archive")
    skipped = int.from_bytes(header[26:28], "little") + int.from_bytes(header[28:30], "little")
    file.seek(member.info.header_offset + LOCAL_HEADER_BYTES + skipped)
    return io.BufferedReader(zipfile.ZipExtFile(file, "r", member.info, None, True), READ_BYTES)


class ZipMembers(DataSource):
    """Pipe-delimited members of ZIP archives, partitions of one large or some small ones."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> StructType:
        return text_schema(json.loads(self.options["columns"]))

    def reader(self, schema: StructType) -> MembersReader:
        return MembersReader(self.options["path"], schema.names, self.options["encoding"])


class MembersReader(DataSourceReader):
    def __init__(self, path: str, columns: Sequence[str], encoding: str):
        self.path, self.columns, self.encoding = path, list(columns), encoding

    def partitions(self) -> Sequence[Members]:
        return shared([m for path in archive_paths(self.path) for m in members(path)])

    def read(self, partition: Members | Member) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Member):
            yield from self._rows(partition)
            return
        held, rows = [], 0
        for member in partition.members:
            for batch in self._rows(member):
                held, rows = [*held, batch], rows + batch.num_rows
                if rows >= BATCH_ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _rows(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names = [name for name in self.columns if name != ORIGIN]
        target = pa.schema([(name, pa.string()) for name in names])
        origin = f"{partition.path}!{partition.info.filename}"
        with open_member(partition) as stream:
            if not stream.peek(1):  # an empty member has no header either
                return
            for batch in _parse_member(stream, target, self.encoding):
                if len(names) < len(self.columns):
                    batch = batch.append_column(ORIGIN, pa.array([origin] * batch.num_rows))
                yield batch


def member_columns(path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names of the first member that has any; reads a few bytes of it."""
    for archive in archive_paths(path):
        for member in members(archive):
            with open_member(member) as stream:
                if stream.peek(1):
                    return _read_header(stream, encoding)
    raise ValueError(f"{path} holds no text")


def read_zip_members(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8",
    origin: bool = False,
) -> DataFrame:
    """The pipe-delimited members of an archive or a folder of archives, every column as text.

    A large member is one partition, small ones share one: a task fetches a member's bytes by
    range and parses them block by block. Archives may have any size, and so may members; a
    task's memory depends on neither. Only the directories of the archives are read by the driver, once. Columns are found by header
    name in any case and order; one that a member lacks is NULL; without `columns`, those of
    the first member are read. With `origin`, a last column ORIGIN names archive and member.

    The path may be any that pyarrow opens (local, S3, GCS, HDFS); for other stores there is
    `read_pipe_zip`, which reads archives whole.
    """
    spark.dataSource.register(ZipMembers)
    names = list(columns) if columns is not None else member_columns(path, encoding)
    return spark.read.format("zip_members").options(
        columns=json.dumps([*names, ORIGIN] if origin else names), encoding=encoding
    ).load(path)


def can_open(path: str) -> bool:
    """Whether pyarrow has a file system for a path."""
    try:
        _opened(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True
