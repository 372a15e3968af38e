"""One large JSON object read by byte ranges, each in a task of its own."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tierscope import schemas as S
from tierscope.sources import archives
from tierscope.sources.text import conform

# The source travels with its tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20  # looked at a time for where an entry begins
LONGEST_KEY = 4096  # bytes, with the white space around it
ROWS = 8192  # of a batch
#: Where a value ends and an entry with a number as its key follows. Inside a string a quote has
#: a backslash before it, and a string that is nothing but `,` is followed by no number.
ENTRY = re.compile(rb'(?<!\\)"\s*,\s*(?="-?[0-9]+"\s*:)')


@dataclass
class Range(InputPartition):
    """A part of a file: the entries that begin in it belong to it."""

    path: str
    start: int
    end: int


def ranges(path: str, size: int = SPLIT_BYTES) -> list[Range]:
    """The parts of a file, or of all `.json` files of a folder."""
    store, place = archives._opened(path)
    found = store.get_file_info(place)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [(path, found.size)]
    if found.type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(place))
        files = sorted(
            (f"{path.rstrip('/')}/{f.base_name}", f.size) for f in inside
            if f.is_file and not f.base_name.startswith(("_", "."))
        )
    return [
        Range(name, start, min(start + size, length))
        for name, length in files for start in range(0, length, size)
    ]


def _next_entry(file, start: int, length: int) -> int:
    """Where the first entry begins, of those after whose comma `start` lies or that follow.

    Depends on the bytes around alone, so two tasks agree on it.
    """
    at = max(start - LONGEST_KEY, 0)
    while at < length:
        file.seek(at)
        data = file.read(READ_BYTES + 2 * LONGEST_KEY)
        for match in ENTRY.finditer(data):
            # What comes before the first byte isn't known here.
            if match.end() + at >= start and (match.start() or not at):
                return match.end() + at
        at += READ_BYTES
    return length


def entries(part: Range) -> dict[str, str]:
    """The entries that begin in a part of a file."""
    store, place = archives._opened(part.path)
    with store.open_input_file(place) as file:
        length = file.size()
        start = 0 if part.start == 0 else _next_entry(file, part.start, length)
        end = length if part.end >= length else _next_entry(file, part.end, length)
        if start >= end:
            return {}
        file.seek(start)
        text = file.read(end - start).decode("utf-8-sig").strip()
    head = "" if start == 0 else "{"
    if end < length:
        text = text.rstrip().removesuffix(",") + "}"
    return json.loads(head + text) if text else {}


class JsonDictionary(DataSource):
    """Entries of JSON objects as rows (key, value), by byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "json_dictionary"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DictionaryReader:
        return DictionaryReader(self.options["path"], int(self.options["size"]))


class DictionaryReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[Range]:
        return ranges(self.path, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows = list(entries(partition).items())
        for i in range(0, len(rows), ROWS):
            keys, values = zip(*rows[i : i + ROWS])
            texts = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["key", "value"]
            )


def read_drug_dictionary(spark: SparkSession, path: str, size: int = SPLIT_BYTES) -> DataFrame:
    """Drug descriptions from JSON files `{"rxcui": "description"}` of any size.

    A file is read by ranges of `size` bytes, several tasks a file; a task holds its range. A
    range begins with its first entry whose key is a number, which every task finds alike. Of a key
    that repeats within a range the last value counts, otherwise each is a row. Keys that are
    no numbers are NULL, as `read_drug_names` has them. The path is one that pyarrow opens.
    """
    spark.dataSource.register(JsonDictionary)
    rows = spark.read.format("json_dictionary").option("size", size).load(path)
    return conform(rows.toDF("rxcui", "description"), S.DRUG_NAMES)
