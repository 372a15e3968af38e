"""Pipe-delimited deliveries: reading, cleaning and typing."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import csv as pa_csv
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope import schemas as S
from tierscope.functions.expr import plan_key

# The archive reader travels with its tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATIN1 = "ISO-8859-1"
#: Column of `prepare_checked`, also in the stored tables, whose readers don't ask for it.
REJECTED = "rejected_"
REJECTED_TYPE = (
    "struct<file:string,row:string,values:array<struct<column:string,text:string,reason:string>>>"
)
ZIP_BLOCK_BYTES = 4 << 20


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_pipe(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    """Pipe-delimited text with a header line, every column as text.

    The path may be any that Spark reads, object stores included; credentials come
    from the Spark configuration. With `columns` given in file order, no job runs to
    look at the header. Each file's own header is compared with these, or with the first
    file's: one with other columns, or in another order, is an error, not read by position.
    """
    reader = spark.read.options(sep="|", header=True, encoding=encoding, enforceSchema=False)
    if columns is not None:
        reader = reader.schema(text_schema(columns))
    return reader.csv(path)


def read_pipe_zip(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    encoding: str = "UTF-8",
    partitions: int | None = None,
) -> DataFrame:
    """The pipe-delimited members of ZIP archives, every column as text.

    Without `columns`, those of the first member are read, found by a small job. An
    archive cannot be split, so each is one task; rows are then spread over `partitions`
    (the shuffle default if not given). For files of gigabytes, unpacked text reads
    faster.
    """
    archives = spark.read.format("binaryFile").load(path).select("content")
    if columns is None:
        columns = zip_columns(archives, encoding)
    rows = unzip_pipe(archives, columns, encoding)
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions)


def zip_columns(archives: DataFrame, encoding: str = "UTF-8") -> list[str]:
    """Column names of the first member of the first archive; only names reach the driver."""

    def header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _members(batches):
            names = _read_header(stream, encoding)
            yield pa.RecordBatch.from_arrays([pa.array([names])], names=["names"])
            return

    return list(archives.limit(1).mapInArrow(header, "names array<string>").first()["names"])


def unzip_pipe(archives: DataFrame, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Rows of the members of archives given as a binary column `content`.

    Members are decompressed and parsed block by block, never held whole. Columns are
    found by header name in any case and order; one that a member lacks is NULL.
    """
    names = list(columns)
    target = pa.schema([(name, pa.string()) for name in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stream in _members(batches):
            yield from _parse_member(stream, target, encoding)

    return archives.select("content").mapInArrow(rows, text_schema(names))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[io.BufferedReader]:
    """The members of the archives in a binary column, opened one after the other."""
    for batch in batches:
        for content in batch.column(0):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:  # no copy
                for member in archive.infolist():
                    if not member.is_dir():
                        with archive.open(member) as stream:
                            yield io.BufferedReader(stream)


def _read_header(stream: io.BufferedReader, encoding: str) -> list[str]:
    line = stream.readline().decode(encoding).rstrip("\r\n")
    return [_clean(name.strip('"')) for name in line.split("|")]


def _parse_member(stream, target: pa.Schema, encoding: str) -> Iterator[pa.RecordBatch]:
    found = _read_header(stream, encoding)
    if not stream.peek(1):  # a header and no row
        return
    with pa_csv.open_csv(
        stream,
        read_options=pa_csv.ReadOptions(
            column_names=found, block_size=ZIP_BLOCK_BYTES, encoding=encoding
        ),
        parse_options=pa_csv.ParseOptions(delimiter="|"),
        convert_options=pa_csv.ConvertOptions(
            column_types={name: pa.string() for name in found}
        ),
    ) as reader:
        for batch in reader:
            columns = [
                batch.column(name) if name in found else pa.nulls(batch.num_rows, pa.string())
                for name in target.names
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)


def _clean(name: str) -> str:
    return name.lower().replace(" ", "_")


def clean_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case with `_` for spaces."""
    return df.toDF(*[_clean(name) for name in df.columns])


def rename_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New column names by position."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns read, {len(names)} names given")
    return df.toDF(*names)


def null_tokens(df: DataFrame, tokens: Sequence[str] = S.NULL_TOKENS) -> DataFrame:
    """Text that means "missing" becomes NULL in every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in texts}
    )


def coerce(df: DataFrame, types: Mapping[str, T.DataType]) -> DataFrame:
    """Typed columns; a value that is not of the type becomes NULL, as does 2.5 for an integer."""
    has = {f.name: f.dataType for f in df.schema.fields}
    wanted = {c: dtype for c, dtype in types.items() if c in has and has[c] != dtype}
    return df.withColumns({c: _typed(F.col(c), dtype) for c, dtype in wanted.items()})


def _typed(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return column.cast(dtype)
    if isinstance(dtype, T.IntegralType):
        # "5.0" is the integer 5; the slower reading is tried only where the plain one fails.
        number = column.try_cast("decimal(38,10)")
        whole = F.when(number == F.floor(number), number.try_cast(dtype))
        return F.coalesce(column.try_cast(dtype), whole)
    return column.try_cast(dtype)


def with_plan_key(df: DataFrame) -> DataFrame:
    """Adds `plan_key` where all its parts exist as columns."""
    if all(part in df.columns for part in S.PLAN_KEY_PARTS):
        return df.withColumn("plan_key", plan_key())
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns and types of a schema; columns not delivered are NULL."""
    numbers = {f.name: f.dataType for f in schema.fields}
    typed = coerce(df, numbers)
    return typed.select(*[
        F.col(f.name) if f.name in typed.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


Renames = Mapping[str, str]


def _named(df: DataFrame, table: str, renames: Renames | None = None) -> DataFrame:
    """The columns of a delivered text table by the names of the data model."""
    named = clean_columns(df).withColumnsRenamed(dict(renames or {}))
    positions = S.POSITIONAL.get(table, [])
    if len(positions) == len(named.columns) and not set(positions) <= set(named.columns):
        named = rename_positional(named, positions)
    return named


def prepare(df: DataFrame, table: str, renames: Renames | None = None) -> DataFrame:
    """A delivered text table as the typed table of that name.

    `renames` maps column names of the delivered header, in lower case, to those of the schema.
    Where the header names columns differently but their number is the known one, they
    are taken by position. Tables without a fixed schema keep their columns as text.
    """
    cleaned = with_plan_key(null_tokens(_named(df, table, renames)))
    return conform(cleaned, S.SCHEMAS[table]) if table in S.SCHEMAS else cleaned


def prepare_checked(
    df: DataFrame, table: str, origin: str | None = None, renames: Renames | None = None
) -> DataFrame:
    """As `prepare`, with a column REJECTED that tells what became NULL because of its type.

    It is NULL in a row without such values, otherwise (file, row, values): where the row comes
    from, its delivered columns parted by `|`, and (column, text, reason) of each value. Text
    that means "missing" is not rejected. A column `origin` of df, if named, is no delivered column
    but tells where rows come from; otherwise that is the file that Spark reads.
    """
    schema = S.SCHEMAS.get(table)
    if schema is None:
        return prepare(df.drop(origin) if origin else df, table, renames)
    file = F.col(origin) if origin else F.input_file_name()
    df = df.withColumn("file_", file).drop(*([origin] if origin else []))
    names = _named(df.drop("file_"), table, renames).columns
    shown = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in names])
    cleaned = with_plan_key(null_tokens(df.toDF(*names, "file_").withColumn("row_", shown)))
    typed = {f.name: f.dataType for f in schema.fields if not isinstance(f.dataType, T.StringType)}
    values = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & _typed(F.col(c), dtype).isNull(), F.struct(
            F.lit(c).alias("column"), F.col(c).alias("text"), _reason(F.col(c), dtype).alias("reason")
        )) for c, dtype in typed.items() if c in cleaned.columns
    ]))
    rejected = F.when(F.size(values) > 0, F.struct(
        F.col("file_").alias("file"), F.col("row_").alias("row"), values.alias("values")
    )) if set(typed) & set(cleaned.columns) else F.lit(None).cast(REJECTED_TYPE)
    found = conform(cleaned.withColumn(REJECTED, rejected), T.StructType([
        *schema.fields, T.StructField(REJECTED, T._parse_datatype_string(REJECTED_TYPE))
    ]))
    return found


def _reason(column: Column, dtype: T.DataType) -> Column:
    number = column.try_cast("double")
    reason = F.when(number.isNull(), "not a number")
    if isinstance(dtype, T.IntegralType):
        reason = reason.when(number != F.floor(number), "not a whole number")
    return reason.otherwise("out of range")


def read_drug_names(spark: SparkSession, path: str) -> DataFrame:
    """Drug descriptions from JSON files, each one object `{"rxcui": "description"}`.

    One object is one task, so a large dictionary is best delivered as several files.
    """
    entries = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("rxcui", "description")
    )
    return conform(entries, S.DRUG_NAMES)
