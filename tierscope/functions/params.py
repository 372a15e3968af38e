"""Small parameter tables given by the caller, and where jobs may write."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def parameter_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A caller's list as a DataFrame; its size is known, so Spark decides how to join it."""
    return spark.createDataFrame(list(rows), schema)


def keep_values(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose column is in a caller's list: an IN filter, which reaches the scan."""
    return df.where(F.col(column).isin(sorted(set(values))))


def keep_matching(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose column has a value in a table of keys, kept before a big join.

    A semi join: Spark broadcasts the keys if they are small, and filters the scan by them at
    run time. Nothing runs until the result is asked for.
    """
    known = keys.where(F.col(column).isNotNull()).select(column).distinct()
    return df.join(known, column, "left_semi")


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct-valued scalar subquery (NULL when empty).

    Attaches totals to rows without a cross join.
    """
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new directory for an intermediate table.

    On a cluster it lies under the shared folder named by spark.checkpoint.dir; a
    machine-local folder is used only by a local master without that setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="tierscope-")
    return f"{root.rstrip('/')}/tierscope/{name}-{uuid.uuid4().hex}"
