import os
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tierscope import schemas as S  # noqa: E402
from tierscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", 4,
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Builds a table of the data model from dicts; columns left out are NULL."""

    def build(name, *rows):
        schema = S.SCHEMAS[name]
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
        data = [
            tuple(None if row.get(c) is None else str(row[c]) for c in schema.names)
            for row in rows
        ]
        df = spark.createDataFrame(data, text)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    return build


@pytest.fixture
def tables(make):
    """All tables of the data model, with the given ones filled."""

    def build(**rows):
        return {name: make(name, *rows.get(name, ())) for name in S.SCHEMAS}

    return build


def as_dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
