import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"

#: Texts that operators must bear: null, empty, blank, one word, ties, repeats, long, odd.
ODD = [
    None, "", "  \n\t ", "word", "same text here", "same text here", "é ß 日本語 😀 \x1c \x85 .",
    "<|endoftext|> </s>[INST] \\ password = \"abcdef0123456789\"", "a" * 100_000,
    "la la la " * 30_000, "x\x00y", "AKIA" + "Z" * 16,
]


@pytest.fixture
def docs(spark):
    """Builds documents of texts, numbered, with columns that clash with inner names."""

    def build(texts, ids=None, **columns):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in zip(ids, texts)]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        df = spark.createDataFrame(rows, schema)
        from pyspark.sql import functions as F

        for name in ("word", "bits", "suspect_", "r_", "print_", "cell", "node", "kept", "score"):
            df = df.withColumn(name, F.lit(name))
        return df

    return build


@pytest.fixture
def odd(docs):
    """The odd texts, one row twice with the same doc_id, one row without."""
    return docs([*ODD, ODD[4], "no id"], [*range(len(ODD)), 4, None])


@pytest.fixture
def empty(docs):
    return docs([])


@pytest.fixture(scope="session")
def table():
    """Rows of a test table, ordered."""

    def rows(name, order="1"):
        return duckdb.sql(f"SELECT * FROM '{SF_DIR}/{name}.parquet' ORDER BY {order}").fetchall()

    return rows
