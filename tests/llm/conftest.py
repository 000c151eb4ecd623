import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


def rows_of(table, columns="*"):
    return duckdb.sql(f"select {columns} from '{FOLDER}/{table}.parquet'").fetchall()


@pytest.fixture(scope="session")
def documents():
    return dict(rows_of("documents", "doc_id, text"))


@pytest.fixture
def docs(spark):
    """docs(rows): documents with an extra column whose name an operator uses itself."""

    def make(rows, extra="score"):
        return spark.createDataFrame([(*r, "own") for r in rows], f"doc_id long, text string, {extra} string")

    return make


LONG = "lorem ipsum dolor sit amet " * 40_000  # a million characters
# nulls, empty texts, white space only, a missing key, a very long text, repeated rows
EDGES = [
    (0, None), (1, ""), (2, " \n\t "), (None, "a text without a key but with more than ten words in it, so it counts"),
    (3, LONG), (4, "twice the same row, " * 3), (4, "twice the same row, " * 3), (5, "é ß 漢字 \U0001f600 mixed scripts"),
]
