import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pactframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 4)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture
def frame(spark):
    """frame(rows, ddl): a DataFrame; text in timestamp and date columns is cast."""

    def make(rows, ddl):
        plain = ddl.replace(" timestamp", " string").replace(" date", " string")
        df = spark.createDataFrame(rows, plain)
        for part in ddl.split(","):
            name, kind = part.split()[:2]
            if kind in ("timestamp", "date"):
                df = df.withColumn(name, df[name].cast(kind))
        return df

    return make


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
