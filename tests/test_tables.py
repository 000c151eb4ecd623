"""Readers of the declared tables."""

import pytest
from pyspark.errors import AnalysisException

from pactframe.session import new_folder
from pactframe.sources.schemas import DOMAIN_SCHEMAS
from pactframe.sources.tables import read_table


@pytest.mark.parametrize("table", sorted(DOMAIN_SCHEMAS))
def test_every_declared_table_is_read_with_its_schema(spark, table):
    empty = spark.createDataFrame([], DOMAIN_SCHEMAS[table])
    path = new_folder(spark, f"declared-{table}")
    empty.write.parquet(path)
    back = read_table(spark, path, table)
    assert back.dtypes == empty.dtypes
    assert back.count() == 0


def test_a_missing_table_is_an_error(spark):
    with pytest.raises(AnalysisException):
        read_table(spark, new_folder(spark, "nowhere"), "contracts").count()
