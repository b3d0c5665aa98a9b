"""Registered queries that SQL can express give the SQL's rows."""

import pytest

from tests import oracle
from tidewell.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows(spark, name):
    columns, found = oracle.of_spark(q.QUERIES[name](spark, SF))
    wanted_columns, wanted = oracle.of_sql(q.SQL[name], SF)
    assert columns == wanted_columns
    assert found == wanted
    assert sum(found.values()) > 0
