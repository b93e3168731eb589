import os

import pytest

from binloom.llm import queries
from tests.sqlcheck import DATA, connect, same_rows

SQL = queries.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_rows(queries.queries()[name](spark, DATA), SQL[name], connect())
