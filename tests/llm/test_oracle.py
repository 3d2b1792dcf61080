"""The queries that have SQL, on both engines."""

import pytest

from oracle_check import compare, connect
from termloom.llm.oracle import ORACLE
from termloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, rows, message = compare(
        spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR
    )
    assert ok and rows > 0 and not message, message
    assert name == "op11_hardneg" or rows == 200
