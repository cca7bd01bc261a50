import pytest

import __spark_entry__ as entry
from tests.oracle import connect, compare
from vexel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_against_sql(spark, name):
    a, b = compare(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name])
    assert len(a) and a.equals(b)


def test_all_ten_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
