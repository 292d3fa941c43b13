import pytest
from compare import agrees

from rollcall.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, name):
    agrees(spark, QUERIES[name], ORACLE[name])
