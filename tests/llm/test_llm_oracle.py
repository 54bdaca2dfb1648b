import pytest

from tabulyse.llm.oracle import ORACLE
from tabulyse.llm.queries import QUERIES
from tests.oracle_compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_its_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) == []
