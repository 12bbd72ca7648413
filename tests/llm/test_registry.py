import pytest

from orewright.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, agree):
    agree(queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_rows(name, spark):
    assert queries.queries()[name](spark, f"{DATA}/sf0.001").count() > 0
