import pytest

import __spark_entry__ as entry
from orewright.plans import core_queries, file_queries, mining_queries

SQL = core_queries.oracle_sql() | mining_queries.oracle_sql() | file_queries.oracle_sql()
QUERIES = core_queries.queries() | mining_queries.queries() | file_queries.queries()


def test_entry(spark):
    assert entry.entry(spark).columns == ["id_a", "id_b", "common", "similarity"]


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, agree):
    agree(QUERIES[name], SQL[name])


def test_bounded_streams(spark):
    """Estimates of a bounded sample: a row for each full window, none negative, and none above all triples of its edges."""
    from tests.conftest import DATA

    for name in ("triest_impr_stream", "triest_base_stream"):
        edges = QUERIES["edge_list"](spark, f"{DATA}/sf0.001").count()
        rows = QUERIES[name](spark, f"{DATA}/sf0.001").collect()
        assert sorted(r.window_id for r in rows) == list(range(edges // mining_queries.WINDOW))
        assert all(r.n == mining_queries.WINDOW and 0 <= r.estimate <= edges**1.5 for r in rows)


def test_spectral_clusters(spark):
    from tests.conftest import DATA

    rows = QUERIES["spectral_clusters"](spark, f"{DATA}/sf0.001").collect()
    assert len({r.id for r in rows}) == len(rows) == spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").count()
    assert {r.cluster for r in rows} == {0, 1, 2, 3}
