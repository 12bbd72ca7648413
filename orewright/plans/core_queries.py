"""Registered queries of the general operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.operators import skew
from orewright.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.hot_vertices(table(spark, sf_dir, "edges"), table(spark, sf_dir, "graph_links")).select("origin", "vertex")


def p2_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.vertex_degrees(table(spark, sf_dir, "edges"), table(spark, sf_dir, "graph_links"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = skew.neighbour_lists(table(spark, sf_dir, "edges"), table(spark, sf_dir, "graph_links"))
    return lists.select("origin", "vertex", "chunk", "first_row", F.array_join("neighbours", ",").alias("neighbours"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_degrees, p2_neighbours)}


_ENDS = """select 'edges' as origin, u as vertex, v as neighbour from edges where u is not null
union all select 'edges', v, u from edges where v is not null and (u is null or u <> v)
union all select 'graph_links', src::bigint, dst::bigint from graph_links where src is not null"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""with e as ({_ENDS}), t as (select 'edges' as origin, count(*) as n from edges union all select 'graph_links', count(*) from graph_links)
select origin, vertex from e join t using (origin) group by origin, vertex, n having count(*) * 100 >= n""",
        "p2_degrees": f"""with e as ({_ENDS}) select origin, vertex, count(*)::bigint as rows,
count(distinct case when neighbour <> vertex then neighbour end) as neighbours from e group by origin, vertex""",
        "p2_neighbours": f"""with e as (select distinct * from ({_ENDS}) where neighbour <> vertex),
r as (select *, row_number() over (partition by origin, vertex order by neighbour) - 1 as k from e)
select origin, vertex, k // 50000 as chunk, min(k) as first_row, string_agg(neighbour::varchar, ',' order by neighbour) as neighbours from r group by origin, vertex, k // 50000""",
    }
