"""Registered queries over whole tables for similarity, patterns, graphs, clustering and partitioning, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.functions.hashing import MODULUS, linear_family
from orewright.operators import graph, partition, patterns, similarity, spectral, triest
from orewright.operators.overlaps import common_pairs
from orewright.session import discard, materialize, ship
from orewright.sources import readers
from orewright.streaming import triest_stream

K, HASHES, THRESHOLD, SUPPORT, CONFIDENCE = 10, 150, 0.8, 0.01, 0.5
SAMPLE, WINDOW, COLOURS = 5_000, 5_000, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sets(spark: SparkSession, sf_dir: str, method: str | None = None) -> DataFrame:
    return similarity.shingle_sets(table(spark, sf_dir, "doc_files"), "file_id", "content", K, method)


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(similarity.minhash_signatures(_sets(spark, sf_dir, "md5"), HASHES), "signatures")


def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_files").select("file_id", readers.base_name(F.col("file_name")).alias("doc_name"))


def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select(F.col("id").alias("file_id"), "n")


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir, "wide")
    pairs = similarity.jaccard_pairs(sets)
    discard(sets)
    return pairs


def jaccard_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.jaccard_pairs(_sets(spark, sf_dir, "wide"), THRESHOLD)


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select(F.col("id").alias("file_id"), F.posexplode("signature").alias("i", "v"))


def minhash_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal positions for all pairs with at least one; a position and its value are one element of a set."""
    signatures = _signatures(spark, sf_dir)
    placed = F.transform("signature", lambda v, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(v))
    pairs = common_pairs(signatures.select("id", placed.alias("shingles"), F.size("signature").cast("long").alias("n")))
    discard(signatures)
    return pairs.select("id_a", "id_b", (F.col("common") / F.lit(HASHES)).alias("estimate"))


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.lsh_candidates(_signatures(spark, sf_dir), THRESHOLD, HASHES)


def lsh_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatures = _signatures(spark, sf_dir)
    return similarity.score_candidates(similarity.lsh_candidates(signatures, THRESHOLD, HASHES), signatures)


def lsh_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, *similarity.find_parameters(t, HASHES)) for t in (0.3, 0.5, 0.8, 0.9)]
    return spark.createDataFrame(rows, "threshold double, bands long, rows_per_band long")


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.distinct_baskets(table(spark, sf_dir, "baskets"), "basket_id", "items")


def _itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.find_frequent_items(_baskets(spark, sf_dir), SUPPORT)


def frequent_items_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.find_frequent_items(_baskets(spark, sf_dir), SUPPORT, max_size=1).select(F.get("items", F.lit(0)).alias("item"), "freq")


def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _itemsets(spark, sf_dir).select(F.array_join("items", ",").alias("items"), "freq", F.col("size").cast("long").alias("size"))


def frequent_itemsets_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.find_frequent_items(_baskets(spark, sf_dir), SUPPORT, method="fpgrowth")
    return found.select(F.array_join("items", ",").alias("items"), "freq", F.col("size").cast("long").alias("size"))


def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = patterns.get_rules(materialize(_itemsets(spark, sf_dir), "itemsets"), CONFIDENCE)
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), "freq", "confidence")


def edge_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "edge_lines").select("line_id", readers.edge_of(F.col("line")).alias("e"))
    return parsed.filter("e is not null").select("line_id", "e.u", "e.v")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(graph.canonical_edges(table(spark, sf_dir, "edges"), seq="seq"), "edges")


def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_edges(table(spark, sf_dir, "edges"), seq="seq")


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


def triangles_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(_edges(spark, sf_dir)).agg(F.count(F.lit(1)).alias("triangles"))


def triangles_per_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles_per_vertex(_edges(spark, sf_dir))


def triangle_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangle_count_windows(_edges(spark, sf_dir), WINDOW)


def triest_base_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = triest.triest_base(_edges(spark, sf_dir), SAMPLE, seed=7)
    return found.select("t", "sampled", "triangles", F.round("estimate", 4).alias("estimate"))


def _stream(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    path = edges.inputFiles()[0].rsplit("/", 1)[0]
    stream = triest_stream.triest_stream(spark.readStream.schema(edges.schema).parquet(path), SAMPLE, method)
    estimates = triest_stream.run_to_table(stream, f"{path}-{method.lower()}")
    return triest_stream.count_windows(estimates, WINDOW)


def triest_impr_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "IMPR")


def triest_base_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "BASE")


def _arcs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs between dense ids, vertices with ids, number of vertices) of the symmetric closure of the links."""
    links = materialize(graph.both_directions(graph.canonical_edges(table(spark, sf_dir, "graph_links"), "src", "dst")), "links")
    named = materialize(partition.dense_ids(links, "src"), "vertices")
    arcs = links.join(named.toDF("src", "s"), "src").join(named.toDF("dst", "d"), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return materialize(arcs, "arcs"), named, named.agg(F.count(F.lit(1)).alias("total"))


def _coloured(named: DataFrame, total: DataFrame, policy: str) -> DataFrame:
    colour = partition.initial_colour(F.col("id"), F.col("total"), COLOURS, policy)
    return named.join(F.broadcast(total)).select("id", "vertex", colour.alias("color"), colour.alias("init_color"))


def color_init_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, total = _arcs(spark, sf_dir)
    return _coloured(named, total, "ROUND_ROBIN").select("vertex", "id", "color")


def color_init_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, total = _arcs(spark, sf_dir)
    return _coloured(named, total, "BATCH").select("vertex", "id", "color")


def color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, total = _arcs(spark, sf_dir)
    return partition.colour_histogram(_coloured(named, total, "BATCH"))


def color_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, named, total = _arcs(spark, sf_dir)
    return partition.colour_degrees(arcs, _coloured(named, total, "ROUND_ROBIN"))


def edge_cut_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, named, total = _arcs(spark, sf_dir)
    made = [partition.report(arcs, _coloured(named, total, p)).select(F.lit(p).alias("policy"), "edge_cut", "migrations") for p in ("ROUND_ROBIN", "BATCH")]
    return made[0].unionByName(made[1])


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, named, total = _arcs(spark, sf_dir)
    coloured = _coloured(named, total, "ROUND_ROBIN")
    pairs = partition.local_candidates(arcs, 3, seed=0, turn=0)
    return partition.score_pairs(pairs, coloured, partition.colour_degrees(arcs, coloured), 2.0)


def jabeja_partner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


def jabeja_best_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.best_partner(partition.accepted(_scores(spark, sf_dir), 2.0, partition.Config(), 0))


def jabeja_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs, _, _ = _arcs(spark, sf_dir)
    return partition.jabeja(arcs, rounds=10, delta=0.1, policy="RANDOM")[1]


def _cooling(values: list[float]) -> list[tuple[int, float]]:
    return [(i, round(t, 6)) for i, t in enumerate(values)]


def jabeja_cooling_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_cooling(partition.cool_linear(2.0, 0.3, 10)), "round long, temperature double")


def jabeja_cooling_check_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_cooling(partition.cool_linear_late(2.0, 0.3, 10)), "round long, temperature double")


def jabeja_cooling_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_cooling(partition.cool_exponential(10)), "round long, temperature double")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))


def affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.affinity(spectral.distances(_points(spark, sf_dir))).select("i", "j", F.round("w", 6).alias("w"))


def affinity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.affinity_degrees(spectral.affinity(spectral.distances(_points(spark, sf_dir)))).select("i", F.round("degree", 4).alias("degree"))


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = materialize(spectral.affinity(spectral.distances(_points(spark, sf_dir))), "affinity")
    return spectral.laplacian(weights).select("i", "j", F.round("w", 7).alias("w"))


def spectral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.spectral_cluster(_points(spark, sf_dir))


def optimal_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.optimal_sigma(_points(spark, sf_dir))


_ALL = (
    document_names, shingle_counts, jaccard_pairs, jaccard_near_dups, minhash_signatures, minhash_pair_similarity, lsh_candidates, lsh_scored, lsh_parameters,
    frequent_items_l1, frequent_itemsets, frequent_itemsets_fpgrowth, association_rules, edge_line_pairs, edge_list, degrees, triangles_total, triangles_per_vertex,
    triangle_count_windows, triest_base_final, triest_impr_stream, triest_base_stream, color_init_round_robin, color_init_batch, color_histogram, color_degrees,
    edge_cut_report, jabeja_partner_scores, jabeja_best_partner, jabeja_rounds, jabeja_cooling_linear, jabeja_cooling_check_linear, jabeja_cooling_exponential,
    affinity, affinity_degree, laplacian, spectral_clusters, optimal_sigma,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_SHINGLES = f"""t as (select file_id as id, replace(content, chr(13) || chr(10), ' ') as s from doc_files where content is not null),
sh as (select distinct id, substr(s, i::bigint, {K}) as x from (select id, s, unnest(range(1, length(s) - {K} + 2)) as i from t)),
n as (select t.id, count(x) as n from t left join sh using (id) group by t.id)"""
_COMMON = f"""{_SHINGLES}, c as (select a.id as id_a, b.id as id_b, count(*) as common from sh a join sh b on a.x = b.x and a.id < b.id group by all),
j as (select id_a, id_b, common, common / (a.n + b.n - common) as similarity from c join n a on a.id = id_a join n b on b.id = id_b)"""
_FAMILY = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(linear_family(HASHES, 1)))
_SIGNED = f"""{_SHINGLES}, h(i, a, b) as (values {_FAMILY}),
x as (select distinct id, ('0x' || substr(md5(x), 1, 8))::bigint % {MODULUS} as x from sh),
sg as (select id, i, min((a::bigint * x + b) % {MODULUS}) as v from x, h group by id, i)"""
_BANDS, _ROWS = similarity.find_parameters(THRESHOLD, HASHES)
_LSH = f"""{_SIGNED}, bd as (select id, i // {_ROWS} as band, string_agg(v::varchar, ',' order by i) as k from sg group by id, i // {_ROWS}),
cd as (select distinct a.id as id_a, b.id as id_b from bd a join bd b on a.band = b.band and a.k = b.k and a.id < b.id)"""
_ITEMSETS = f"""l as (select distinct basket_id as o, item as i from (select basket_id, unnest(items) as item from baskets) where item is not null and basket_id is not null),
m as (select count(distinct o) * {SUPPORT} as least from l),
f1 as (select i, count(*) as freq from l group by i having count(*) >= (select least from m)),
g as (select l.* from l join f1 using (i)),
f2 as (select a.i as i1, b.i as i2, count(*) as freq from g a join g b on a.o = b.o and a.i < b.i group by all having count(*) >= (select least from m)),
f3 as (select a.i as i1, b.i as i2, c.i as i3, count(*) as freq from g a join g b on a.o = b.o and a.i < b.i join g c on c.o = b.o and b.i < c.i group by all having count(*) >= (select least from m)),
f4 as (select a.i as i1, b.i as i2, c.i as i3, d.i as i4, count(*) as freq from f3 join g a on a.i = f3.i1 join g b on a.o = b.o and b.i = f3.i2 join g c on c.o = b.o and c.i = f3.i3
  join g d on d.o = c.o and c.i < d.i group by all having count(*) >= (select least from m)),
f5 as (select a.i as i1, b.i as i2, c.i as i3, d.i as i4, e.i as i5, count(*) as freq from f4 join g a on a.i = f4.i1 join g b on a.o = b.o and b.i = f4.i2 join g c on c.o = b.o and c.i = f4.i3
  join g d on d.o = c.o and d.i = f4.i4 join g e on e.o = d.o and d.i < e.i group by all having count(*) >= (select least from m)),
s as (select [i] as k, freq from f1 union all select [i1, i2], freq from f2 union all select [i1, i2, i3], freq from f3 union all select [i1, i2, i3, i4], freq from f4
  union all select [i1, i2, i3, i4, i5], freq from f5)"""
_SETS = f"with {_ITEMSETS} select array_to_string(k, ',') as items, freq, len(k) as size from s"
_EDGES = "e as (select least(u, v) as u, greatest(u, v) as v, min(seq) as seq from edges where u is not null and v is not null and u <> v group by all)"
_TRIANGLES = "tr as (select x.u as a, x.v as b, y.v as c, greatest(x.p, y.p, z.p) as p from ep x join ep y on y.u = x.v join ep z on z.u = x.u and z.v = y.v)"
_PLACED = f"{_EDGES}, ep as (select *, row_number() over (order by seq, u, v) as p from e)"
_LINKS = f"""e as (select distinct least(src, dst) as u, greatest(src, dst) as v from graph_links where src is not null and dst is not null and src <> dst),
r as (select u as s, v as d from e union all select v, u from e),
vx as (select vertex, row_number() over (order by vertex) as id, count(*) over () as total from (select distinct s as vertex from r)),
arc as (select a.id as src, b.id as dst from r join vx a on a.vertex = s join vx b on b.vertex = d),
rr as (select *, (id % {COLOURS})::int as color from vx), ba as (select *, ((id * {COLOURS} + total - 1) // total - 1)::int as color from vx)"""
_CUT = "(select count(*) // 2 from arc join {0} a on a.id = src join {0} b on b.id = dst where a.color <> b.color)"
_SCORES = f"""{_LINKS}, dg as (select src, color, count(*) as n from arc join rr on rr.id = dst group by all),
cd as (select src as p, dst as q from (select *, row_number() over (partition by src order by md5('0:0:local:' || src || ':' || dst), dst) as k from arc) where k <= 3),
sc as (select p, q, (pow(coalesce(pp.n, 0), 2) + pow(coalesce(qq.n, 0), 2))::double as old, (pow(coalesce(pq.n, 0), 2) + pow(coalesce(qp.n, 0), 2))::double as new
  from cd join rr a on a.id = p join rr b on b.id = q left join dg pp on pp.src = p and pp.color = a.color left join dg qq on qq.src = q and qq.color = b.color
  left join dg pq on pq.src = p and pq.color = b.color left join dg qp on qp.src = q and qp.color = a.color where a.color <> b.color)"""
_WEIGHTS = """w as (select a.vec_id as i, b.vec_id as j, exp(-pow(list_distance(a.embedding::double[], b.embedding::double[]), 2) / (2 * 1.5 * 1.5)) as w
  from embeddings a join embeddings b on a.vec_id <> b.vec_id), dg as (select i, sum(w) as degree from w group by i)"""


def oracle_sql() -> dict[str, str]:
    return {
        "document_names": "select file_id, split_part(file_name, '/', -1) as doc_name from doc_files",
        "shingle_counts": f"with {_SHINGLES} select id as file_id, n from n",
        "jaccard_pairs": f"with {_COMMON} select * from j",
        "jaccard_near_dups": f"with {_COMMON} select * from j where similarity >= {THRESHOLD}",
        "minhash_signatures": f"with {_SIGNED} select id as file_id, i, v from sg",
        "minhash_pair_similarity": f"with {_SIGNED} select a.id as id_a, b.id as id_b, count(*) / {HASHES} as estimate from sg a join sg b on a.i = b.i and a.v = b.v and a.id < b.id group by all",
        "lsh_candidates": f"with {_LSH} select * from cd",
        "lsh_scored": f"with {_LSH} select id_a, id_b, sum((a.v = b.v)::int) / {HASHES} as estimate from cd join sg a on a.id = id_a join sg b on b.id = id_b and a.i = b.i group by all",
        "lsh_parameters": f"""with d as (select unnest(range(1, {HASHES + 1})) as r), o as (select t, {HASHES} // r as b, r, abs(t - pow(1 / ({HASHES} // r), 1 / r)) as gap
  from d, (values (0.3), (0.5), (0.8), (0.9)) v(t) where {HASHES} % r = 0)
select t::double as threshold, min_by(b, gap)::bigint as bands, min_by(r, gap)::bigint as rows_per_band from o group by t""",
        "frequent_items_l1": f"with {_ITEMSETS} select i as item, freq from f1",
        "frequent_itemsets": _SETS,
        "frequent_itemsets_fpgrowth": _SETS,
        "association_rules": f"""with {_ITEMSETS}, sp as (select k, freq, unnest(range(1, (1 << len(k)) - 1)) as mask from s),
ac as (select k, freq, list_filter(k, lambda x, i: (mask >> (i - 1)) & 1 = 1) as a, list_filter(k, lambda x, i: (mask >> (i - 1)) & 1 = 0) as c from sp)
select array_to_string(a, ',') as antecedent, array_to_string(c, ',') as consequent, ac.freq, ac.freq / s.freq as confidence from ac join s on s.k = ac.a where ac.freq / s.freq >= {CONFIDENCE}""",
        "edge_line_pairs": r"""select line_id, regexp_extract(line, '^\s*([0-9]+)\s+([0-9]+)(\s|$)', 1)::bigint as u, regexp_extract(line, '^\s*([0-9]+)\s+([0-9]+)(\s|$)', 2)::bigint as v
from edge_lines where regexp_matches(line, '^\s*([0-9]+)\s+([0-9]+)(\s|$)')""",
        "edge_list": f"with {_EDGES} select * from e",
        "degrees": f"with {_EDGES} select vertex, count(*) as degree from (select u as vertex from e union all select v from e) group by vertex",
        "triangles_total": f"with {_PLACED}, {_TRIANGLES} select count(*) as triangles from tr",
        "triangles_per_vertex": f"""with {_PLACED}, {_TRIANGLES}, k as (select vertex, count(*) as n from (select a as vertex from tr union all select b from tr union all select c from tr) group by vertex)
select vertex, coalesce(n, 0) as triangles from (select u as vertex from e union select v from e) left join k using (vertex)""",
        "triangle_count_windows": f"""with {_PLACED}, {_TRIANGLES}, cl as (select p, count(*) as n from tr group by p),
ru as (select ep.p, sum(coalesce(n, 0)) over (order by ep.p) as tau from ep left join cl using (p))
select (p - 1) // {WINDOW} as window_id, count(*) as n, max(tau)::double as estimate from ru group by (p - 1) // {WINDOW} having count(*) = {WINDOW}""",
        "triest_base_final": f"""with {_EDGES}, ep as (select *, 0 as p from e order by md5('7:' || u || '-' || v), u, v limit {SAMPLE}), {_TRIANGLES}, k as (select count(*) as triangles from tr), n as (select count(*) as t from e)
select t, least(t, {SAMPLE}) as sampled, triangles, round(triangles * greatest(1.0::double, t::double * (t - 1) * (t - 2) / ({SAMPLE}::double * {SAMPLE - 1} * {SAMPLE - 2})), 4) as estimate from n, k""",
        "color_init_round_robin": f"with {_LINKS} select vertex, id, color from rr",
        "color_init_batch": f"with {_LINKS} select vertex, id, color from ba",
        "color_histogram": f"with {_LINKS} select color, count(*) as n from ba group by color",
        "color_degrees": f"with {_LINKS} select src, color, count(*) as n from arc join rr on rr.id = dst group by all",
        "edge_cut_report": f"with {_LINKS} select 'ROUND_ROBIN' as policy, {_CUT.format('rr')} as edge_cut, 0::bigint as migrations union all select 'BATCH', {_CUT.format('ba')}, 0",
        "jabeja_partner_scores": f"with {_SCORES} select * from sc",
        "jabeja_best_partner": f"with {_SCORES} select p, q, old, new from (select *, row_number() over (partition by p order by new desc, q) as k from sc where new * 2 > old) where k = 1",
        "jabeja_cooling_linear": "select i as round, round(greatest(1.0::double, 2.0::double - 0.3::double * (i + 1)), 6) as temperature from (select unnest(range(10)) as i)",
        "jabeja_cooling_check_linear": """with recursive c(i, t) as (select 0::bigint, 2.0::double - 0.3::double union all select i + 1, case when t > 1 then t - 0.3::double else 1.0 end from c where i < 9)
select i as round, round(t, 6) as temperature from c""",
        "jabeja_cooling_exponential": "select i as round, round(pow(0.99::double, i + 1), 6) as temperature from (select unnest(range(10)) as i)",
        "affinity": f"with {_WEIGHTS} select i, j, round(w, 6) as w from w",
        "affinity_degree": f"with {_WEIGHTS} select i, round(degree, 4) as degree from dg",
        "laplacian": f"with {_WEIGHTS} select w.i, w.j, round(w.w / (sqrt(a.degree) * sqrt(b.degree)), 7) as w from w join dg a on a.i = w.i join dg b on b.i = w.j",
    }
