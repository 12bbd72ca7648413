"""Registered queries over files that are written from the tables, and over whole runs, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.functions.hashing import string_hash
from orewright.operators import partition, similarity, spectral
from orewright.plans import mining_queries as mining
from orewright.plans.mining_queries import COLOURS, HASHES, THRESHOLD, WINDOW, table
from orewright.session import discard, drop_folder, materialize, new_folder
from orewright.sources import readers, writers
from orewright.streaming import triest_stream

#: Files that are written and read at once, about.
FILES = 100_000
#: Buckets into which bands are folded where all bands share them.
BUCKETS = 10_000


def documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file for each row, read back whole; at most about FILES files are there at once, those read are deleted."""
    files = table(spark, sf_dir, "doc_files").filter("content is not null").select("file_id", "content")
    rounds = max(1, -(-files.count() // FILES))
    found = []
    for turn in range(rounds):
        path = new_folder(spark, "document_files")
        own = files.filter(F.pmod(F.xxhash64("file_id", "content"), F.lit(rounds)) == turn)
        folders = writers.write_documents(own, "file_id", "content", path)
        if folders:
            read = readers.read_documents(spark, folders)
            key = F.regexp_extract("path", r"file_id=(-?\d+)", 1).try_cast("long").alias("file_id")
            found.append(materialize(read.select(key, F.length("text").cast("long").alias("length"), F.md5("text").alias("hash")), "documents"))
        drop_folder(spark, path)
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "file_id long, length long, hash string")


def baskets_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of items, read back: how many baskets hold each set."""
    path = new_folder(spark, "basket_lines")
    writers.write_text(table(spark, sf_dir, "baskets").select(F.array_join("items", " ").alias("line")), "line", path)
    read = readers.read_baskets(spark, path)
    return read.select(F.array_join(F.sort_array("items"), ",").alias("items"), "basket_id").groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("basket_id").alias("numbers"))


def _line_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "edge_lines")
    writers.write_text(table(spark, sf_dir, "edge_lines"), "line", path)
    return path


def edges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = readers.read_edges(spark, _line_files(spark, sf_dir))
    return read.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("numbers"))


def edges_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _line_files(spark, sf_dir)
    return triest_stream.run_to_table(readers.stream_lines(spark, path), new_folder(spark, "streamed")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))


def points_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "point_lines")
    values = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    writers.write_text(table(spark, sf_dir, "embeddings").select(F.array_join(values, ", ").alias("line")), "line", path)
    read = readers.read_points(spark, path)
    return read.select(F.size("features").cast("long").alias("n"), F.get("features", F.lit(0)).alias("first"), F.element_at("features", -1).alias("last"))


def adjacency_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adjacency file with its first line and comments, read back as arcs."""
    arcs, named, _ = mining._arcs(spark, sf_dir)
    near = arcs.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list("dst")), " ").alias("line"))
    lines = named.select("id").join(near.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("line", F.lit("")).alias("line"))
    head = spark.createDataFrame([(-1, "% comment"), (0, "size"), (0, "# comment")], "id long, line string")
    path = new_folder(spark, "adjacency")
    writers.write_text(lines.unionByName(head).repartitionByRange("id").sortWithinPartitions("id", F.desc("line")), "line", path)
    return readers.read_adjacency(spark, path)[1]


def parts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of a partition that is read from a file of parts."""
    arcs, named, total = mining._arcs(spark, sf_dir)
    path = new_folder(spark, "parts")
    coloured = mining._coloured(named, total, "BATCH").repartitionByRange("id").sortWithinPartitions("id")
    writers.write_text(coloured.select("color"), "color", path)
    return partition.partition_report(arcs, readers.read_parts(spark, path))


def report_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two rounds appended to one file and read back."""
    path, rows = new_folder(spark, "report"), mining.edge_cut_report(spark, sf_dir)
    for turn, policy in enumerate(("ROUND_ROBIN", "BATCH")):
        writers.write_report(rows.filter(F.col("policy") == policy).drop("policy"), path, "append" if turn else "overwrite", policy=policy, colours=COLOURS)
    read = spark.read.option("sep", "\t").option("header", "true").csv(path)
    return read.select("policy", F.col("edge_cut").cast("long").alias("edge_cut"), F.col("migrations").cast("long").alias("migrations"), F.col("colours").cast("long").alias("colours"))


def text_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written, appended and read back."""
    path, lines = new_folder(spark, "text"), table(spark, sf_dir, "edge_lines").filter("line is not null")
    writers.write_text(lines.filter("line_id % 2 = 0"), "line", path)
    writers.write_text(lines.filter("line_id % 2 = 1"), "line", path, append=True)
    whole = writers.read_text(spark, path)
    return whole.select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def string_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edge_lines").filter("line is not null").select("line_id", string_hash(F.col("line")).alias("hash"))


def minhash_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = similarity.minhash_signatures(mining._sets(spark, sf_dir, "md5"), HASHES, argmin=True)
    return signed.select(F.col("id").alias("file_id"), F.posexplode("signature").alias("i", "x"))


def lsh_shared_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates where all bands share one set of buckets."""
    return similarity.lsh_candidates(mining._signatures(spark, sf_dir), THRESHOLD, HASHES, BUCKETS, True, "md5")


def jaccard_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of files with a shingle, pairs of similarity 0 too; quadratic by definition."""
    sets = mining._sets(spark, sf_dir, "wide")
    pairs = similarity.jaccard_pairs(sets, zeros=True)
    discard(sets)
    return pairs


def _whole_stream(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    edges = mining._edges(spark, sf_dir)
    path = edges.inputFiles()[0].rsplit("/", 1)[0]
    stream = triest_stream.triest_stream(spark.readStream.schema(edges.schema).parquet(path), 1 << 30, method)
    return triest_stream.count_windows(triest_stream.run_to_table(stream, f"{path}-{method.lower()}"), WINDOW)


def triest_impr_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for all edges the estimator is exact."""
    return _whole_stream(spark, sf_dir, "IMPR")


def triest_base_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_stream(spark, sf_dir, "BASE")


def jabeja_global_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, named, total = mining._arcs(spark, sf_dir)
    return partition.global_candidates(named.select("id"), total.first()[0], 6, seed=0, turn=0)


def jabeja_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that pass the exponential rule."""
    return partition.accepted(mining._scores(spark, sf_dir), 0.5, partition.Config(annealing="EXPONENTIAL"), 0).select("p", "q")


def jabeja_first_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colours after one synchronous round of HYBRID."""
    arcs, _, _ = mining._arcs(spark, sf_dir)
    return partition.jabeja(arcs, rounds=1)[0].select("id", "color")


def jabeja_run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures of a run that cools late, and how far its last report is from its colours; 4 rounds that append their report."""
    arcs, _, _ = mining._arcs(spark, sf_dir)
    path = new_folder(spark, "rounds")
    coloured, metrics = partition.jabeja(arcs, rounds=4, temperature=2.0, delta=0.6, annealing="LATE", reset=True, report_to=path)
    coloured, last = materialize(coloured, "final"), metrics.orderBy(F.desc("round")).first()
    cut, moved = partition.report(arcs, coloured).first()
    first = partition.colour_histogram(coloured.select(F.col("init_color").alias("color"))).toDF("color", "before")
    uneven = partition.colour_histogram(coloured).join(first, "color", "full").filter("not (n <=> before)").count()
    read = spark.read.option("sep", "\t").option("header", "true").csv(path)
    named = read.select(F.col("round").cast("long").alias("round"), F.round(F.col("temperature").cast("double"), 6).alias("temperature"))
    return named.withColumns({"cut_error": F.lit(cut - last.edge_cut).cast("long"), "migration_error": F.lit(moved - last.migrations).cast("long"), "uneven_colours": F.lit(uneven).cast("long")})


def _region_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each supplier, those of one region close together."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("r"))
    placed = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    jitter = [F.pmod(F.xxhash64("s_suppkey", F.lit(i)), F.lit(1000)) / 4000.0 for i in (0, 1)]
    return placed.select(F.col("s_suppkey").cast("long").alias("id"), F.array(F.col("r") * 50 + jitter[0], (F.col("r") % 2) * 50 + jitter[1]).alias("features"))


def spectral_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of well separated points, each named by its smallest member."""
    points = materialize(_region_points(spark, sf_dir), "points")
    k = points.select(F.round(F.get("features", F.lit(0)) / 50)).distinct().count()
    found = materialize(spectral.spectral_cluster(points, max(1, k)), "clusters")
    return found.join(found.groupBy("cluster").agg(F.min("id").alias("first")), "cluster").select("id", "first")


def spectral_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the embedded rows."""
    weights = materialize(spectral.affinity(spectral.distances(mining._points(spark, sf_dir))), "affinity")
    rows = spectral.embed(weights, 4)[0]
    return rows.select("id", F.size("features").cast("long").alias("k"), F.round(F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


_ALL = (
    documents_read, baskets_read, edges_read, edges_streamed, points_read, adjacency_read, parts_report, report_appended, text_appended, string_hashes, minhash_argmin,
    lsh_shared_candidates, jaccard_all_pairs, triest_impr_exact, triest_base_exact, jabeja_global_candidates, jabeja_accepted, jabeja_first_round, jabeja_run_checks,
    spectral_regions, spectral_rows,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_HEX = "('0x' || substr(md5({0}), 1, 8))::bigint"
_UNIFORM = "(" + _HEX + " / 4294967296::double)"
_EDGE = r"^\s*([0-9]+)\s+([0-9]+)(\s|$)"
_LINE_PAIRS = f"select regexp_extract(line, '{_EDGE}', 1)::bigint as u, regexp_extract(line, '{_EDGE}', 2)::bigint as v from edge_lines where regexp_matches(line, '{_EDGE}')"
_GLOBAL = f"""gs as (select id, total, i, floor({_UNIFORM.format("'0:0:global:' || id || ':' || i")} * (total - 1))::bigint + 1 as step from vx, (select unnest(range(13)) as i) where total > 1),
gf as (select id, total, step, min(i) as i from gs group by all),
gc as (select id as p, (id + step - 1) % total + 1 as q from (select *, row_number() over (partition by id order by i) as k from gf) where k <= least(6, total - 1))"""
_HYBRID = f"""{mining._SCORES}, {_GLOBAL},
gsc as (select p, q, (pow(coalesce(pp.n, 0), 2) + pow(coalesce(qq.n, 0), 2))::double as old, (pow(coalesce(pq.n, 0), 2) + pow(coalesce(qp.n, 0), 2))::double as new
  from gc join rr a on a.id = p join rr b on b.id = q left join dg pp on pp.src = p and pp.color = a.color left join dg qq on qq.src = q and qq.color = b.color
  left join dg pq on pq.src = p and pq.color = b.color left join dg qp on qp.src = q and qp.color = a.color where a.color <> b.color),
lb as (select p, q, old, new from (select *, row_number() over (partition by p order by new desc, q) as k from sc where new * 2 > old) where k = 1),
gb as (select p, q, old, new from (select *, row_number() over (partition by p order by new desc, q) as k from gsc where new * 2 > old) where k = 1 and p not in (select p from lb)),
cl as (select p, q, new - old as gain, md5('0:0:rank:' || least(p, q) || ':' || greatest(p, q) || ':' || p) as mark from (select * from lb union all select * from gb)),
en as (select *, row_number() over (partition by e order by gain desc, mark desc) as k from (select p as e, p, q, gain, mark from cl union all select q, p, q, gain, mark from cl)),
sw as (select x.p, x.q from en x join en y on x.p = y.p and x.q = y.q where x.e = x.p and y.e = y.q and x.k = 1 and y.k = 1),
mv as (select p as id, q as other from sw union all select q, p from sw)
select rr.id, coalesce(o.color, rr.color) as color from rr left join mv on mv.id = rr.id left join rr o on o.id = mv.other"""
_REGIONS = "p as (select s_suppkey::bigint as id, n_regionkey as r from supplier join nation on s_nationkey = n_nationkey)"


def oracle_sql() -> dict[str, str]:
    window = mining.oracle_sql()["triangle_count_windows"]
    return {
        "documents_read": "select file_id, length(t) as length, md5(t) as hash from (select file_id, replace(content || chr(10), chr(13) || chr(10), ' ') as t from doc_files where content is not null)",
        "baskets_read": """select array_to_string(s, ',') as items, count(*) as n, count(*) as numbers from (select list_sort(list_distinct(list_filter(items, lambda x: x is not null))) as s from baskets) where len(s) > 0 group by s""",
        "edges_read": f"select u, v, count(*) as n, count(*) as numbers from ({_LINE_PAIRS}) group by all",
        "edges_streamed": f"select u, v, count(*) as n from ({_LINE_PAIRS}) group by all",
        "points_read": "select len(embedding) as n, embedding[1]::double as first, embedding[-1]::double as last from embeddings",
        "adjacency_read": f"with {mining._LINKS} select src, dst from arc",
        "parts_report": f"with {mining._LINKS} select {mining._CUT.format('ba')} as edge_cut, 0::bigint as migrations",
        "report_appended": f"with {mining._LINKS} select 'ROUND_ROBIN' as policy, {mining._CUT.format('rr')} as edge_cut, 0::bigint as migrations, {COLOURS}::bigint as colours union all select 'BATCH', {mining._CUT.format('ba')}, 0, {COLOURS}",
        "text_appended": "select line, count(*) as n from edge_lines where line is not null group by line",
        "string_hashes": """select line_id, (case when h >= 2147483648 then h - 4294967296 else h end)::int as hash from (
  select line_id, list_reduce(list_prepend(0::bigint, list_transform(range(1, length(line) + 1), lambda i: unicode(substr(line, i, 1))::bigint)), lambda h, c: (h * 31 + c) % 4294967296) as h from edge_lines where line is not null)""",
        "minhash_argmin": f"with {mining._SHINGLES}, h(i, a, b) as (values {mining._FAMILY}), x as (select distinct id, {_HEX.format('x')} % {mining.MODULUS} as x from sh) select id as file_id, i, min_by(x, (a::bigint * x + b) % {mining.MODULUS}) as x from x, h group by id, i",
        "lsh_shared_candidates": f"""with {mining._SIGNED}, bd as (select id, {_HEX.format("string_agg(v::varchar, ',' order by i)")} % {BUCKETS} as k from sg group by id, i // {mining._ROWS})
select distinct a.id as id_a, b.id as id_b from bd a join bd b on a.k = b.k and a.id < b.id""",
        "jaccard_all_pairs": f"with {mining._COMMON}, m as (select id from n where n > 0) select a.id as id_a, b.id as id_b, coalesce(common, 0) as common, coalesce(similarity, 0.0::double) as similarity from m a join m b on a.id < b.id left join j on j.id_a = a.id and j.id_b = b.id",
        "triest_impr_exact": window,
        "triest_base_exact": window,
        "jabeja_global_candidates": f"with {mining._LINKS}, {_GLOBAL} select p, q from gc",
        "jabeja_accepted": f"""with {mining._SCORES}, ga as (select p, q, case when old = 0 and new = 0 then null when old = 0 then 'inf'::double when new = 0 then '-inf'::double else 1 / old - 1 / new end as gap from sc)
select p, q from ga where {_UNIFORM.format("'0:0:accept:' || p || ':' || q")} < least(1.0::double, exp(least(gap / 0.5::double, 0.0::double)))""",
        "jabeja_first_round": f"with {_HYBRID}",
        "jabeja_run_checks": """with recursive c(i, t) as (select 0::bigint, 2.0::double - 0.6::double union all select i + 1, case when t > 1 then t - 0.6::double else 2.0 end from c where i < 3)
select i as round, round(t, 6) as temperature, 0::bigint as cut_error, 0::bigint as migration_error, 0::bigint as uneven_colours from c""",
        "spectral_regions": f"with {_REGIONS} select id, min(id) over (partition by r) as first from p",
        "spectral_rows": "select vec_id as id, 4::bigint as k, 1.0::double as length from embeddings",
    }
