"""Registered queries of the operators in this subpackage, over whole tables, and the SQL some are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.llm import cooccurrence, format_duplicates, language, leaks, near_duplicates, reservoir, set_join, tokenizer, top_items
from orewright.session import materialize, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "edge_lines")
    _, repeats = format_duplicates.collapse(format_duplicates.edge_records(lines), ["low", "high", "kind"], lines.count())
    return repeats.select(F.col("first_id").alias("first_line_id"), F.col("id").alias("line_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "edge_lines")
    records, _ = format_duplicates.collapse(format_duplicates.edge_records(lines), ["low", "high", "kind"], lines.count())
    return records.select("low", "high", "kind", F.col("first_id").alias("first_line_id"), "copies")


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.sample(_table(spark, sf_dir, "edges"), 5_000, seed=3)


def p3_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sampled, invented): rows of the sample, and how many of them go beyond the times the table has that row."""
    edges = _table(spark, sf_dir, "edges")
    key = F.to_json(F.struct("*")).alias("row")
    drawn = materialize(reservoir.sample(edges, 5_000, seed=3).select(key), "drawn").groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    there = edges.select(key).groupBy("row").agg(F.count(F.lit(1)).alias("held"))
    beyond = F.greatest(F.col("n") - F.coalesce("held", F.lit(0)), F.lit(0))
    return drawn.join(there, "row", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sampled"), F.coalesce(F.sum(beyond), F.lit(0)).alias("invented"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.top_items(_table(spark, sf_dir, "baskets"), "basket_id", "items", 40).select("item")


def p4_top_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.top_items(_table(spark, sf_dir, "baskets"), "basket_id", "items", 40)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_text_pairs(_table(spark, sf_dir, "doc_files"), "file_id", "content")
    return pairs.select(F.col("id_a").alias("file_a"), F.col("id_b").alias("file_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates.similar_text_groups(_table(spark, sf_dir, "doc_files"), "file_id", "content")
    return groups.select(F.col("id").alias("file_id"), "group_id", "links")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_associations(spark, sf_dir).select("item_a", "item_b")


def p6_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.associated_pairs(_table(spark, sf_dir, "baskets"), "basket_id", "items").select("item_a", "item_b", "n", "n_a", "n_b", "n_all")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.associated_pairs(_table(spark, sf_dir, "baskets"), "basket_id", "items", "0", 0)


def p6_store_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that go together in stores: many sets are larger than a block, so that most pairs come from block pairs."""
    pairs = cooccurrence.associated_pairs(_table(spark, sf_dir, "baskets"), "store_id", "items", "0.1", 1)
    return pairs.select("item_a", "item_b", "n", "n_a", "n_b", "n_all")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    baskets = set_join.similar_id_pairs(_table(spark, sf_dir, "baskets"), "basket_id", "items")
    sets = set_join.similar_id_pairs(_table(spark, sf_dir, "shingle_sets"), "set_id", "shingles")
    return baskets.select(F.lit("baskets").alias("origin"), "id_a", "id_b").unionByName(sets.select(F.lit("shingle_sets").alias("origin"), "id_a", "id_b"))


def p7_set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [set_join.similar_set_classes(_table(spark, sf_dir, t), i, c).select(F.lit(t).alias("origin"), "id", "class", "copies", "links") for t, i, c in (("baskets", "basket_id", "items"), ("shingle_sets", "set_id", "shingles"))]
    return parts[0].unionByName(parts[1])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(_table(spark, sf_dir, "lang_samples"))
    return language.label_cases(_table(spark, sf_dir, "documents"), model).withColumnRenamed("id", "doc_id")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(_table(spark, sf_dir, "lang_samples"))
    segments = language.segment_languages(_table(spark, sf_dir, "documents"), model)
    return segments.select(F.col("id").alias("doc_id"), "segment", "start", "end", "lang", "confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_records, p3_sample, p3_invariants, p4_found, p4_top_items, p5_found, p5_groups, p6_found, p6_associations, p6_pairs, p6_store_items, p7_found, p7_set_classes, p8_ids, p9_found, p10_found, p10_segments)}


_RECORDS = r"""select least(v[1], v[2]) as low, greatest(v[1], v[2]) as high, kind, line_id from (
  select line_id, list_transform(regexp_extract_all(line, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\1')) as v,
    lower(regexp_replace(line, '\PL+', '', 'g')) as kind
  from edge_lines where regexp_matches(line, '[A-Za-z]') and not regexp_matches(line, '^[\s\pZ]*%')) where len(v) = 2"""
_HELD = "select distinct basket_id, item from (select basket_id, unnest(items) as item from baskets) where item is not null and basket_id is not null"
_TOP = f"with h as ({_HELD}) select item, count(*) as baskets from h group by item order by baskets desc, item limit 40"
_PAIRS = f"""with h as ({_HELD}), n as (select count(distinct basket_id) as n_all from h),
c as (select item, count(*) as n from h group by item having count(*) * 200 >= (select n_all from n)),
f as (select h.* from h join c using (item)),
p as (select x.item as item_a, y.item as item_b, count(*) as n from f x join f y on x.basket_id = y.basket_id and x.item < y.item group by all)
select p.item_a, p.item_b, p.n, a.n as n_a, b.n as n_b, n_all from p join c a on a.item = p.item_a join c b on b.item = p.item_b, n
where p.n * 200 >= n_all and p.n::hugeint * n_all >= 3 * a.n::hugeint * b.n"""

_ALL_PAIRS = f"""with h as ({_HELD}), n as (select count(distinct basket_id) as n_all from h), c as (select item, count(*) as n from h group by item),
p as (select x.item as item_a, y.item as item_b, count(*) as n from h x join h y on x.basket_id = y.basket_id and x.item < y.item group by all)
select p.item_a, p.item_b, p.n, a.n as n_a, b.n as n_b, n_all, p.n::double * n_all / (a.n::double * b.n::double) as lift
from p join c a on a.item = p.item_a join c b on b.item = p.item_b, n"""


def _similar(origin: str, id_col: str, set_col: str, table: str) -> str:
    return f"""select '{origin}' as origin, p.x as id_a, p.y as id_b from (
  select x.id as x, y.id as y, count(*) as o from {table} x join {table} y on x.v = y.v and x.id < y.id group by all) p
  join {table}_n a on a.id = p.x join {table}_n b on b.id = p.y where p.o * 5 >= 4 * (a.n + b.n - p.o)"""


def _elements(name: str, id_col: str, set_col: str, table: str) -> str:
    return f"""{name} as (select distinct {id_col} as id, v from (select {id_col}, unnest({set_col}) as v from {table}) where v is not null and {id_col} is not null),
{name}_n as (select id, count(*) as n from {name} group by id)"""


_NEAR = """t as (select file_id as id, replace(content, chr(13) || chr(10), ' ') as s from doc_files where content is not null),
sh as (select distinct id, substr(s, i::bigint, 10) as x from (select id, s, unnest(range(1, length(s) - 8)) as i from t)),
n as (select id, count(*) as n from sh group by id),
c as (select a.id as a, b.id as b, count(*) as o from sh a join sh b on a.x = b.x and a.id < b.id group by all),
j as (select c.a, c.b, o = x.n and o = y.n as equal from c join n x on x.id = c.a join n y on y.id = c.b where o * 5 >= 3 * (x.n + y.n - o))"""
_GROUPS = f"""with recursive {_NEAR}, near as (select a, b from j union all select b, a from j), same as (select a, b from j where equal union all select b, a from j where equal union all select id, id from t),
k as (select a as id, min(b) as class from same group by a),
reach(id, other) as (select id, id from t union select reach.id, near.b from reach join near on near.a = reach.other),
g as (select id, min(other) as group_id from reach group by id),
l as (select near.a as id, count(distinct k.class) as links from near join k on k.id = near.b join k o on o.id = near.a where k.class <> o.class group by near.a)
select f.file_id, coalesce(g.group_id, f.file_id) as group_id, coalesce(l.links, 0) as links from doc_files f left join g on g.id = f.file_id left join l on l.id = f.file_id"""
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '')"
_LEAKS = f"""with i as (select item_id, {_WORDS} as w from eval_items where text is not null), z as (select *, least(13, len(w)) as n from i where len(w) > 0),
g as (select item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as gram from (select *, unnest(range(1, len(w) - n + 2)) as p from z)),
d as (select doc_id, {_WORDS} as w from documents where text is not null),
h as (select doc_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as gram from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from z)))
select distinct doc_id, item_id from h join g using (n, gram)"""
_CLASSES = """select '{0}' as origin, e.id, k.class, k.copies, coalesce(l.links, 0) as links from {1}_n e join {1}_k k using (id) left join {1}_l l using (id)"""


def _classes(name: str) -> str:
    return f"""{name}_j as (select x.id as a, y.id as b, count(*) as o from {name} x join {name} y on x.v = y.v group by all),
{name}_s as (select a, b, o = x.n and o = y.n as equal from {name}_j join {name}_n x on x.id = a join {name}_n y on y.id = b where o * 5 >= 4 * (x.n + y.n - o)),
{name}_k as (select a as id, min(b) as class, count(*) as copies from {name}_s where equal group by a),
{name}_l as (select a as id, count(distinct k.class) as links from {name}_s join {name}_k k on k.id = b where not equal group by a)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with r as ({_RECORDS}), f as (select *, min(line_id) over (partition by low, high, kind) as first_line_id from r) select first_line_id, line_id from f where line_id <> first_line_id",
        "p1_records": f"select low, high, kind, min(line_id) as first_line_id, count(*) as copies from ({_RECORDS}) group by low, high, kind",
        "p3_invariants": "select least(5000, count(*)) as sampled, 0::bigint as invented from edges",
        "p4_found": f"select item from ({_TOP})",
        "p4_top_items": _TOP,
        "p5_found": f"with {_NEAR} select a as file_a, b as file_b from j",
        "p5_groups": _GROUPS,
        "p6_store_items": _PAIRS.replace(_HELD, _HELD.replace("basket_id", "store_id")).replace("basket_id", "store_id").replace("* 200 >=", "* 10 >=").replace(">= 3 *", ">="),
        "p9_found": _LEAKS,
        "p7_set_classes": f"with {_elements('eb', 'basket_id', 'items', 'baskets')}, {_elements('es', 'set_id', 'shingles', 'shingle_sets')}, {_classes('eb')}, {_classes('es')} "
        + _CLASSES.format("baskets", "eb") + " union all " + _CLASSES.format("shingle_sets", "es"),
        "p6_found": f"select item_a, item_b from ({_PAIRS})",
        "p6_associations": _PAIRS,
        "p6_pairs": _ALL_PAIRS,
        "p7_found": f"with {_elements('eb', 'basket_id', 'items', 'baskets')}, {_elements('es', 'set_id', 'shingles', 'shingle_sets')} "
        + _similar("baskets", "basket_id", "items", "eb") + " union all " + _similar("shingle_sets", "set_id", "shingles", "es"),
    }
