"""Named queries over the given tables, each with the same query in DuckDB's SQL.

The tables hold no versions of anything, so two sides are derived from one table by a rule
that both engines apply: the base lacks rows whose key is divisible by 17, the target those
by 19; a measure grows by 1 where 11 divides the key and an attribute becomes X where 13 does.
Order-dependent alignments are recursive queries there (``alignment_sql``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, mime, svg
from ..operators import access, keyed, score, sequence, spatial, store, versions
from ..schemas import ADDED, DELETED, MODIFIED, UNCHANGED
from ..sources.files import lines_of, placed
from ..streaming import events as ev
from . import alignment_sql as align

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit_map(**cols: Column) -> Column:
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c)])


# --- keyed comparison -------------------------------------------------------


def order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    old = o.where(k % 17 != 0).select("o_orderkey", F.col("o_totalprice").alias("shape"), lit_map(status=F.col("o_orderstatus")).alias("props"))
    price = F.when(k % 11 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(k % 13 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    return old, o.where(k % 19 != 0).select("o_orderkey", price.alias("shape"), lit_map(status=status).alias("props"))


ORDER_SIDES = """
WITH o AS (SELECT o_orderkey k, o_totalprice p, o_orderstatus s FROM orders),
a AS (SELECT k, p, s FROM o WHERE k % 17 <> 0),
b AS (SELECT k, CASE WHEN k % 11 = 0 THEN p + 1 ELSE p END p, CASE WHEN k % 13 = 0 THEN 'X' ELSE s END s FROM o WHERE k % 19 <> 0),
d AS (SELECT coalesce(a.k, b.k) AS o_orderkey,
  CASE WHEN b.k IS NULL THEN 'deleted' WHEN a.k IS NULL THEN 'added' WHEN a.p IS DISTINCT FROM b.p OR a.s IS DISTINCT FROM b.s THEN 'modified' ELSE 'unchanged' END AS state,
  CASE WHEN a.k IS NULL OR b.k IS NULL THEN NULL WHEN a.p IS DISTINCT FROM b.p THEN 'geometry' WHEN a.s IS DISTINCT FROM b.s THEN 'property' END AS change,
  CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.s IS DISTINCT FROM b.s THEN 'status' ELSE '' END AS changed
  FROM a FULL OUTER JOIN b ON a.k = b.k)
"""


def order_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keyed_diff(*order_sides(spark, sf_dir), ["o_orderkey"], "shape", "props")


@query(ORDER_SIDES + "SELECT o_orderkey, state, coalesce(change, '') AS change, changed FROM d")
def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_diff(spark, sf_dir).select("o_orderkey", "state", F.coalesce("change", F.lit("")).alias("change"), F.array_join("changed_properties", ",").alias("changed"))


@query(ORDER_SIDES + "SELECT state, coalesce(change, '') AS change, count(*) AS n FROM d GROUP BY ALL")
def keyed_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_diff(spark, sf_dir).groupBy("state", F.coalesce("change", F.lit("")).alias("change")).agg(F.count("*").alias("n"))


@query(ORDER_SIDES + "SELECT o_orderkey, state FROM d WHERE state IN ('added', 'deleted') OR change = 'geometry'")
def visual_delta_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_diff(spark, sf_dir).where(keyed.has_visual_delta(F.col("state"), F.col("change"))).select("o_orderkey", "state")


@query(ORDER_SIDES + """SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'deleted') AS deleted, count(*) FILTER (state = 'modified') AS modified, count(*) FILTER (state = 'unchanged') AS unchanged,
 count(*) FILTER (change = 'geometry') AS geometry_changes, count(*) FILTER (change = 'property') AS property_changes, o_orderkey % 7 AS model FROM d GROUP BY o_orderkey % 7""")
def metamodel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.state_counts(order_diff(spark, sf_dir).withColumn("model", F.col("o_orderkey") % 7), ["model"])


@query("""WITH m AS (SELECT o_orderkey % 101 AS model, count(*) FILTER (o_orderkey % 17 <> 0) AS n_old, count(*) FILTER (o_orderkey % 19 <> 0) AS n_new, count(*) FILTER (o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0) AS matched FROM orders GROUP BY 1)
SELECT model, CASE WHEN least(n_old, n_new) = 0 THEN 1.0 ELSE round_even(least(matched::DOUBLE / least(n_old, n_new), 1.0 / (1 + model % 3)), 4) END AS confidence,
 CASE WHEN least(n_old, n_new) = 0 THEN TRUE ELSE round_even(least(matched::DOUBLE / least(n_old, n_new), 1.0 / (1 + model % 3)), 4) >= 0.6 END AS trustworthy FROM m""")
def model_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_diff(spark, sf_dir).withColumn("model", F.col("o_orderkey") % 101)
    m = d.groupBy("model").agg(F.count("old").alias("n_old"), F.count("new").alias("n_new"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("matched"))
    c = score.confidence(F.col("matched"), F.col("n_old"), F.col("n_new"), F.col("model") % 3)
    return m.select("model", c.alias("confidence"), score.trustworthy(c).alias("trustworthy"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) r FROM lineitem) WHERE r = 1""")
def keyed_diff_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # noqa: E741
    return keyed.last_of_each(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("""WITH a AS (SELECT * FROM customer WHERE c_custkey % 17 <> 0), b AS (SELECT * FROM customer WHERE c_custkey % 19 <> 0)
SELECT a.c_custkey, array_to_string(list_sort(list_filter([CASE WHEN a.c_custkey % 13 = 0 AND a.c_mktsegment <> 'X' THEN 'segment' END, CASE WHEN a.c_custkey % 11 = 0 THEN 'nation' END], lambda x: x IS NOT NULL)), ',') AS changed
FROM a JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey % 13 = 0 AND a.c_mktsegment <> 'X' OR a.c_custkey % 11 = 0""")
def property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    old = c.where(k % 17 != 0).select("c_custkey", F.lit(0).alias("shape"), lit_map(segment=segment, nation=nation.cast("string")).alias("props"))
    # a property that is missing on one side differs; where 11 divides the key the nation is left out
    new = lit_map(segment=F.when(k % 13 == 0, "X").otherwise(segment), nation=nation.cast("string"))
    new = F.when(k % 11 == 0, F.map_filter(new, lambda name, _: name != "nation")).otherwise(new)
    d = keyed.keyed_diff(old, c.where(k % 19 != 0).select("c_custkey", F.lit(0).alias("shape"), new.alias("props")), ["c_custkey"], "shape", "props")
    return d.where("change = 'property'").select("c_custkey", F.array_join("changed_properties", ",").alias("changed"))


@query("""WITH s AS (SELECT p_brand, p_partkey, p_partkey % 3 <> 0 AS a, p_partkey % 2 = 0 AS b FROM part)
SELECT p_brand AS model, CASE WHEN count(*) FILTER (a) * 2 > count(*) AND count(*) FILTER (b) * 2 > count(*) THEN 'stable-id' ELSE 'geometry' END AS tier FROM s GROUP BY 1""")
def tier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    side = lambda has: p.select(F.col("p_brand").alias("model"), F.when(has, k.cast("string")).otherwise("").alias("stable_id"))
    return score.identity_tiers(side(k % 3 != 0), side(k % 2 == 0), ["model"])


# --- versions ---------------------------------------------------------------


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("file_uid"), F.col("event_id").cast("string").alias("version"), "ts", "event_id")
    return versions.ordered(e, [F.desc("ts"), F.desc("event_id")])


EVENT_VERSIONS = "WITH v AS (SELECT CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS x, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS INTEGER) AS o FROM events)\n"


@query(EVENT_VERSIONS + "SELECT u AS file_uid, lead(x) OVER w AS base, x AS target, lead(o) OVER w AS base_back, o AS target_back FROM v WINDOW w AS (PARTITION BY u ORDER BY o)")
def version_pairs_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.default_pairs(event_versions(spark, sf_dir))


@query(EVENT_VERSIONS + """, r AS (SELECT CAST(user_id AS VARCHAR) AS u, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'none' ELSE CAST(event_id AS VARCHAR) END AS t, CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id - event_id % 4 AS VARCHAR) END AS b FROM events),
j AS (SELECT r.u, t.x AS tx, t.o AS o1, nullif(r.b, '') AS rb, nullif(r.t, '') AS rt FROM r LEFT JOIN v t ON r.u = t.u AND (CASE WHEN r.t = '' THEN t.o = 0 ELSE t.x = r.t END)),
k AS (SELECT j.*, b.x AS bx, b.o AS o2 FROM j LEFT JOIN v b ON j.u = b.u AND (CASE WHEN j.rb IS NULL THEN b.o = j.o1 + 1 ELSE b.x = j.rb END))
SELECT u AS file_uid, coalesce(bx, rb) AS base, coalesce(tx, rt) AS target, o2 AS base_back, o1 AS target_back,
 CASE WHEN tx IS NULL THEN 'target_not_found' WHEN rb IS NOT NULL AND bx IS NULL THEN 'base_not_found' WHEN rb IS NOT NULL AND o2 <= o1 THEN 'base_not_older' WHEN bx IS NULL THEN 'no_predecessor' ELSE 'ok' END AS verdict FROM k""")
def version_pairs_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    target = F.when(k % 5 == 0, "").when(k % 7 == 0, "none").otherwise(k.cast("string"))
    base = F.when(k % 3 == 0, "").otherwise((k - k % 4).cast("string"))
    r = e.select(F.col("user_id").cast("string").alias("file_uid"), target.alias("target"), base.alias("base"))
    return versions.resolve(r, event_versions(spark, sf_dir))


@query("SELECT doc_id, octet_length(encode(text)) > 2000 OR octet_length(encode(lang)) > 2000 AS too_large FROM documents")
def size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = d.select("doc_id", F.encode("text", "UTF-8").alias("target_content"), F.encode("lang", "UTF-8").alias("base_content"))
    return versions.within_size(p, 2000).select("doc_id", "too_large")


# --- identities -------------------------------------------------------------

KEY_SQL = "substr(sha256(concat_ws('|', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR), CAST(event_id + 1 AS VARCHAR), event_type, '1')), 1, 32)"


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("key", keys.pair_key("user_id", "event_id", F.col("event_id") + 1, "event_type", F.lit(1)))


@query(f"SELECT event_id, {KEY_SQL} AS key FROM events")
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_keys(spark, sf_dir).select("event_id", "key")


@query(f"SELECT event_id, 'diff.' || {KEY_SQL} || '.page.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || '.svg' AS child, 'diff.' || {KEY_SQL} || '.manifest.json' AS manifest, {KEY_SQL} AS parsed, '' AS foreign_key FROM events")
def child_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_keys(spark, sf_dir)
    child = keys.child_name("key", F.lit("page"), (F.col("event_id") % 1000).cast("int"), F.lit("svg"))
    return e.select("event_id", child.alias("child"), keys.manifest_name("key").alias("manifest"), keys.key_of(child).alias("parsed"), keys.key_of(F.concat(F.lit("markup."), "key")).alias("foreign_key"))


@query("SELECT event_id, round_even(value / 0.5, 0) * 0.5 AS half, CAST(round_even(value / 0.1, 0) AS BIGINT) AS tenths FROM events")
def quantised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", keys.quantise("value").alias("half"), keys.cells("value", 0.1).alias("tenths"))


EMB = "WITH e AS (SELECT vec_id, label, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),\nc AS (SELECT *, list_sum(list_transform(range(21), lambda i: v[3 * i + 1])) / 21 AS cx, list_sum(list_transform(range(21), lambda i: v[3 * i + 2])) / 21 AS cy, list_sum(list_transform(range(21), lambda i: v[3 * i + 3])) / 21 AS cz FROM e)\n"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double")).alias("verts"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("faces"))


@query(EMB + "SELECT vec_id, substr(sha256(list_reduce(list_prepend('', list_transform(v, lambda x: CAST(CAST(round_even(x / 0.0001, 0) AS BIGINT) AS VARCHAR) || ',')), lambda a, b: a || b) || '|0,1,2,'), 1, 32) AS hash FROM c")
def geometry_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("vec_id", keys.geometry_hash("verts", "faces").alias("hash"))


@query(EMB + "SELECT vec_id, round(cx, 9) AS x, round(cy, 9) AS y, round(cz, 9) AS z FROM c")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = shapes(spark, sf_dir).select("vec_id", keys.centroid("verts").alias("c"))
    return c.select("vec_id", *[F.round(f"c.{k}", 9).alias(k) for k in "xyz"])


@query(EMB + "SELECT label, round(sqrt(pow(max(list_max(list_transform(range(21), lambda i: v[3 * i + 1]))) - min(list_min(list_transform(range(21), lambda i: v[3 * i + 1]))), 2) + pow(max(list_max(list_transform(range(21), lambda i: v[3 * i + 2]))) - min(list_min(list_transform(range(21), lambda i: v[3 * i + 2]))), 2) + pow(max(list_max(list_transform(range(21), lambda i: v[3 * i + 3]))) - min(list_min(list_transform(range(21), lambda i: v[3 * i + 3]))), 2)), 9) AS diagonal FROM c GROUP BY label")
def bbox_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.bbox_diagonal(shapes(spark, sf_dir), ["label"]).select("label", F.round("diagonal", 9).alias("diagonal"))


@query(align.SHAPE_SIGNATURE)
def shape_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.shaped(shapes(spark, sf_dir)).select("vec_id", "shape")


@query("SELECT doc_id, 'T|' || lang || '|' || CAST(round_even(n_chars / 100.0 / 0.5, 0) * 0.5 AS DECIMAL(12, 1))::VARCHAR || '|' || source AS signature FROM documents")
def text_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", keys.text_signature("source", F.col("n_chars") / 100.0, "lang").alias("signature"))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x, y = F.col("p_partkey").cast("double"), (F.col("p_size") * 1.0)
    points = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + F.col("p_size")).alias("x"), y.alias("y")), F.struct((x + F.col("p_size")).alias("x"), (y + 2.5).alias("y")))
    return p.select("p_partkey", "p_size", points.alias("points"), F.array(F.lit("m"), F.lit("l"), F.lit("l"), F.lit("h"), F.lit("S")).alias("ops"))


@query("SELECT p_partkey, 'P|m,l,l,h,S|0.0,0.0;' || p_size || '.0,0.0;' || p_size || '.0,2.5' AS signature FROM part")
def path_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_points(spark, sf_dir).select("p_partkey", keys.path_signature("points", "ops").alias("signature"))


@query("SELECT doc_id, 'I|2x3|' || substr(sha256(text), 1, 16) AS signature FROM documents")
def image_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", keys.image_signature(F.encode("text", "UTF-8"), F.lit(2), F.lit(3)).alias("signature"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END, CASE WHEN p_partkey % 2 = 0 THEN p_name END, 'e' || p_size) AS id FROM part")
def element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select("p_partkey", keys.element_id(F.when(k % 3 == 0, k.cast("string")).otherwise(""), F.when(k % 2 == 0, F.col("p_name")).otherwise(""), "p_size").alias("id"))


# --- alignment --------------------------------------------------------------


def placed_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Objects of a page for each brand, shifted by a brand's own distance on the new side."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    place = p.select(F.col("p_brand").alias("page"), "p_partkey", F.concat("p_name", F.lit("|"), F.col("p_size")).alias("signature"), (k % 600).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    dx = F.pmod(F.length("page") * 7, F.lit(40)).cast("double")
    old = place.where(k % 17 != 0)
    return old, place.where(k % 19 != 0).withColumn("x", F.col("x") + F.when(k % 11 == 0, 3.0).otherwise(dx))


@query("""WITH p AS (SELECT p_brand AS page, p_partkey k, p_name || '|' || p_size AS sig, CAST(p_partkey % 600 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part),
a AS (SELECT page, sig, min(x) x, min(y) y FROM p WHERE k % 17 <> 0 GROUP BY 1, 2 HAVING count(*) = 1),
b AS (SELECT page, sig, min(CASE WHEN k % 11 = 0 THEN x + 3 ELSE x + length(page) * 7 % 40 END) x, min(y) y FROM p WHERE k % 19 <> 0 GROUP BY 1, 2 HAVING count(*) = 1),
v AS (SELECT page, round_even(b.x - a.x, 0) dx, round_even(b.y - a.y, 0) dy, count(*) n FROM a JOIN b USING (page, sig) GROUP BY 1, 2, 3),
t AS (SELECT page, dx, dy, n, sum(n) OVER (PARTITION BY page) s FROM v)
SELECT u.page, coalesce(max(t.dx), 0.0) AS dx, coalesce(max(t.dy), 0.0) AS dy FROM (SELECT DISTINCT page FROM p WHERE k % 17 <> 0 OR k % 19 <> 0) u LEFT JOIN t ON u.page = t.page AND t.n * 2 > t.s GROUP BY u.page""")
def dominant_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.dominant_offset(*placed_parts(spark, sf_dir), ["page"])


def page_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drawings: a page for each (brand, size) of parts, with rectangles in key order."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    x, y = (k % 500).cast("double"), F.col("p_size").cast("double")

    def side(rows: DataFrame, x: Column, style: Column) -> DataFrame:
        kind = F.concat(F.lit("P|"), "p_type")
        return rows.select(F.concat_ws("/", "p_brand", "p_size").alias("page"), F.lit("path").alias("kind"), kind.alias("signature"), x.alias("x"), y.alias("y"), style.alias("style"), F.col("p_partkey").cast("int").alias("idx"))

    old = side(p.where(k % 17 != 0), x, F.lit("w=1.0"))
    return old, side(p.where(k % 19 != 0), x + F.when(k % 11 == 0, 40.0).when(k % 23 == 0, 400.0).otherwise(5.0), F.when(k % 13 == 0, "w=2.0").otherwise("w=1.0"))


@query(align.PAGE_COMPARISON)
def page_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.compare_pages(*page_sides(spark, sf_dir), ["page"]).select("page", "state", "reason", F.col("old.idx").alias("old_idx"), F.col("new.idx").alias("new_idx"), "matched")


@query(align.PAGE_CONFIDENCE)
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = page_sides(spark, sf_dir)
    d = spatial.compare_pages(old, new, ["page"])
    n = old.groupBy("page").agg(F.count("*").alias("n_old")).join(new.groupBy("page").agg(F.count("*").alias("n_new")), "page", "full_outer").na.fill(0)
    m = d.groupBy("page").agg(F.count_if("matched").alias("matched"))
    return n.join(m, "page").select("page", score.confidence(F.col("matched"), F.col("n_old"), F.col("n_new"), F.lit(0)).alias("confidence"))


@query(align.RESIDUAL_NEAREST)
def residual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = page_sides(spark, sf_dir)
    return spatial.residual_nearest(old, new, ["page"])


@query(align.NEAREST_FIRST)
def nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shapes(spark, sf_dir).select(F.lit("m").alias("model"), F.concat(F.lit("s"), "label").alias("shape"), F.col("vec_id").cast("int").alias("idx"), keys.centroid("verts").alias("center"))
    return spatial.nearest_first(s.where("idx % 17 <> 0"), s.where("idx % 19 <> 0"), ["model"]).select("old_idx", "new_idx", F.round("distance", 9).alias("distance"))


@query(align.SHAPE_COMPARISON)
def shape_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by label; where 11 divides the id the element is moved away, where 13 does it is moved a little."""
    s = shapes(spark, sf_dir).select(F.col("label").alias("model"), F.col("vec_id").cast("int").alias("idx"), "verts", "faces")
    by = F.when(F.col("idx") % 11 == 0, 10.0).when(F.col("idx") % 13 == 0, 0.001).otherwise(0.0)
    new = s.where("idx % 19 <> 0").withColumn("verts", F.transform("verts", lambda v: v + by))
    return spatial.compare_shapes(s.where("idx % 17 <> 0"), new, ["model"])


def doc_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of every document, and of an edited copy: each seventh line left out, each eleventh twice."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines_of("text", None)).alias("idx", "line"))  # noqa: E741
    copies = F.when(F.col("idx") % 7 == 6, 0).when(F.col("idx") % 11 == 10, 2).otherwise(1)
    edited = l.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(2)))).where(F.col("c") <= copies)
    return l, edited.select("doc_id", (F.col("idx") * 2 + F.col("c")).alias("idx"), "line")


@query(align.LCS_PAIRS)
def lcs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.align(*doc_lines(spark, sf_dir), ["doc_id"], signature="line")


@query(align.LINE_STATES)
def text_line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.line_states(*doc_lines(spark, sf_dir), ["doc_id"]).groupBy("doc_id", "layer", "state").agg(F.count("*").alias("n"))


@query(align.PAGE_PAIRING)
def page_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("idx"), F.md5("text").alias("signature"))
    new = c.where("(conv_id + idx) % 7 <> 3").withColumn("signature", F.when(F.col("idx") % 5 == 2, F.md5("signature")).otherwise(F.col("signature")))
    return sequence.pair_pages(c, new, ["conv_id"])


@query("SELECT doc_id, CAST(len(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS INTEGER) AS n FROM documents WHERE text <> ''")
def text_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text <> ''")
    return d.select("doc_id", F.size(lines_of("text", None)).alias("n"))


# --- modes, scores, drawings --------------------------------------------------

def event_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    m = F.when((k % 5 == 0) & (F.col("user_id") % 9 != 0), "raster").when((k % 97 == 0) | (F.col("user_id") % 9 == 0), "unavailable").otherwise("vector")
    return e.select("user_id", F.lit("page").alias("kind"), k.cast("int").alias("idx"), m.alias("mode"))


EVENT_CHILDREN = "WITH c AS (SELECT user_id, CAST(event_id AS INTEGER) AS i, CASE WHEN event_id % 5 = 0 AND user_id % 9 <> 0 THEN 'raster' WHEN event_id % 97 = 0 OR user_id % 9 = 0 THEN 'unavailable' ELSE 'vector' END AS m FROM events)\n"


@query(EVENT_CHILDREN + "SELECT user_id, CASE WHEN bool_and(m = 'unavailable') THEN 'failed' ELSE 'ready' END AS status, CASE WHEN count(DISTINCT m) = 1 THEN min(m) ELSE 'mixed' END AS mode FROM c GROUP BY user_id")
def overall_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.overall(event_children(spark, sf_dir), ["user_id"]).select("user_id", "status", "mode")


@query(EVENT_CHILDREN + "SELECT user_id, string_agg(i || ':' || m, ';' ORDER BY i) AS units FROM c GROUP BY user_id")
def unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = score.overall(event_children(spark, sf_dir), ["user_id"])
    return u.select("user_id", F.array_join(F.transform("units", lambda x: F.concat(x["index"].cast("string"), F.lit(":"), x["mode"])), ";").alias("units"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type))[1:4], ',') AS problems, CAST(count(DISTINCT event_type) AS INTEGER) AS n FROM events GROUP BY user_id")
def problem_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("p"))
    return e.select("user_id", F.array_join(score.first_problems(F.col("p")), ",").alias("problems"), score.distinct_problems(F.col("p"), F.col("p")).alias("n"))


@query("SELECT s_suppkey, 'M' || s_nationkey || ',' || 0 || ' L' || (s_nationkey + 1) || '.5,2 Z' AS d FROM supplier")
def path_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), F.col("s_nationkey").cast("double")
    points = F.array(F.struct(n.alias("x"), F.lit(0.0).alias("y")), F.struct((n + 1.5).alias("x"), F.lit(2.0).alias("y")))
    return s.select("s_suppkey", svg.path_data(points, F.array(F.lit("re"))).alias("d"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", svg.escaped("html").alias("escaped"))


@query("SELECT event_id, CAST(event_id % 40 AS VARCHAR) || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS n FROM events")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", svg.short(k % 40 + (k % 4) / 4.0).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE p_size / 10.0 END::DOUBLE AS w FROM part")
def stroke_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.when(F.col("p_size") % 4 == 0, "paint=S;w=x").otherwise(F.concat(F.lit("paint=S;w="), (F.col("p_size") / 10.0).cast("string"), F.lit(";fill=")))
    return table(spark, sf_dir, "part").select("p_partkey", svg.stroke_width(style).alias("w"))


@query(align.PAGE_DRAWINGS)
def page_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page comparison drawn in three layers."""
    shape = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")))
    dress = lambda d: d.withColumns({"text": F.lit(""), "outline": F.lit(None).cast("string"), "points": shape, "ops": F.array(F.lit("m"), F.lit("l"), F.lit("S"))})
    old, new = map(dress, page_sides(spark, sf_dir))
    d = keyed.in_order(spatial.compare_pages(old, new, ["page"]), ["page"], F.col("old.idx"), F.col("new.idx"))
    return svg.render_pages(d.withColumns({"width": F.lit(595.0), "height": F.lit(842.0)}), ["page"])


# --- types and dispatch -------------------------------------------------------

SNIFFED = "CASE WHEN page_id % 7 = 0 THEN '%PDF-1.4' || html WHEN page_id % 7 = 1 THEN 'ISO-10303-21; FILE_SCHEMA((''IFC4''))' || html WHEN page_id % 7 = 2 THEN 'ISO-10303-21;' WHEN page_id % 7 = 3 THEN '{\"asset\": {\"version\": \"2.0\"}}' WHEN page_id % 7 = 4 THEN 'plain ' || html ELSE html END"
SNIFF_TYPE = "CASE WHEN page_id % 7 = 0 THEN 'application/pdf' WHEN page_id % 7 = 1 THEN 'application/x-ifc' WHEN page_id % 7 = 2 THEN 'model/step' WHEN page_id % 7 = 3 THEN 'model/gltf+json' WHEN page_id % 7 = 4 THEN NULL WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'text/html' END"
NAMED = "CASE page_id % 5 WHEN 0 THEN 'a.CITY.json' WHEN 1 THEN 'b.stp' WHEN 2 THEN 'c.txt' WHEN 3 THEN 'noext' ELSE 'd.ifczip' END"
BY_NAME = "CASE page_id % 5 WHEN 0 THEN 'application/city+json' WHEN 1 THEN 'model/step' WHEN 2 THEN 'text/plain' WHEN 3 THEN NULL ELSE 'application/x-ifc-zip' END"
DETECTED = f"coalesce({SNIFF_TYPE}, {BY_NAME}, 'application/octet-stream')"


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.encode(F.expr(SNIFFED.replace("''", "\\'")), "UTF-8").alias("content"), F.expr(NAMED).alias("name"))


@query(f"SELECT page_id, {SNIFF_TYPE} AS mime FROM pages")
def mime_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("page_id", mime.sniff("content").alias("mime"))


@query(f"SELECT page_id, {DETECTED} AS mime FROM pages")
def mime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("page_id", mime.detect("content", "name").alias("mime"))


@query(f"SELECT page_id, {DETECTED} LIKE 'text/%' OR {DETECTED} = 'application/pdf' AS listed, TRUE AS unlimited FROM pages")
def mime_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_files(spark, sf_dir).withColumn("mime", mime.detect("content", "name"))
    return p.select("page_id", mime.matches("mime", F.array(F.lit("TEXT/*"), F.lit(" application/pdf"))).alias("listed"), mime.matches("mime", F.array().cast("array<string>")).alias("unlimited"))


@query(f"SELECT page_id, CASE WHEN {DETECTED} = 'application/pdf' THEN 'pdf' WHEN {DETECTED} IN ('application/x-ifc', 'model/step', 'model/gltf+json', 'application/x-ifc-zip') THEN '3d' WHEN {DETECTED} LIKE 'text/plain%' THEN 'passthrough-text' END AS plugin FROM pages")
def plugin_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("page_id", mime.operator_for(mime.detect("content", "name")).alias("plugin"))


@query("SELECT page_id, coalesce(CASE page_id % 5 WHEN 1 THEN 'step' WHEN 4 THEN 'ifc' END, '') AS format FROM pages")
def format_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).select("page_id", mime.format_for(F.lit("application/octet-stream"), "name").alias("format"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'mono' WHEN doc_id % 4 = 1 THEN 'serif' ELSE 'sans' END AS family FROM documents")
def font_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.expr("CASE WHEN doc_id % 4 = 0 THEN 'Courier-Bold' WHEN doc_id % 4 = 1 THEN '/TimesNewRoman' WHEN doc_id % 4 = 2 THEN 'Arial' END")
    return table(spark, sf_dir, "documents").select("doc_id", mime.font_family(hint).alias("family"))


# --- results store ------------------------------------------------------------


def order_manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest for each order that expects its lines' children, and the children that are there."""
    k = F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    key = F.concat(F.lit("k"), k.cast("string"))
    named = lines.select(k.cast("string").alias("file_uid"), key.alias("key"), keys.child_name(key, F.lit("page"), "l_linenumber", F.lit("svg")).alias("name"), "l_orderkey", "l_linenumber")
    m = named.groupBy("file_uid", "key").agg(F.sort_array(F.collect_list("name")).alias("expected"))
    return m, named.where("(l_orderkey + l_linenumber) % 29 <> 0").select("file_uid", "key", "name")


NAMED_LINES = "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),\nn AS (SELECT CAST(l_orderkey AS VARCHAR) AS file_uid, 'k' || l_orderkey AS key, 'diff.k' || l_orderkey || '.page.' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '.svg' AS name, l_orderkey, l_linenumber FROM l)\n"


@query(NAMED_LINES + "SELECT DISTINCT key FROM n WHERE (l_orderkey + l_linenumber) % 29 = 0")
def manifest_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.incomplete(*order_manifests(spark, sf_dir))


@query(NAMED_LINES + "SELECT key, CAST(count(*) AS INTEGER) AS n FROM n GROUP BY key HAVING count(*) FILTER ((l_orderkey + l_linenumber) % 29 = 0) = 0")
def manifest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.complete(*order_manifests(spark, sf_dir)).select("key", F.size("expected").alias("n"))


@query("SELECT event_id FROM events WHERE event_type <> 'click' OR event_id % 3 <> 1")
def manifest_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("plugin"), (F.col("event_id") % 3).cast("int").alias("plugin_version"))
    return store.stale(e, F.lit("click"), F.lit(1)).select("event_id")


@query(NAMED_LINES + "SELECT file_uid, name FROM n WHERE (l_orderkey + l_linenumber) % 29 <> 0 AND l_orderkey % 5 <> 0")
def prune_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, there = order_manifests(spark, sf_dir)
    foreign = there.select("file_uid", F.concat(F.lit("preview."), "name").alias("name"))
    return store.prune_keeping(there.select("file_uid", "name").union(foreign), m.where("CAST(file_uid AS BIGINT) % 5 = 0"))


@query(NAMED_LINES + "SELECT file_uid, name FROM n WHERE (l_orderkey + l_linenumber) % 29 <> 0 AND l_orderkey % 5 = 0")
def prune_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, there = order_manifests(spark, sf_dir)
    return store.prune_dropping(there.select("file_uid", "name"), m.where("CAST(file_uid AS BIGINT) % 5 = 0"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS file_uid, substr(sha256(concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR), o_orderstatus, 'pdf', CAST(v AS VARCHAR))), 1, 32) AS key
FROM (SELECT *, unnest(range(o_orderkey % 4)) AS v FROM orders)""")
def superseded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = o.select(F.col("o_custkey").cast("string").alias("file_uid"), F.col("o_orderkey").cast("string").alias("base"), F.col("o_orderstatus").alias("target"), F.lit("pdf").alias("plugin"), (F.col("o_orderkey") % 4).cast("int").alias("plugin_version"))
    return store.superseded(p)


@query("""SELECT user_id, '{"base_version":"b","expected":[],' || CASE WHEN user_id % 2 = 0 THEN '"failure":{"reason":"r","stage":"parse","tiers_attempted":["vector"]},' ELSE '' END || '"file_uid":"' || user_id || '","key":"k","mode":"vector","plugin":"pdf","plugin_version":1,"schema":1,"status":"ready","target_version":"t","units":[{"index":0,"kind":"page","mode":"vector"}]}' AS body FROM (SELECT DISTINCT user_id FROM events)""")
def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    failure = F.when(F.col("user_id") % 2 == 0, F.struct(F.lit("r").alias("reason"), F.lit("parse").alias("stage"), F.array(F.lit("vector")).alias("tiers_attempted")))
    m = u.select("user_id", F.lit("b").alias("base_version"), F.array().cast("array<string>").alias("expected"), failure.alias("failure"), F.col("user_id").cast("string").alias("file_uid"), F.lit("k").alias("key"), F.lit("vector").alias("mode"), F.lit("pdf").alias("plugin"), F.lit(1).alias("plugin_version"), F.lit(1).alias("schema"), F.lit("ready").alias("status"), F.lit("t").alias("target_version"), F.array(F.struct(F.lit(0).alias("index"), F.lit("page").alias("kind"), F.lit("vector").alias("mode"))).alias("units"))
    return m.select("user_id", store.to_json(m.drop("user_id")).alias("body"))


SWEEP = EVENT_VERSIONS + ", p AS (SELECT u, lead(x) OVER w AS b, x AS t, o FROM v WINDOW w AS (PARTITION BY u ORDER BY o)), c AS (SELECT u AS file_uid, b AS base, t AS target FROM p WHERE o = 0 AND b IS NOT NULL)\n"


def sweep(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = store.keyed(versions.newest_pairs(event_versions(spark, sf_dir)).where("base is not null"), F.lit("pdf"), F.lit(1))
    done = now.where("CAST(file_uid AS BIGINT) % 3 = 0").select("key", F.when(F.col("file_uid").cast("bigint") % 2 == 0, "failed").otherwise("ready").alias("status"))
    return now, done


@query(SWEEP + "SELECT file_uid, base, target FROM c WHERE CAST(file_uid AS BIGINT) % 3 <> 0")
def sweep_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.pending(*sweep(spark, sf_dir)).select("file_uid", "base", "target")


@query(SWEEP + "SELECT CASE WHEN CAST(file_uid AS BIGINT) % 3 <> 0 OR CAST(file_uid AS BIGINT) % 2 = 0 THEN 'pending' ELSE 'cached' END AS outcome, count(*) AS n FROM c GROUP BY 1")
def sweep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, done = sweep(spark, sf_dir)
    todo = store.pending(now, done, retry_failed=True).select("key", F.lit("pending").alias("p"))
    return now.join(todo, "key", "left").groupBy(F.coalesce("p", F.lit("cached")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'no_predecessor' WHEN event_id % 5 = 0 THEN 'unsupported' WHEN event_id % 3 = 0 THEN 'cached' WHEN value > 200 THEN 'too_large' WHEN event_id % 11 = 0 THEN 'failed' ELSE 'computed' END AS outcome FROM events""")
def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    state = {"error": k % 31 == 0, "no_predecessor": k % 7 == 0, "unsupported": k % 5 == 0, "cached": k % 3 == 0, "too_large": F.col("value") > 200, "failed": k % 11 == 0}
    return table(spark, sf_dir, "events").select("event_id", store.outcome(state).alias("outcome"))


@query("""SELECT event_id, CAST(CASE WHEN event_id % 13 = 0 THEN 403 WHEN event_id % 7 = 0 THEN 200 WHEN event_id % 11 = 0 THEN 404 WHEN event_id % 5 = 0 THEN 200 WHEN event_id % 3 = 0 THEN 422 WHEN event_id % 2 = 0 AND event_id % 17 <> 1 THEN 200 ELSE 202 END AS INTEGER) AS code,
 CASE WHEN event_id % 13 = 0 THEN 'denied' WHEN event_id % 7 = 0 THEN 'none' WHEN event_id % 11 = 0 THEN 'not_found' WHEN event_id % 5 = 0 THEN 'unsupported' WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 2 = 0 AND event_id % 17 <> 1 THEN 'ready' ELSE 'pending' END AS status FROM events""")
def api_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    verdict = F.when(k % 7 == 0, "no_predecessor").when(k % 11 == 0, "base_not_older").otherwise("ok")
    code, status = store.answer(k % 13 != 0, verdict, F.when(k % 5 != 0, "pdf"), F.when(k % 3 == 0, "failed").when(k % 17 != 1, "ready"), (k % 2 == 0) & (k % 17 != 1))
    return table(spark, sf_dir, "events").select("event_id", code.cast("int").alias("code"), status.alias("status"))


# --- events and access ----------------------------------------------------------

EVENT_KIND = "CASE event_id % 6 WHEN 0 THEN 'acl.changed' WHEN 1 THEN 'file.deleted' WHEN 2 THEN 'other' ELSE 'file.updated' END"


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(F.expr(EVENT_KIND).alias("type"), (k - k % 3).cast("string").alias("event_id"), F.lit("").alias("tenant"), F.when(k % 10 == 9, "").otherwise(F.col("user_id").cast("string")).alias("file_uid"), k.cast("string").alias("version"), (k % 5 == 3).alias("is_rendition"), (k % 7 == 4).alias("is_folder"), F.lit("").alias("member"), k.alias("n"))


@query(f"""SELECT event_id AS n, 'default' AS tenant, CASE WHEN event_id % 6 = 0 THEN 'invalidate' WHEN event_id % 6 = 2 THEN 'ignore' WHEN event_id % 5 = 3 THEN 'ignore' WHEN event_id % 7 = 4 OR event_id % 10 = 9 THEN 'ignore' WHEN event_id % 6 = 1 THEN 'delete' ELSE 'compare' END AS action FROM events""")
def event_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.routed(stream_events(spark, sf_dir)).select("n", "tenant", "action")


@query("SELECT min(event_id) AS n, CAST(event_id - event_id % 3 AS VARCHAR) AS event_id FROM events GROUP BY event_id - event_id % 3")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.first_of_each(stream_events(spark, sf_dir), ["n"]).select("n", "event_id")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    return e.where(k % 2 == 0).select(F.lit("t").alias("tenant"), F.col("event_type").alias("user"), F.col("user_id").cast("string").alias("file_uid"), F.when(k % 10 != 0, k % 3 == 0).alias("allowed"), F.col("ts").alias("decided_at"), k.alias("d"))


@query("""WITH d AS (SELECT event_type AS who, user_id, ts, event_id, event_id % 3 = 0 AS ok FROM events WHERE event_id % 2 = 0 AND event_id % 10 <> 0),
r AS (SELECT event_type AS who, user_id, ts, event_id FROM events WHERE event_id % 2 = 1),
j AS (SELECT r.event_id, r.ts, max(d.ts) AS dts FROM r LEFT JOIN d ON r.who = d.who AND r.user_id = d.user_id AND d.ts <= r.ts GROUP BY ALL)
SELECT j.event_id AS request, CASE WHEN j.dts + INTERVAL 5 DAY > j.ts THEN bool_or(d.ok) END AS allowed FROM j JOIN r ON j.event_id = r.event_id LEFT JOIN d ON d.who = r.who AND d.user_id = r.user_id AND d.ts = j.dts GROUP BY j.event_id, j.dts, j.ts""")
def permission_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    r = e.where(k % 2 == 1).select(F.lit("t").alias("tenant"), F.col("event_type").alias("user"), F.col("user_id").cast("string").alias("file_uid"), F.col("ts").alias("at"), k.alias("request"))
    return access.as_of(r, decisions(spark, sf_dir), 5 * 86400).select("request", "allowed")


@query("""WITH d AS (SELECT event_id, event_type AS who, user_id, ts FROM events WHERE event_id % 2 = 0),
g AS (SELECT ts, user_id, event_type AS who, event_id % 30 AS m FROM events WHERE event_id % 30 IN (1, 3) OR event_id % 3001 = 5)
SELECT event_id AS d FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ts > d.ts AND (g.m = 1 AND g.user_id = d.user_id OR g.m = 3 AND g.who = d.who AND g.user_id % 50 = 0))""")
def invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    g = e.where((k % 30 == 1) | ((k % 30 == 3) & (F.col("user_id") % 50 == 0)))
    kind = F.when(k % 30 == 1, "acl.changed").otherwise("role.assigned")
    events = g.select(kind.alias("type"), F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("file_uid"), F.col("event_type").alias("member"), F.col("ts").alias("at"))
    return access.invalidated(decisions(spark, sf_dir), events).select("d")


# --- listings -------------------------------------------------------------------


@query("SELECT c_custkey, n_name || '/' || c_mktsegment AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'")
def child_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat listing joined to its folders; the own output's folder is skipped."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    entries = c.select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").alias("folder"), F.col("c_mktsegment").alias("kind"))
    return placed(entries, n.select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("name")), ("BUILDING",)).withColumnRenamed("uid", "c_custkey")


def _filled() -> None:
    """The second half of the catalogue adds itself to the first as it is imported."""
    from . import faults, reading  # noqa: F401


def queries() -> dict[str, Query]:
    _filled()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _filled()
    return dict(_SQL)


__all__ = ["ADDED", "DELETED", "MODIFIED", "UNCHANGED", "oracle_sql", "queries"]
