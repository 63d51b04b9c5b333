"""Queries over files that are made from the tables: decoders, drawings of texts, runs, listings, limits.

The tables hold no PDF, glTF or STEP file, so each row becomes a small one by a rule; the SQL
states what must be read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, svg
from ..operators import access, registry, run, score, store, versions
from ..sources import files, gltf, pdf, step
from ..streaming import events as ev
from .catalogue import KEY_SQL, event_children, query, table


def binary(*parts: Column | str) -> Column:
    return F.encode(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), "UTF-8")


# --- decoders -------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, p_name AS t FROM part)
SELECT k AS p_partkey, 0 AS page, CAST(200 + s AS DOUBLE) AS width, 'path' AS kind, 'P|re,S|0.0,0.0;' || s || '.0,0.0;' || s || '.0,20.0;0.0,20.0' AS signature, CAST(10 + k % 90 AS DOUBLE) AS x, CAST(12.5 AS DOUBLE) AS y, 'paint=S;w=2.0;fill=;stroke=1.000,0.000,0.000' AS style, FALSE AS has_raster, 'zz' AS unknown FROM p
UNION ALL SELECT k, 0, 200.0 + s, 'text', 'T|/F1|12.0|(' || k || ') ' || t, 20.0, 70.0, 'fill=0.500;size=12.0', FALSE, 'zz' FROM p
UNION ALL SELECT k, 1, 300.0, 'image', 'X|/Im' || s, 0.0, 0.0, '/Im' || s, TRUE, '' FROM p""")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of two pages for each part: a box under a matrix, a text with escaped brackets, an image; the second page inherits its box."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    one = F.concat(F.lit("q 1 0 0 1 "), (k % 90).cast("string"), F.lit(" 0 cm 2 w 1 0 0 RG 10 12.5 "), s.cast("string"), F.lit(" 20 re S Q zz .5 g BT /F1 12 Tf 20 70 Td (\\("), k.cast("string"), F.lit("\\) "), F.col("p_name"), F.lit(") Tj ET"))
    head = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]/MediaBox[0 0 300 100]>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/MediaBox[0 0 "
    content = binary(head, F.lit(200) + s, " 100]/Contents 4 0 R>>endobj\n4 0 obj<<>>stream\n", one, "\nendstream endobj\n5 0 obj<</Type/Page/Parent 2 0 R/Contents[6 0 R]>>endobj\n6 0 obj<<>>stream\n/Im", s, " Do\nendstream endobj\n")
    o = pdf.objects(p.select("p_partkey", content.alias("content")), ["p_partkey"])
    return o.select("p_partkey", "page", "width", "kind", "signature", "x", "y", "style", "has_raster", F.array_join("unknown_ops", ",").alias("unknown"))


@query("""SELECT p_partkey, coalesce(CASE p_partkey % 4 WHEN 0 THEN 'open-failed' WHEN 1 THEN 'no-pages' WHEN 2 THEN 'open-failed:encrypted' END, '') AS problem, CASE WHEN p_partkey % 4 = 3 THEN '<parse-error:error>' ELSE '' END AS unknown FROM part""")
def pdf_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that can't be opened, and a page whose content can't be unpacked: none is without a row."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "plain").when(k == 1, "%PDF-1.4 1 0 obj<</Type/Catalog>>endobj").when(k == 2, "%PDF-1.4 trailer<</Encrypt 1 0 R>>").otherwise("%PDF-1.4 1 0 obj<</Type/Page/Contents 2 0 R>>endobj 2 0 obj<</Filter/FlateDecode>>stream\nxx\nendstream endobj")
    o = pdf.objects(table(spark, sf_dir, "part").select("p_partkey", F.encode(text, "UTF-8").alias("content")), ["p_partkey"])
    return o.select("p_partkey", F.coalesce("problem", F.lit("")).alias("problem"), F.array_join(F.coalesce("unknown_ops", F.array().cast("array<string>")), ",").alias("unknown"))


@query("""SELECT p_partkey, 'node-1' AS local_id, p_name AS name, CAST(p_size % 4 + 1 AS INTEGER) AS n, (p_partkey + 2.0) || ',' || '1.0,' || (p_size * 1.0) AS first, CASE WHEN p_size % 4 + 1 = 1 THEN '0' ELSE array_to_string(range(p_size % 4 + 1), ',') END AS faces, '' AS problem FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 20 = 0 THEN 'unreadable-gltf' ELSE 'no-geometry' END FROM part WHERE p_partkey % 10 = 0""")
def gltf_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for each part: a node in a node, both shifted, the child doubled in size; some are broken or empty."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    # the accessor has no view: its values are zeros, so every vertex stands where the node does
    scene = binary('{"asset":{"version":"2.0"},"scenes":[{"nodes":[0]}],"nodes":[{"translation":[', k, ',1,0],"children":[1]},{"mesh":0,"scale":[2,2,2],"translation":[2,0,', s, '],"name":"', F.col("p_name"), '"}],"meshes":[{"primitives":[{"attributes":{"POSITION":0}}]}],"accessors":[{"componentType":5126,"type":"VEC3","count":', s % 4 + 1, "}]}")
    content = F.when(k % 20 == 0, binary("{}")).when(k % 10 == 0, binary('{"asset":{"version":"2.0"}}')).otherwise(scene)
    e = gltf.elements(p.select("p_partkey", content.alias("content")), ["p_partkey"])
    return e.select("p_partkey", "local_id", "name", F.floor(F.size(F.when(F.col("verts").isNotNull(), F.col("verts"))) / 3).cast("int").alias("n"), F.array_join(F.slice("verts", 1, 3), ",").alias("first"), F.array_join("faces", ",").alias("faces"), F.coalesce("problem", F.lit("")).alias("problem"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'open-failed:NotStep' WHEN p_partkey % 5 = 1 THEN '' ELSE 'no-geometry:' || lpad(CAST(p_partkey AS VARCHAR), 22, '0') END AS problem FROM part""")
def step_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product for each part; without a CAD kernel each is reported; what only groups others isn't built."""
    k = F.col("p_partkey")
    body = lambda kind: binary(f"ISO-10303-21;HEADER;FILE_SCHEMA(('IFC4'));ENDSEC;DATA;#1={kind}('", F.lpad(k.cast("string"), 22, "0"), "',#9,'n',$,$,#5,#6,$);ENDSEC;END-ISO-10303-21;")
    content = F.when(k % 5 == 0, binary("plain")).when(k % 5 == 1, body("IFCSPACE")).otherwise(body("IFCWALL"))
    e = step.elements(table(spark, sf_dir, "part").select("p_partkey", content.alias("content")), ["p_partkey"])
    return e.select("p_partkey", F.coalesce("problem", F.lit("")).alias("problem"))


# --- drawings and scores -----------------------------------------------------------


@query("""SELECT page_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 595.5 842" width="595.5" height="842" data-diff-mode="raster"><g id="diff-old"><image data-diff-state="deleted" data-diff-kind="raster" x="0" y="0" width="595.5" height="842" href="data:image/png;base64,' || base64(encode(url)) || '"/></g><g id="diff-new">'
 || CASE WHEN page_id % 2 = 0 THEN '' ELSE '<image data-diff-state="added" data-diff-kind="raster" x="0" y="0" width="595.5" height="842" href="data:image/png;base64,' || base64(encode(url || 'n')) || '"/>' END || '</g><g id="diff-changes">'
 || CASE WHEN page_id % 2 = 0 THEN '' ELSE '<image data-diff-state="modified" data-diff-kind="raster" x="0" y="0" width="595.5" height="842" href="data:image/png;base64,' || base64(encode(CASE WHEN page_id % 3 = 0 THEN 'mask' ELSE url || 'n' END)) || '"/>' END || '</g></svg>' AS svg FROM pages""")
def raster_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    mask = F.when((k % 3 == 0) & (k % 2 == 1), F.encode(F.lit("mask"), "UTF-8"))
    new = F.when(k % 2 == 1, F.encode(F.concat("url", F.lit("n")), "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", svg.raster_page(F.encode("url", "UTF-8"), new, mask, F.lit(595.5), F.lit(842.0)).alias("svg"))


@query("""SELECT page_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 ' || page_id % 50 || '.5 10" width="' || page_id % 50 || '.5" height="10" data-diff-mode="unavailable"><g id="diff-old"></g><g id="diff-new"></g><g id="diff-changes"></g></svg>' AS svg FROM pages""")
def placeholder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", svg.placeholder_page(F.col("page_id") % 50 + 0.5, F.lit(10)).alias("svg"))


@query("""SELECT doc_id, CAST(list_sum(list_transform(string_split(lang, ''), lambda c: CASE c WHEN 'e' THEN 500 WHEN 'n' THEN 600 ELSE 0 END)) * 12 / 1000.0 AS DOUBLE) AS width,
 CASE WHEN lang = 'en' THEN '<g transform="translate(' || doc_id % 100 || ',7) scale(0.01200)"><path transform="translate(0,0)" d="M0"/><path transform="translate(500,0)" d="L1"/></g>' END AS outline FROM documents WHERE lang IS NOT NULL""")
def glyph_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs set in a font of two glyphs: a run with a letter that it lacks has no outline."""
    glyph = lambda path, w: F.struct(F.lit(path).alias("path"), F.lit(w).alias("advance"))
    font = F.create_map(F.lit("e"), glyph("M0", 500.0), F.lit("n"), glyph("L1", 600.0))
    d = table(spark, sf_dir, "documents").where("lang is not null")
    return d.select("doc_id", svg.run_width("lang", F.lit(12.0), font).alias("width"), svg.outline("lang", F.lit(12.0), (F.col("doc_id") % 100).cast("double"), F.lit(7.0), font).alias("outline"))


@query("SELECT user_id, bool_and(event_type <> 'click' OR event_id % 3 = 0) AND NOT bool_and(event_type = 'view') AS possible, count(*) FILTER (event_type <> 'view') = 0 AS image_only FROM events GROUP BY user_id")
def vector_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as pages: views are images, clicks texts of which every third has an outline, the rest paths."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "image").when(F.col("event_type") == "click", "text").otherwise("path")
    o = e.select("user_id", kind.alias("kind"), F.lit(0).alias("side"), (F.col("event_id") % 3 == 0).alias("outlinable"))
    return score.vector_possible(o, ["user_id"]).join(score.image_only(o, ["user_id"]), "user_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 AND value >= 100 AND event_id % 5 <> 0 THEN 'vector' WHEN event_id % 7 <> 0 THEN 'raster' ELSE 'unavailable' END AS mode FROM events")
def page_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    conf = F.when(F.col("value") >= 100, 0.6).otherwise(0.5999)
    return table(spark, sf_dir, "events").select("event_id", score.page_mode(k % 2 == 0, conf, F.when(k % 5 != 0, "svg"), F.when(k % 7 != 0, "png")).alias("mode"))


@query("WITH c AS (SELECT user_id, event_id % 5 = 0 AND user_id % 9 <> 0 AS r, event_id % 97 = 0 OR user_id % 9 = 0 AS u FROM events) SELECT user_id, NOT bool_and(u AND NOT r) AS ready FROM c GROUP BY user_id")
def result_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = score.overall(event_children(spark, sf_dir), ["user_id"])
    return o.select("user_id", score.is_ready(F.col("status"), F.size("units")).alias("ready"))


@query("SELECT event_id, array_to_string(list_transform(range(4), lambda i: CASE WHEN abs(event_id * (i + 1) % 60 - event_id * (i + 2) % 50) > 16 THEN '1' ELSE '0' END), '') AS mask FROM events")
def changed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    old, new = F.array(*((k * (i + 1)) % 60 for i in range(4))), F.array(*((k * (i + 2)) % 50 for i in range(4)))
    mask = F.transform(svg.changed_mask(old, new, 16), lambda x: F.when(x, "1").otherwise("0"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(mask, "").alias("mask"))


# --- runs and limits ----------------------------------------------------------------


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of two versions; the newer one has a line more. Every seventh has one version, every fifth an unknown type."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    one = d.select(k.cast("string").alias("file_uid"), F.lit("v1").alias("version"), F.when(k % 7 == 0, 0).otherwise(1).alias("ord"), "text", k.alias("k"))
    two = d.where(k % 7 != 0).select(k.cast("string").alias("file_uid"), F.lit("v2").alias("version"), F.lit(0).alias("ord"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nand a line more")).alias("text"), k.alias("k"))
    kind = F.when(F.col("k") % 5 == 0, "application/x-nothing").otherwise("text/plain; charset=utf-8")
    return one.union(two).select("file_uid", "version", "ord", F.lit("d.txt").alias("name"), kind.alias("mime"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_uid"), F.lit("").alias("target"), F.lit("").alias("base"))


FILE_KEY = "substr(sha256(doc_id || '|v1|v2|passthrough-text|1'), 1, 32)"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS file_uid, CASE WHEN doc_id % 7 = 0 THEN 'no_predecessor' ELSE 'ok' END AS verdict, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN 'passthrough-text' END AS plugin, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN {FILE_KEY} END AS key FROM documents""")
def run_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of a run: versions, type, operator and key of every request."""
    return run.dispatched(asked(spark, sf_dir), document_files(spark, sf_dir), registry.default_registry(text=True)).select("file_uid", "verdict", "plugin", "key")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS file_uid, {FILE_KEY} AS key, 'ready' AS status, 'vector' AS mode, 'diff.' || {FILE_KEY} || '.page.000.svg' AS names, 'vector' AS modes FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0""")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half: what is compared and what would be committed for it, as manifests. Texts are compared whole."""
    v = document_files(spark, sf_dir)
    reg = registry.default_registry(text=True, most_lines=None)
    todo = run.dispatched(asked(spark, sf_dir), v, reg).where("key is not null").select("key", "file_uid", "base", "target", "plugin", "plugin_version", "mime")
    results, children = run.computed(todo, v, reg)
    m = store.manifests(results, children)
    return m.select("file_uid", "key", "status", "mode", F.array_join("expected", ",").alias("names"), F.array_join(F.transform("units", lambda u: u["mode"]), ",").alias("modes"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS file_uid, CAST(len(string_split(d, '<text ')) - 1 AS BIGINT) AS rows_new FROM (SELECT doc_id, repeat('<text ', least(2000, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(string_split(text, chr(10))) END + CASE WHEN text IS NULL OR text = '' THEN 2 ELSE 1 END)) AS d FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0)""")
def text_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the new layer of each text comparison: the lines of the newer version, two thousand at most."""
    from ..operators.comparisons import compare_text

    v = document_files(spark, sf_dir).where("mime like 'text%'")
    pairs = versions.contents(versions.resolve(asked(spark, sf_dir), v).where("verdict = 'ok'").select("file_uid", "base", "target"), v)
    drawn = compare_text(pairs.withColumn("key", F.col("file_uid")))
    layer = F.regexp_extract(F.decode("data", "UTF-8"), r'(?s)<g id="diff-new">(.*?)</g><g id="diff-changes">', 1)
    return drawn.select(F.col("key").alias("file_uid"), (F.size(F.split(layer, "<text ")) - 1).cast("long").alias("rows_new"))


@query("SELECT user_id, user_id IN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 0 ORDER BY user_id LIMIT 64) AS accepted FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 <> 0)")
def jobs_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return ev.admitted(e, ["user_id"], e.where("user_id % 10 = 0").select("user_id").distinct()).select("user_id", "accepted")


@query(f"SELECT key, (SELECT count(*) > 100 FROM events) AS cut FROM (SELECT {KEY_SQL} AS key FROM events ORDER BY key LIMIT 100)")
def sweep_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pairs by key, and whether that left some out."""
    from .catalogue import event_keys

    rows, cut = store.swept(event_keys(spark, sf_dir).select("key"), 100)
    return rows.withColumn("cut", F.lit(cut))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS key, CAST(k - 1 AS INTEGER) AS index, 'diff.' || l_orderkey || '.page.' || lpad(CAST(k - 1 AS VARCHAR), 3, '0') || '.svg' AS name, CASE WHEN (l_orderkey + k) % 29 <> 0 THEN 'u' || l_orderkey || '-' || (k - 1) END AS uid FROM (SELECT l_orderkey, unnest(range(1, n + 1)) AS k FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1))""")
def child_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's names with their units, and the ids of the children that are there."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"))
    key = F.col("l_orderkey").cast("string")
    k = n.select(key.alias("file_uid"), key.alias("key"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"), "l_orderkey")
    named = k.withColumn("name", keys.child_name("key", F.lit("page"), F.col("k") - 1, F.lit("svg")))
    m = named.groupBy("file_uid", "key").agg(F.sort_array(F.collect_list("name")).alias("expected"), F.sort_array(F.collect_list(F.struct((F.col("k") - 1).alias("index"), F.lit("page").alias("kind"), F.lit("vector").alias("mode")))).alias("units"))
    present = named.where("(l_orderkey + k) % 29 <> 0").select("file_uid", "name", F.concat(F.lit("u"), "key", F.lit("-"), (F.col("k") - 1).cast("string")).alias("uid"))
    return store.child_references(m, present).select("key", "index", "name", "uid")


@query("SELECT CAST(c_custkey AS VARCHAR) AS file_uid, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 END AS allowed FROM customer")
def access_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list allows it and the file exists; a check that failed stays open."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    uid = k.cast("string").alias("file_uid")
    acl = c.select(F.lit("t").alias("tenant"), F.lit("u").alias("user"), uid, F.when(k % 4 != 0, k % 3 != 0).alias("allowed"))
    return access.checked(acl, c.where(k % 5 != 0).select(uid)).select("file_uid", "allowed")


@query("SELECT CAST(c_custkey AS VARCHAR) AS uid, c_name AS name, 3 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files in folders of nations in folders of regions, of which one hangs on itself only."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    region, nation = (lambda x: F.concat(F.lit("r"), x.cast("string"))), (lambda x: F.concat(F.lit("n"), x.cast("string")))
    top = F.when(F.col("r_regionkey") == 2, region(F.col("r_regionkey"))).otherwise(F.lit("root"))
    e = r.select(region(F.col("r_regionkey")).alias("uid"), top.alias("parent"), F.col("r_name").alias("name"), F.lit(True).alias("is_folder"))
    e = e.union(n.select(nation(F.col("n_nationkey")), region(F.col("n_regionkey")), "n_name", F.lit(True)))
    e = e.union(c.select(F.col("c_custkey").cast("string"), nation(F.col("c_nationkey")), "c_name", F.lit(False)))
    return files.tree(spark, e, "root").select("uid", "name", "depth")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'pdf' WHEN event_id % 3 = 1 THEN NULL WHEN event_id % 3 = 2 THEN NULL END AS limited, CASE event_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN '3d' END AS plain, CASE event_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN '3d' ELSE 'passthrough-text' END AS text FROM events")
def registry_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an allowlist, as it comes, and with plain text asked for."""
    m = F.expr("CASE event_id % 3 WHEN 0 THEN 'Application/PDF; v=1' WHEN 1 THEN 'model/gltf-binary' ELSE 'text/plain' END")
    limited, plain, text = registry.default_registry(True, ("pdf",)), registry.default_registry(), registry.default_registry(True)
    return table(spark, sf_dir, "events").select("event_id", limited.dispatch(m).alias("limited"), plain.dispatch(m).alias("plain"), text.dispatch(m).alias("text"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN value ELSE -1.0 END AS DOUBLE) AS n FROM events")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", keys.number(text, -1.0).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'ignore' WHEN event_id % 4 = 1 THEN 'compare' WHEN event_id % 4 = 2 THEN 'invalidate' ELSE 'ignore' END AS action FROM events")
def event_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they come: broken, an update, a change of access, an update of our own output."""
    k = F.col("event_id")
    payload = F.when(k % 4 == 0, "{broken").when(k % 4 == 1, F.concat(F.lit('{"type":"file.updated","file_uid":"'), k.cast("string"), F.lit('"}'))).when(k % 4 == 2, '{"type":"acl.changed"}').otherwise('{"type":"file.updated","file_uid":"x","is_rendition":true}')
    return ev.routed(ev.decoded(table(spark, sf_dir, "events").select(k.alias("n"), payload.alias("payload")))).select(F.col("n").alias("event_id"), "action")
