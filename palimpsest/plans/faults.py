"""Queries over what goes wrong and what is forgotten: pairs that can't be compared, voids, bounded memories, orders of names."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..operators import access, registry, run, versions
from ..sources import pdf, step
from ..streaming import events as ev
from .catalogue import decisions, query, table
from .reading import FILE_KEY, asked, binary, document_files


def outcomes(spark: SparkSession, sf_dir: str, entry: registry.Entry) -> DataFrame:
    """Documents compared by one operator: what would be committed for each pair."""
    v, reg = document_files(spark, sf_dir), registry.Registry()
    reg.register(entry)
    todo = run.dispatched(asked(spark, sf_dir), v, reg).where("key is not null").select("key", "file_uid", "base", "target", "plugin", "plugin_version", "mime")
    results, children = run.computed(todo, v, reg)
    n = children.groupBy("key").agg(F.count("*").alias("n_children"))
    return results.join(n, "key", "left").select("file_uid", "key", "status", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("failure.stage", F.lit("")).alias("stage"), F.coalesce("failure.reason", F.lit("")).alias("reason"))


PLAIN = "passthrough-text"
PAIRS_SQL = f"""SELECT CAST(doc_id AS VARCHAR) AS file_uid, {FILE_KEY} AS key, CASE WHEN bad THEN 'failed' ELSE 'ready' END AS status, CASE WHEN bad THEN 0 ELSE 1 END AS n_children, CASE WHEN bad THEN 'plugin' ELSE '' END AS stage, CASE WHEN bad THEN reason ELSE '' END AS reason"""


@query(f"""{PAIRS_SQL} FROM (SELECT doc_id, d % 100 = 3 OR d % 100 = 8 AS bad, CASE WHEN d % 100 = 3 THEN 'ValueError: ' || d || ' bytes' ELSE 'TypeError: comparison returned NoneType, not a list of children' END AS reason
FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS d FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0))""")
def failing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of one pair at a time that raises, or gives no list, for some lengths of the older file: those pairs fail, each with its reason."""

    def lengths(base: dict, target: dict) -> list[dict]:
        n = len(base["content"])
        if n % 100 == 3:
            raise ValueError(f"{n} bytes")
        if n % 100 == 8:
            return None
        return [{"kind": "page", "idx": 0, "ext": "svg", "mime": "image/svg+xml", "mode": "vector", "data": str(len(target["content"]) - n).encode()}]

    return outcomes(spark, sf_dir, registry.Entry(PLAIN, 1, lambda m: F.startswith(mime.bare(m), F.lit("text/plain")), pair=lengths))


@query(f"""{PAIRS_SQL} FROM (SELECT doc_id, doc_id % 613 = 1 AS bad, 'SparkRuntimeException: [USER_RAISED_EXCEPTION] pair ' || {FILE_KEY} || ' can''t be compared SQLSTATE: P0001' AS reason FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0)""")
def failing_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison of all pairs as one plan that fails over some of them: slices are tried until those stand alone."""
    from ..operators.comparisons import child

    def plan(pairs: DataFrame) -> DataFrame:
        doomed = F.col("file_uid").cast("long") % 613 == 1
        data = F.when(doomed, F.raise_error(F.concat(F.lit("pair "), "key", F.lit(" can't be compared")))).otherwise("")
        return pairs.select(*child("page", F.lit(0), "svg", "image/svg+xml", F.lit("vector"), F.encode(data.cast("string"), "UTF-8")))

    return outcomes(spark, sf_dir, registry.Entry(PLAIN, 1, lambda m: F.startswith(mime.bare(m), F.lit("text/plain")), plan))


@query("""WITH d AS (SELECT event_type AS who, user_id, ts, event_id % 3 = 0 AS ok FROM events WHERE event_id % 2 = 0 AND event_id % 10 <> 0),
r AS (SELECT event_type AS who, user_id, ts, event_id FROM events WHERE event_id % 2 = 1),
l AS (SELECT r.event_id, max(d.ts) AS dts FROM r LEFT JOIN d ON r.who = d.who AND r.user_id = d.user_id AND d.ts <= r.ts GROUP BY r.event_id),
g AS (SELECT ts, user_id, event_type AS who, CASE WHEN event_id % 1501 = 7 THEN 't' WHEN event_id % 30 = 1 THEN 'r' WHEN event_id % 30 = 3 AND user_id % 50 = 0 THEN 'm' END AS k FROM events),
v AS (SELECT r.event_id, max(g.ts) AS vts FROM r JOIN l USING (event_id) JOIN g ON g.ts <= r.ts AND g.ts > l.dts AND (g.k = 't' OR g.k = 'r' AND g.user_id = r.user_id OR g.k = 'm' AND g.who = r.who) WHERE r.ts < l.dts + INTERVAL 5 DAY GROUP BY r.event_id)
SELECT r.event_id AS request, bool_or(d.ok) FILTER (l.dts + INTERVAL 5 DAY > r.ts AND v.vts IS NULL) AS allowed
FROM r JOIN l USING (event_id) LEFT JOIN v USING (event_id) LEFT JOIN d ON d.who = r.who AND d.user_id = r.user_id AND d.ts = l.dts GROUP BY r.event_id""")
def permission_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered from what is remembered, after expiry and the voids of files, members and the tenant up to each request."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    r = e.where(k % 2 == 1).select(F.lit("t").alias("tenant"), F.col("event_type").alias("user"), F.col("user_id").cast("string").alias("file_uid"), F.col("ts").alias("at"), k.alias("request"))
    kind = F.when(k % 1501 == 7, "role.deleted").when(k % 30 == 1, "acl.changed").when((k % 30 == 3) & (F.col("user_id") % 50 == 0), "role.assigned")
    voids = e.select(kind.alias("type"), F.lit("t").alias("tenant"), F.col("user_id").cast("string").alias("file_uid"), F.col("event_type").alias("member"), F.col("ts").alias("at")).where("type is not null")
    return access.answers(r, decisions(spark, sf_dir), voids, 5 * 86400).select("request", "allowed")


@query("""WITH RECURSIVE e AS (SELECT event_id % 16 AS s, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS k, event_id AS n, CASE WHEN event_id % 41 <> 0 THEN CAST(user_id % 40 AS VARCHAR) ELSE '' END AS id FROM events),
w AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS n, FALSE AS kept, CAST([] AS VARCHAR[]) AS seen FROM e UNION ALL
  SELECT e.s, e.k, e.n, e.id = '' OR NOT list_contains(w.seen, e.id), CASE WHEN e.id = '' OR list_contains(w.seen, e.id) THEN w.seen WHEN len(w.seen) < 8 THEN list_append(w.seen, e.id) ELSE list_append(w.seen[2:], e.id) END
  FROM w JOIN e ON e.s = w.s AND e.k = w.k + 1)
SELECT n FROM w WHERE kept""")
def event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which no equal id is among the last eight new ones of their shard."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    named = e.select(F.when(k % 41 != 0, (F.col("user_id") % 40).cast("string")).otherwise("").alias("event_id"), k.alias("n"))
    return ev.first_within(named, ["n"], 8, F.col("n") % 16).select("n")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS file_uid, 'v' || o_orderkey AS version, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)""")
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions named by numbers without leading zeros: v9 is older than v10."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("file_uid"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version")).distinct()
    return versions.ordered(o, [F.desc(versions.natural("version"))]).select("file_uid", "version", "ord")


def zipped(name: str, content: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("read.me"), "a model")
        z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'application/x-ifc-zip' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/x-ifc' END AS mime,
CASE WHEN p_partkey % 4 IN (0, 3) THEN '3d' END AS plugin, CASE WHEN p_partkey % 4 <> 2 THEN 'no-geometry:' || repeat('7', 22) ELSE 'open-failed:NotStep' END AS problem FROM part""")
def zipped_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real containers of a model under the name of one and of another, one of a text document, and the model as it is."""
    k = F.col("p_partkey") % 4
    model = "ISO-10303-21;\nHEADER;FILE_SCHEMA(('IFC4'));ENDSEC;\nDATA;\n#1=IFCWALL('" + "7" * 22 + "',$,'w',$,$,#2,#3,$);\nENDSEC;"
    packed, text = zipped("deep/model.IFC", model), zipped("word/document.xml", "<w/>")
    content = F.when(k == 2, F.unhex(F.lit(text.hex()))).when(k == 3, binary(model)).otherwise(F.unhex(F.lit(packed.hex())))
    name = F.when(k == 0, "M.IfcZip").when(k == 1, "m.zip").when(k == 2, "m.ifczip").otherwise("m.ifc")
    files = table(spark, sf_dir, "part").select("p_partkey", content.alias("content"), name.alias("name"))
    told = files.withColumn("mime", mime.detect("content", "name"))
    read = step.elements(files, ["p_partkey"]).select("p_partkey", F.coalesce("problem", F.lit("")).alias("problem"))
    return told.select("p_partkey", "mime", registry.default_registry().dispatch(F.col("mime")).alias("plugin")).join(read, "p_partkey")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'BX,zz,EX' ELSE 're' END AS unknown FROM part")
def pdf_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators that want more operands than they have: those of the state are passed over, those of a path are told as unknown."""
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, "1 2 cm 3 Tf w TL 1 Td 1 TD 1 2 Tm").when(k == 1, "BX zz EX").otherwise("1 2 re")
    content = binary("%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 9 9]>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n4 0 obj<<>>stream\n", body, "\nendstream endobj\n")
    o = pdf.objects(table(spark, sf_dir, "part").select("p_partkey", content.alias("content")), ["p_partkey"])
    return o.select("p_partkey", F.array_join("unknown_ops", ",").alias("unknown"))
