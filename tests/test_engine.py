"""Comparison semantics on small hand-made inputs, and the query catalogue against brute force."""

import json
import math
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keys, mime, svg
from palimpsest.operators import access, keyed, models, registry, score, sequence, spatial, store, versions
from palimpsest.schemas import ELEMENT, EVENT, PAGE_OBJECT
from palimpsest.sources import files, gltf, pdf
from palimpsest.sources.kernels import parsed
from palimpsest.streaming import events as ev

SF = "/root/testdata/sf0.001"


def obj(i, sig, x, y, style="w=1.0"):
    return ("u", "path", sig, float(x), float(y), style, "", 0.0, [], ["S"], i)


def pages(spark, old, new):
    f = lambda rows: spark.createDataFrame([obj(i, *r) for i, r in enumerate(rows)], "unit string, " + PAGE_OBJECT)
    rows = spatial.compare_pages(f(old), f(new), ["unit"]).collect()
    return Counter(r.state for r in rows), rows


BASE = [("a", 72, 700), ("b", 72, 600), ("c", 300, 500)]


@pytest.mark.parametrize(
    "new, want",
    [
        (BASE, {"unchanged": 3}),
        ([*BASE, ("d", 1, 1)], {"unchanged": 3, "added": 1}),
        ([BASE[0], BASE[2]], {"unchanged": 2, "deleted": 1}),
        ([("x", 0, 0), *BASE], {"unchanged": 3, "added": 1}),
        ([BASE[0], ("b", 84, 600), BASE[2]], {"unchanged": 2, "modified": 1}),
        ([BASE[0], ("b", 430, 120), BASE[2]], {"unchanged": 2, "added": 1, "deleted": 1}),
        ([BASE[0], (*BASE[1], "w=6.0"), BASE[2]], {"unchanged": 2, "modified": 1}),
        ([(s, x, y - 24) for s, x, y in BASE], {"unchanged": 3}),
        ([BASE[2], BASE[0], BASE[1]], {"unchanged": 3}),
    ],
)
def test_page_fixtures(spark, new, want):
    assert pages(spark, BASE, new)[0] == want


def test_reasons(spark):
    rows = pages(spark, BASE, [BASE[0], ("b", 84, 600, "w=2.0"), BASE[2]])[1]
    assert [r.reason for r in rows if r.state == "modified"] == ["moved 12.0+style"]


def test_competing_shifts_give_no_offset(spark):
    f = lambda rows: spark.createDataFrame([("u", s, float(x), 0.0) for s, x in rows], "unit string, signature string, x double, y double")
    r = spatial.dominant_offset(f([("a", 0), ("b", 0)]), f([("a", 10), ("b", 20)]), ["unit"]).first()
    assert (r.dx, r.dy) == (0.0, 0.0)


def shape(i, dx=0.0, scale=1.0):
    return ("m", "", f"n{i}", "", "mesh", [dx, 0.0, 0.0, dx + scale, 0.0, 0.0, dx, scale, 0.0], [0, 1, 2], {}, i)


@pytest.mark.parametrize(
    "old, new, want",
    [
        ([shape(0)], [shape(0)], {"unchanged": 1}),
        ([shape(0)], [shape(0), shape(1, 10.0)], {"unchanged": 1, "added": 1}),
        ([shape(0)], [shape(0, 0.5)], {"added": 1, "deleted": 1}),
        ([shape(0)], [shape(0, scale=2.0)], {"added": 1, "deleted": 1}),
        ([shape(0, 50.0), shape(1)], [shape(0)], {"unchanged": 1, "deleted": 1}),
    ],
)
def test_shape_fixtures(spark, old, new, want):
    f = lambda rows: spark.createDataFrame(rows, "model string, " + ELEMENT)
    assert Counter(r.state for r in spatial.compare_shapes(f(old), f(new), ["model"]).collect()) == want


def test_nearest_first_is_the_global_greedy(spark):
    import random

    rng = random.Random(4)
    rows = lambda n: [("m", rng.choice("ab"), i, (rng.random(), rng.random(), 0.0)) for i in range(n)]
    a, b = rows(40), rows(45)
    f = lambda r: spark.createDataFrame(r, "model string, shape string, idx int, center struct<x:double,y:double,z:double>")
    got = {(r.old_idx, r.new_idx) for r in spatial.nearest_first(f(a), f(b), ["model"]).collect()}
    cand = sorted((math.dist(x[3], y[3]), x[2], y[2]) for x in a for y in b if x[1] == y[1])
    want, uo, un = set(), set(), set()
    for _, i, j in cand:
        if i not in uo and j not in un:
            uo.add(i), un.add(j), want.add((i, j))
    assert got == want


def test_keyed_duplicates_and_missing_ids(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z"), (None, 4, "w")], "id string, o int, v string")
    assert [tuple(r) for r in keyed.last_of_each(d, ["id"], ["o"]).select("id", "v").collect()] == [("a", "y")]


def test_keyed_geometry_outranks_property(spark):
    f = lambda s, p: spark.createDataFrame([("a", s, p)], "id string, shape string, props map<string,string>")
    r = keyed.keyed_diff(f("1", {"k": "x"}), f("2", {"k": "y", "n": ""}), ["id"], "shape", "props").first()
    assert (r.state, r.change, r.changed_properties) == ("modified", "geometry", ["k", "n"])
    r = keyed.keyed_diff(f("1", {"k": "x"}), f("1", {"k": "x", "n": None}), ["id"], "shape", "props").first()
    assert (r.state, r.change) == ("unchanged", None)


def test_page_pairing(spark):
    f = lambda s: spark.createDataFrame([("d", i, x) for i, x in enumerate(s)], "doc string, idx int, signature string")
    pair = lambda a, b: [(r.old_idx, r.new_idx) for r in sequence.pair_pages(f(a), f(b), ["doc"]).orderBy("seq").collect()]
    assert pair("ab", "axb") == [(0, 0), (None, 1), (1, 2)]
    assert pair("abc", "ac") == [(0, 0), (2, 1), (1, None)]
    assert pair("ab", "ba") == [(1, 0), (0, 1)]


def test_line_states(spark):
    f = lambda s: spark.createDataFrame([("d", i, x) for i, x in enumerate(s)], "doc string, idx int, line string")
    rows = sequence.line_states(f("abc"), f("axcd"), ["doc"]).collect()
    assert [(r.line, r.state) for r in rows if r.layer == "diff-changes"] == [("b", "modified"), ("x", "modified"), ("d", "added")]


def test_versions(spark):
    v = spark.createDataFrame([("f", "v3", 0), ("f", "v2", 1), ("f", "v1", 2)], "file_uid string, version string, ord int")
    q = spark.createDataFrame([("f", "", ""), ("f", "v1", ""), ("f", "v2", "v3"), ("f", "v9", ""), ("f", "v3", "v9"), ("g", "", ""), ("f", "v3", "v1")], "file_uid string, target string, base string")
    got = {(r.target, r.base): r.verdict for r in versions.resolve(q, v).collect()}
    assert got == {("v3", "v2"): "ok", ("v1", None): "no_predecessor", ("v2", "v3"): "base_not_older", ("v9", None): "target_not_found", ("v3", "v9"): "base_not_found", (None, None): "no_versions", ("v3", "v1"): "ok"}


def test_mime(spark):
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "x")
    cases = {b"%PDF-1.7": "application/pdf", b"RIFF0000WEBP": "image/webp", b"0000ftypisom": "video/mp4", b" <HTML>": "text/html", z.getvalue(): mime.OFFICE["word/"], b"PK\x03\x04broken": "application/zip", b"solid x\nfacet": "model/stl", b'{"CityJSON": 1}': "application/city+json", b"x" * 72 + b"S      1": None, b"x" * 72 + b"S0000001": "model/iges", b"hello": None, b"": None}
    d = spark.createDataFrame([(k, v or "") for k, v in cases.items()], "c binary, want string")
    assert all((r.got or "") == r.want for r in d.select("want", mime.sniff("c").alias("got")).collect())


def test_svg_page(spark):
    rows = pages(spark, BASE, [BASE[0], ("b", 84, 600), ("new", 1, 2)])[1]
    assert rows
    f = lambda r: spark.createDataFrame([obj(i, *x)[:8] + ([(0.0, 0.0), (1.5, 2.0)], ["m", "l", "S"], i) for i, x in enumerate(r)], "unit string, " + PAGE_OBJECT).withColumn("outline", F.lit(None).cast("string"))
    d = keyed.in_order(spatial.compare_pages(f(BASE), f([BASE[0], ("b", 84, 600)]), ["unit"]), ["unit"], F.col("old.idx"), F.col("new.idx"))
    s = svg.render_pages(d.withColumns({"width": F.lit(595.0), "height": F.lit(842.0)}), ["unit"]).first().svg
    old, changes = s[s.index("diff-old") : s.index("diff-new")], s[s.index("diff-changes") :]
    assert 'state="added"' not in old and changes.count("<path") == 2 and 'd="M0,0 L1.5,2"' in s and "fill" in s


def test_parsers_report_errors(spark):
    f = spark.createDataFrame([("a", bytearray(b"x")), ("b", None)], "k string, content binary")

    def bad(raw):
        raise ValueError

    assert {r.problem for r in parsed(f, ["k"], "content", bad, "n int").collect()} == {"loader-error:ValueError"}
    assert gltf.elements(f, ["k"]).where("problem = 'unreadable-gltf'").count() == 2


def test_files_of_one_task_are_parsed_in_many(spark):
    f = spark.range(64).coalesce(1).select(F.col("id").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    got = parsed(f, ["k"], "content", lambda c: [{"n": int(c), "x": {"a": "b"}}, {"n": 1.0}], "n int, x map<string,string>").select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) > 1
    assert sorted((r.k, r.n, str(r.x)) for r in got) == sorted(x for k in range(64) for x in ((k, k, "{'a': 'b'}"), (k, 1, "None")))


def test_pdf_files_of_one_task_are_read_in_many(spark):
    f = spark.range(64).coalesce(1).select(F.col("id").alias("k"), F.encode(F.lit("plain"), "UTF-8").alias("content"))
    got = pdf.objects(f, ["k"]).select("k", "problem", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) > 1 and sorted((r.k, r.problem) for r in got) == [(k, "open-failed") for k in range(64)]


def test_scenes_of_one_task_are_read_in_many(spark):
    f = spark.range(64).coalesce(1).select(F.col("id").alias("k"), F.encode(F.lit("{}"), "UTF-8").alias("content"))
    got = gltf.elements(f, ["k"]).select("k", "problem", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) > 1 and sorted((r.k, r.problem) for r in got) == [(k, "unreadable-gltf") for k in range(64)]


def test_registry(spark):
    d = spark.createDataFrame([("application/pdf; x=1",), ("model/step",), ("text/plain",), ("image/png",)], "m string")
    names = lambda r: [x[0] for x in d.select(r.dispatch(F.col("m"))).collect()]
    assert names(registry.default_registry()) == ["pdf", "3d", None, None]
    assert names(registry.default_registry(text=True, enabled=("passthrough-text",))) == [None, None, "passthrough-text", None]


def test_store_commits_last_and_serves_complete_only(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path))
    pairs = store.keyed(spark.createDataFrame([("f", "v1", "v2", "pdf", 1)], "file_uid string, base string, target string, plugin string, plugin_version int"))
    key = pairs.first().key
    assert s.served().count() == 0
    r = pairs.withColumns({"status": F.lit("ready"), "mode": F.lit("vector"), "failure": F.lit(None).cast("struct<reason:string,stage:string,tiers_attempted:array<string>>")})
    c = spark.createDataFrame([("f", key, "page", i, "svg", "image/svg+xml", "vector", bytearray(b"x")) for i in (1, 0)], "file_uid string, key string, kind string, idx int, ext string, mime string, mode string, data binary")
    s.commit(r, c)
    m = s.served().first()
    assert m.expected == [f"diff.{key}.page.000.svg", f"diff.{key}.page.001.svg"] and [u["index"] for u in m.units] == [0, 1]
    assert store.pending(pairs, s.served()).count() == 0
    s.drop(spark.createDataFrame([("f", f"diff.{key}.page.001.svg")], "file_uid string, name string"))
    assert s.served().count() == 0 and s.children().count() == 1
    # written again after it was dropped, it stands
    s.commit(r, c)
    assert s.served().count() == 1 and s.children().count() == 2 and s.served(pairs).count() == 1
    s.drop_keys(pairs.select("file_uid", "key"))
    assert s.names().count() == 0


def test_manifest_json_is_canonical_and_lenient(spark):
    d = spark.createDataFrame([("b", [], None, "é😀", "k", "", "p", 1, 1, "ready", "t", [])], "base_version string, expected array<string>, failure struct<reason:string,stage:string,tiers_attempted:array<string>>, file_uid string, key string, mode string, plugin string, plugin_version int, schema int, status string, target_version string, units array<struct<index:int,kind:string,mode:string>>")
    raw = d.select(store.to_json(d)).first()[0]
    assert raw == json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":")) and "failure" not in raw
    bad = spark.createDataFrame([("{",), ('{"key":"k"}',)], "t string").select(store.from_json("t").alias("m")).collect()
    assert bad[0].m is None and bad[1].m.key == "k"


def test_access_as_of_and_invalidation(spark):
    t = datetime(2024, 1, 1)
    s = lambda n: t + timedelta(seconds=n)
    d = spark.createDataFrame([("t", "u", "f", True, s(0)), ("t", "u", "f", False, s(100)), ("t", "u", "g", None, s(0))], "tenant string, user string, file_uid string, allowed boolean, decided_at timestamp")
    q = spark.createDataFrame([("t", "u", "f", s(50), 1), ("t", "u", "f", s(150), 2), ("t", "u", "f", s(500), 3), ("t", "u", "g", s(1), 4)], "tenant string, user string, file_uid string, at timestamp, request long")
    assert {r.request: r.allowed for r in access.as_of(q, d).collect()} == {1: True, 2: False, 3: None, 4: None}
    e = spark.createDataFrame([("acl.changed", "t", "f", "", s(50)), ("role.assigned", "t", "", "other", s(200)), ("role.deleted", "x", "", "", s(200))], "type string, tenant string, file_uid string, member string, at timestamp")
    assert {(r.file_uid, r.decided_at) for r in access.invalidated(d, e).collect()} == {("f", s(100)), ("g", s(0))}


def test_confidence(spark):
    c = lambda m, o, n, p: spark.range(1).select(score.confidence(F.lit(m), F.lit(o), F.lit(n), F.lit(p))).first()[0]
    assert (c(2, 2, 3, 0), c(1, 2, 2, 0), c(2, 2, 2, 1), c(0, 0, 5, 3)) == (1.0, 0.5, 0.5, 1.0)


def test_event_decoding(spark):
    d = ev.decoded(spark.createDataFrame([("{bad",), ('{"type":"acl.changed"}',)], "payload string"))
    assert [r.action for r in ev.routed(d).collect()] == ["ignore", "invalidate"] and EVENT.startswith("type")


def test_lines_follow_splitlines(spark):
    texts = ["", "a", "a\n", "a\nb\n", "a\r\nb\x0bc d", "\n\n"]
    d = spark.createDataFrame([(t, t.encode()) for t in texts], "t string, c binary")
    for r in d.select("t", files.lines_of(F.col("c")).alias("l")).collect():
        assert r.l == r.t.splitlines()


def test_tree(spark):
    e = spark.createDataFrame([("a", "r", "a", True), ("f", "a", "f", False), ("g", "r", "g", False), ("a2", "a", "a2", True), ("h", "a2", "h", False)], "uid string, parent string, name string, is_folder boolean")
    assert {(r.uid, r.depth) for r in files.tree(spark, e, "r").collect()} == {("f", 2), ("g", 1), ("h", 3)}


def test_identities_agree_with_python(spark):
    import hashlib

    verts, faces = [0.00005, -0.00004, 2.0, 1.0, 0.0, -3.0], [0, 1]
    want = hashlib.sha256(("".join(f"{round(v / 1e-4)}," for v in verts) + "|0,1,").encode()).hexdigest()[:32]
    d = spark.createDataFrame([(verts, faces), ([], [])], "v array<double>, f array<int>")
    rows = d.select(keys.geometry_hash("v", "f").alias("h"), keys.shape_signature("v", "f").alias("s")).collect()
    assert rows[0].h == want and rows[1].s == ""


def test_entry_and_all_queries_have_columns(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    for name, f in e.queries().items():
        if not name.startswith(("op", "pipeline")):
            assert f(spark, SF).columns, name
    assert set(e.oracle_sql()) <= set(e.queries())


def test_catalogue_against_duckdb(spark):
    import duckdb

    from palimpsest.plans import catalogue

    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents embeddings pages conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")

    def cell(v):
        if v is None or v != v:
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    for name, sql in catalogue.oracle_sql().items():
        r = con.execute(sql)
        cols = [c[0] for c in r.description]
        want = sorted(tuple(map(cell, x)) for x in r.fetchall())
        df = catalogue.queries()[name](spark, SF)
        assert sorted(df.columns) == sorted(cols), name
        assert sorted(tuple(map(cell, x)) for x in df.select(*cols).collect()) == want, name


def test_models_are_described_and_merged(spark):
    f = lambda rows: spark.createDataFrame(rows, "model string, " + ELEMENT)
    el = lambda i, dx, p: ("m", f"id{i}", f"n{i}", "", "Wall", shape(0, dx)[5], [0, 1, 2], p, i)
    old, new = f([el(0, 0.0, {}), el(1, 0.0, {"a": "1"})]), f([el(1, 0.0, {"a": "2"}), el(2, 5.0, {})])
    side = lambda d: d.select("model", "stable_id", keys.geometry_hash("verts", "faces").alias("shape"), "properties", "local_id", "name", "type_name", "verts", "faces", "idx")
    d = keyed.keyed_diff(side(old), side(new), ["model", "stable_id"], "shape", "properties")
    d = d.withColumns({s: F.when(F.col(s).isNotNull(), F.struct(F.col("stable_id"), F.col(f"{s}.local_id"), F.col(f"{s}.name"), F.col(f"{s}.type_name"), F.col(f"{s}.verts"), F.col(f"{s}.faces"), F.col(f"{s}.idx"))) for s in ("old", "new")})
    d = keyed.in_order(d, ["model"], F.col("old.idx"), F.col("new.idx"))
    sc = spark.createDataFrame([("m", "stable-id", 1.0)], "model string, tier string, confidence double")
    body = json.loads(models.metamodels(d, ["model"], sc).first().body)
    assert body["diffSummary"]["added"] == 1 and body["diffSummary"]["propertyChanges"] == 1
    assert {o["id"] for o in body["metaObjects"]} == {"diff", "old", "new", "difference", "id1|old", "id1|new", "id0|old", "id0|diff", "id2|new", "id2|diff"}
    doc, _ = gltf.container(models.merged_files(d, ["model"], z_up=True).first().glb)
    assert {n["name"]: len(n.get("children", [])) for n in doc["nodes"] if n["name"] in models.GROUPS} == {"old": 2, "new": 2, "difference": 2}
    # every mesh of the file is an object of the description, under the same id
    meshes = {n["name"] for n in doc["nodes"] if "mesh" in n}
    assert meshes == {o["id"] for o in body["metaObjects"] if o["type"] not in ("Project", "Layer")}


def test_text_pages_and_outlines(spark):
    f = lambda s: spark.createDataFrame([("d", i, x) for i, x in enumerate(s)], "doc string, idx int, line string")
    s = svg.text_pages(sequence.line_states(f(["a<", "b"]), f(["a<", "c"]), ["doc"]), ["doc"]).first().svg
    assert "a&lt;" in s and s.count('state="modified"') == 2 and 'id="diff-changes"' in s
    g = spark.createDataFrame([({"a": ("M0,0", 500.0)},)], f"g {svg.GLYPHS}")
    r = g.select(svg.outline(F.lit("aa"), F.lit(10.0), F.lit(1.0), F.lit(2.0), F.col("g")).alias("o"), svg.run_width(F.lit("aa"), F.lit(10.0), F.col("g")).alias("w"), svg.outline(F.lit("ab"), F.lit(10.0), F.lit(1.0), F.lit(2.0), F.col("g")).alias("n")).first()
    assert r.o.count("<path") == 2 and r.w == 10.0 and r.n is None


def test_sweeps_say_when_they_are_cut(spark):
    d = spark.range(5).withColumnRenamed("id", "key")
    assert store.swept(d, 5)[1] is False and store.swept(d, 4)[1] is True
