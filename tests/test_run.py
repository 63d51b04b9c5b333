"""Comparisons from request to committed result, over files of every kind; deletion and governance in the stream."""

import json
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import registry, run, sequence, spatial, store
from palimpsest.operators.comparisons import Tools
from palimpsest.sources import gltf
from palimpsest.streaming import events as ev

VERSIONS = "file_uid string, version string, ord int, name string, mime string, content binary"


def pdf_file(*contents: bytes) -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    out = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/MediaBox[0 0 200 100]/Kids[" + kids + b"]>>endobj\n"
    for i, c in enumerate(contents):
        out += b"%d 0 obj<</Type/Page/Parent 2 0 R/Contents %d 0 R>>endobj\n%d 0 obj<</Length %d>>stream\n" % (10 + 2 * i, 11 + 2 * i, 11 + 2 * i, len(c)) + c + b"\nendstream endobj\n"
    return out


def glb(*places: float) -> bytes:
    return gltf.write_glb({"g": [(f"n{i}", [x, 0, 0, x + 1 + i, 0, 0, x, 1, 0], [0, 1, 2]) for i, x in enumerate(places)]})


BOX, FAR = b"10 10 30 20 re S", b"10 10 30 20 re S 100 50 20 20 re f"


def versions_of(spark):
    two = lambda uid, name, old, new, mime="": [(uid, "v2", 0, name, mime, bytearray(new)), (uid, "v1", 1, name, mime, bytearray(old))]
    rows = [
        *two("drawing", "a.pdf", pdf_file(BOX, b"1 1 5 5 re f"), pdf_file(FAR, b"1 1 5 5 re f", b"3 3 9 9 re S")),
        *two("words", "w.pdf", pdf_file(b"BT /F1 9 Tf (x) Tj ET"), pdf_file(b"BT /F1 9 Tf (y) Tj ET")),
        *two("shut", "s.pdf", b"%PDF-1.5 nothing", b"%PDF-1.5 nothing"),
        *two("model", "m.glb", glb(0.0, 4.0), glb(0.0, 9.0, 20.0)),
        *two("cad", "c.step", b"ISO-10303-21; FILE_SCHEMA(('AP214'))", b"ISO-10303-21; FILE_SCHEMA(('AP214'))"),
        *two("text", "t.txt", b"a\nb\n", b"a\nc\n", "text/plain"),
        *two("strange", "x.bin", b"\x00\x01", b"\x00\x02"),
        *two("large", "l.txt", b"z" * 5000, b"z", "text/plain"),
        ("first", "v1", 0, "f.txt", "text/plain", bytearray(b"a")),
    ]
    return spark.createDataFrame(rows, VERSIONS)


def requests_of(spark, uids):
    return spark.createDataFrame([(u, "", "") for u in uids], "file_uid string, target string, base string")


def test_runs_end_in_an_outcome_and_are_cached(spark, tmp_path):
    v, s, reg = versions_of(spark), store.ResultStore(spark, str(tmp_path)), registry.default_registry(text=True)
    asked = requests_of(spark, ["drawing", "words", "shut", "model", "cad", "text", "strange", "large", "first", "nobody"])
    out = {r.file_uid: r for r in run.run(asked, v, s, reg, most_bytes=4000).collect()}
    want = {"drawing": "computed", "words": "failed", "shut": "failed", "model": "computed", "cad": "failed", "text": "computed", "strange": "unsupported", "large": "too_large", "first": "no_predecessor", "nobody": "error"}
    assert {u: r.outcome for u, r in out.items()} == want
    assert "tool missing for step" in out["cad"].detail and "no-pages" in out["shut"].detail and "rendered" in out["words"].detail and out["nobody"].detail == "no_versions"
    m = {r.file_uid: r for r in s.served().collect()}
    assert set(m) == {"drawing", "words", "shut", "model", "cad", "text"}
    assert [u["mode"] for u in m["drawing"].units] == ["vector"] * 3 and m["drawing"].status == "ready" and m["drawing"].mode == "vector"
    assert m["shut"].status == "failed" and m["shut"].failure.stage == "parse" and m["cad"].failure.tiers_attempted == ["xkt"] and m["words"].failure.stage == "render"
    kids = {(r.file_uid, r.kind, r.idx): bytes(r.data) for r in s.children().collect()}
    assert set(kids) == {*(("drawing", "page", i) for i in range(3)), ("model", "model", 0), ("model", "metamodel", 1), ("text", "page", 0)}
    assert kids["drawing", "page", 0].count(b'state="added"') == 2 and b'data-diff-state="added"' in kids["drawing", "page", 2]
    doc, _ = gltf.container(kids["model", "model", 0])
    body = json.loads(kids["model", "metamodel", 1])
    assert {n["name"] for n in doc["nodes"] if "mesh" in n} == {o["id"] for o in body["metaObjects"] if o["type"] == "mesh"}
    assert body["diffSummary"]["tier"] == "geometry" and body["diffSummary"]["added"] == 2 and body["diffSummary"]["deleted"] == 1
    # what is there is served, failures too; force makes it again and nothing stands twice
    again = {r.file_uid: r.outcome for r in run.run(asked, v, s, reg, most_bytes=4000).collect()}
    assert again == want | dict.fromkeys(("drawing", "words", "shut", "model", "cad", "text"), "cached")
    forced = {r.file_uid: r.outcome for r in run.run(requests_of(spark, ["drawing", "shut"]), v, s, reg, force=True).collect()}
    assert forced == {"drawing": "computed", "shut": "failed"} and s.children().count() == 6 and s.served().count() == 6
    retried = {r.file_uid: r.outcome for r in run.run(requests_of(spark, ["drawing", "shut"]), v, s, reg, retry_failed=True).collect()}
    assert retried == {"drawing": "cached", "shut": "failed"}


def test_tools_carry_a_page_to_the_next_tier(spark, tmp_path):
    v, s = versions_of(spark).where("file_uid = 'words'"), store.ResultStore(spark, str(tmp_path))
    picture = lambda pages: pages.select("key", "page", F.encode(F.lit("png"), "UTF-8").alias("png"), F.array(F.length("content")).alias("grey"))
    run.run(requests_of(spark, ["words"]), v, s, registry.default_registry(tools=Tools(raster=picture)))
    m = s.served().first()
    assert m.status == "ready" and m.mode == "raster" and b"data:image/png" in bytes(s.children().first().data)
    t, lettered = store.ResultStore(spark, str(tmp_path / "outlined")), b"BT /F1 9 Tf (x) Tj ET "
    v = spark.createDataFrame([("words", f"v{2 - k}", k, "w.pdf", "", bytearray(pdf_file(c))) for k, c in enumerate((lettered + BOX, lettered))], VERSIONS)
    run.run(requests_of(spark, ["words"]), v, t, registry.default_registry(tools=Tools(outline=lambda o: F.concat(F.lit("<path/>"), o["text"]))))
    assert t.served().first().mode == "vector"


def test_superseded_results_go_and_other_pairs_stay(spark, tmp_path):
    v, s = versions_of(spark).where("file_uid = 'text'"), store.ResultStore(spark, str(tmp_path))
    reg = registry.default_registry(text=True)
    run.run(requests_of(spark, ["text"]), v, s, reg)
    old = s.served().first().key
    newer = registry.default_registry(text=True)
    for e in newer.entries:
        e.version = 2
    run.run(requests_of(spark, ["text"]), v, s, newer)
    assert [r.plugin_version for r in s.served().collect()] == [2] and s.served().first().key != old and s.names().count() == 2


def test_the_stream_compares_deletes_and_retries(spark, tmp_path):
    src, aside = tmp_path / "in", str(tmp_path / "aside")
    src.mkdir()
    v, s, reg = versions_of(spark), store.ResultStore(spark, str(tmp_path / "out")), registry.default_registry(text=True)
    work = ev.consumer(lambda: v, s, reg, aside)
    event = lambda kind, i, uid, at, version="v2": {"type": kind, "event_id": i, "file_uid": uid, "version": version, "ts": f"2026-01-01T00:00:{at:02d}"}
    up, down = "file.updated", "file.deleted"
    batches = [
        # an id once, whatever it is about; a file of which nothing is known is put aside
        [event(up, "1", "text", 1), event(up, "2", "model", 2), event(up, "2", "drawing", 3), event(up, "3", "nobody", 4)],
        # updated and then deleted; deleted and then updated again
        [event(up, "4", "drawing", 5), event(down, "5", "drawing", 6), event(down, "6", "text", 7), event(up, "7", "text", 8), event(up, "1", "model", 9)],
        [event(down, "8", "model", 10)],
    ]
    left = [{"text", "model"}, {"text", "model"}, {"text"}]
    for k, (events, want) in enumerate(zip(batches, left, strict=True)):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, events)))
        q = ev.start(ev.watched(ev.read_events(spark, str(src))), work, str(tmp_path / "c"))
        assert q.awaitTermination(300)
        assert {r.file_uid for r in s.served().collect()} == want, k
    assert [(r.file_uid, r.target) for r in ev.retried(spark, aside, s).collect()] == [("nobody", "v2")]
    known = v.union(spark.createDataFrame([("nobody", f"v{2 - k}", k, "n.txt", "text/plain", bytearray(b"x%d" % k)) for k in range(2)], VERSIONS))
    assert [r.outcome for r in run.run(ev.retried(spark, aside, s), known, s, reg).collect()] == ["computed"]
    assert ev.retried(spark, aside, s).count() == 0 and ev.retried(spark, str(tmp_path / "never"), s).count() == 0


def test_room_is_told(spark):
    jobs = spark.createDataFrame([(i % 4, i) for i in range(9)], "k int, n int")
    got = {r.k: r.accepted for r in ev.admitted(jobs, ["k"], spark.createDataFrame([(0,)], "k int"), 2).collect()}
    assert got == {1: True, 2: True, 3: False}


@pytest.mark.parametrize("n, m, grid", [(40, 60, 3), (300, 200, 0), (7, 0, 0), (150, 150, 2)])
def test_closest_pairs_are_the_global_greedy(n, m, grid):
    import numpy as np

    rng = np.random.default_rng(n)
    p, q = (np.round(rng.standard_normal((k, 3)) * 3) if grid else rng.standard_normal((k, 3)) for k in (n, m))
    pairs = sorted((float(np.sqrt(((a - b) ** 2).sum())), i, j) for i, a in enumerate(p) for j, b in enumerate(q))
    used, want = (set(), set()), []
    for d, i, j in pairs:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.append((i, j, d))
    got = spatial.closest_pairs(p, q, leaf=8)
    assert [x[:2] for x in got] == [x[:2] for x in want] and all(math.isclose(a[2], b[2]) for a, b in zip(got, want, strict=True))


def test_alignment_beyond_the_table_is_the_same(monkeypatch):
    import random

    rng = random.Random(4)
    for _ in range(60):
        a, b = (rng.choices("abc", k=rng.randint(1, 40)) for _ in range(2))
        whole = sequence.lcs(a, b, None)
        with monkeypatch.context() as m:
            m.setattr(sequence, "MOST_LCS_CELLS", 10)
            assert sequence.lcs(a, b, None) == whole


def test_a_texts_lines_are_made_once_for_each_use(spark):
    from palimpsest.operators.comparisons import compare_text

    rows = [("a", "x\r\ny\n", "x\nz"), ("b", "", ""), ("c", "\n" * 2001, "q")]
    pairs = spark.createDataFrame([(k, o.encode(), n.encode(), "a.txt", "a.txt", "text/plain") for k, o, n in rows], "key string, base_content binary, target_content binary, base_name string, target_name string, mime string")
    drawn = compare_text(pairs)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    # two sides, for the lines and for the note; 16 before
    assert plan.count("split(") <= 4
    got = {r.key: (bytes(r.data).decode().count("<text "), r.stage) for r in drawn.collect()}
    assert got["a"] == (2 + 2 + 2, None) and got["b"] == (0, None) and got["c"][0] == 2000 + 1 + 2001 and "2000" in got["c"][1]


def test_what_is_compared_is_written_once(spark):
    from palimpsest.operators.registry import Entry, Registry

    reg = Registry()
    reg.register(Entry("one", 1, lambda m: F.lit(True), pair=lambda a, b: [{"kind": "page", "idx": 0, "ext": "svg", "mime": "m", "mode": "vector", "data": b"x"}]))
    pairs = spark.createDataFrame([("k", b"a", b"b", "n", "n", "text/plain", "one")], "key string, base_content binary, target_content binary, base_name string, target_name string, mime string, plugin string")
    plan = reg.compare(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_run_results_compares_whole_texts(spark, tmp_path, monkeypatch):
    from palimpsest.plans import reading

    spark.createDataFrame([(1, "\n".join(map(str, range(2500)))), (2, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, manifests = {}, store.manifests

    def kept(results, children):
        seen.update({r.file_uid: (bytes(r.data).decode().count("<text "), r.note) for r in children.join(results.select("key", "note"), "key").collect()})
        return manifests(results, children)

    monkeypatch.setattr(store, "manifests", kept)
    assert reading.run_results(spark, str(tmp_path)).count() == 2
    # the older version's lines, the newer one's, and the one that came; before 2000 + 2000 and none
    assert seen == {"1": (2500 + 2501 + 1, None), "2": (1 + 2 + 1, None)}


def test_blocks_of_one_length_are_found_in_one_walk(monkeypatch):
    made = []

    class Counted(sequence.Stretches):
        def __init__(self, b):
            made.append(len(b))
            super().__init__(b)

    monkeypatch.setattr(sequence, "Stretches", Counted)
    a, b = [str(i) for i in range(600)], [str(i) if i % 3 else f"x{i}" for i in range(600)]
    assert sequence.matching_blocks(a, b) == [(i, i, 2) for i in range(1, 600, 3)]
    # an automaton of the rest for each block before: 60,000 lines and more
    assert sum(made) <= 3 * 600
