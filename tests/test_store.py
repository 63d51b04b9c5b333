"""The store: folders by key, what is read for a question, writing again, dropping, generations; and the numbers of runs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import registry, run, store
from palimpsest.streaming import events as ev
from tests_helpers import requests_of, two_versions

CHILD = "file_uid string, key string, kind string, idx int, ext string, mime string, mode string, data binary"
RESULT = "key string, file_uid string, base string, target string, plugin string, plugin_version int, status string, mode string, failure struct<reason:string,stage:string,tiers_attempted:array<string>>"


def key(i):
    return f"{i:02x}" + "0" * 30


def committed(spark, path, ids, data=b"x", again=False, children=True):
    s = store.ResultStore(spark, path)
    r = spark.createDataFrame([(key(i), f"f{i}", "v1", "v2", "t", 1, "ready", "vector", None) for i in ids], RESULT)
    c = spark.createDataFrame([(f"f{i}", key(i), "page", k, "svg", "m", "vector", bytearray(data)) for i in ids for k in range(2)], CHILD)
    s.commit(r, c if children else c.limit(0), again)
    return s


def bytes_of(s):
    return {(r.file_uid, r.idx): bytes(r.data) for r in s.children().collect()}


def read_paths(df):
    """Parquet files that a plan reads."""
    return {r.f for r in df.select(F.input_file_name().alias("f")).distinct().collect()}


def test_a_question_reads_its_own_folders(spark, tmp_path):
    s = committed(spark, str(tmp_path), range(0, 40))
    asked = spark.createDataFrame([(key(3),), (key(7),)], "key string")
    assert {r.file_uid for r in s.served(asked).collect()} == {"f3", "f7"} and s.served().count() == 40
    for table in ("children", "manifests"):
        there = {d for d in os.listdir(tmp_path / table / "0") if d.startswith("bucket=")}
        assert there == {f"bucket=k{i:02x}" for i in range(40)}
    rows = s._read("children", s.CHILDREN, s._buckets(asked))
    assert {p.split("bucket=")[1][:3] for p in read_paths(rows)} == {"k03", "k07"}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "k03" in plan
    # none of the keys: none of the folders
    assert s.served(asked.limit(0)).count() == 0


def test_names_that_are_there_are_not_written_again(spark, tmp_path):
    s = committed(spark, str(tmp_path), range(3), b"first")
    committed(spark, str(tmp_path), range(1, 5), b"second")
    assert {v for k, v in bytes_of(s).items() if k[0] in ("f0", "f1", "f2")} == {b"first"} and bytes_of(s)["f4", 1] == b"second"
    time.sleep(0.01)
    committed(spark, str(tmp_path), [1], b"third", again=True)
    got = bytes_of(s)
    assert got["f1", 0] == b"third" and got["f2", 0] == b"first" and len(got) == 10 and s.manifests().count() == 5


def test_children_of_a_crash_count_when_their_manifest_comes(spark, tmp_path):
    s = committed(spark, str(tmp_path), [1])
    lost = spark.createDataFrame([("f9", key(9), "page", k, "svg", "m", "vector", f"diff.{key(9)}.page.{k:03d}.svg", bytearray(b"lost")) for k in range(2)], s.CHILDREN)
    s._append(lost, "children")
    assert {r.file_uid for r in s.served().collect()} == {"f1"}
    committed(spark, str(tmp_path), [9], b"new")
    assert {r.file_uid for r in s.served().collect()} == {"f1", "f9"} and bytes_of(s)["f9", 0] == b"lost"


@pytest.mark.parametrize("few", [256, 1])
def test_dropped_files_and_keys(spark, tmp_path, few):
    s = committed(spark, str(tmp_path), range(6))
    s.FEW = few
    s.drop_files(spark.createDataFrame([("f1",), ("f2",)], "file_uid string"))
    s.drop_keys(spark.createDataFrame([("f3", key(3)), ("f0", key(5))], "file_uid string, key string"))
    assert {r.file_uid for r in s.served().collect()} == {"f0", "f4", "f5"} and s.names().count() == 9
    time.sleep(0.01)
    committed(spark, str(tmp_path), [1], b"back")
    assert bytes_of(s)["f1", 0] == b"back" and s.served().count() == 4


def test_generations(spark, tmp_path):
    s = committed(spark, str(tmp_path), range(4), b"a")
    time.sleep(0.01)
    committed(spark, str(tmp_path), [0], b"b", again=True)
    s.drop_files(spark.createDataFrame([("f3",)], "file_uid string"))
    before, names = bytes_of(s), s.names().count()
    # a compaction that ended before its name was written changes nothing
    s._append(s.children().limit(1).drop("bucket").withColumn("at", F.current_timestamp()), "children", 77)
    assert bytes_of(s) == before and s.generation() == 0
    s.compact()
    assert s.generation() > 77 and bytes_of(s) == before and s.names().count() == names and s.served().count() == 3
    folder = tmp_path / "children" / str(s.generation())
    assert spark.read.parquet(str(folder)).count() == 6 and not (tmp_path / "dropped" / str(s.generation())).exists()
    time.sleep(0.01)
    committed(spark, str(tmp_path), [3], b"c")
    s.drop_files(spark.createDataFrame([("f1",)], "file_uid string"))
    s.compact()
    assert {r.file_uid for r in s.served().collect()} == {"f0", "f2", "f3"} and bytes_of(s)["f3", 1] == b"c" and bytes_of(s)["f0", 1] == b"b"


def test_numbers_of_a_stream_equal_its_answers(spark, tmp_path):
    src, log = tmp_path / "in", str(tmp_path / "log")
    src.mkdir()
    v = two_versions(spark, ["a", "b", "c"])
    s, reg = store.ResultStore(spark, str(tmp_path / "out")), registry.default_registry(text=True)
    progress = ev.Progress()
    spark.streams.addListener(progress)
    event = lambda i, uid: {"type": "file.updated", "event_id": i, "file_uid": uid, "version": "v2"}
    assert ev.outcomes(spark, log).count() == 0
    try:
        for k, events in enumerate(([event("1", "a"), event("2", "nobody")], [event("3", "a"), event("4", "b")])):
            (src / f"{k}.json").write_text("\n".join(map(json.dumps, events)))
            work = ev.consumer(lambda: v, s, reg, str(tmp_path / "aside"), log)
            q = ev.start(ev.watched(ev.read_events(spark, str(src))), work, str(tmp_path / "c"))
            assert q.awaitTermination(300)
            # a batch that comes again after a restart is answered again and counted once
            again = spark.createDataFrame([(e["file_uid"], "compare", "v2", None) for e in events], "file_uid string, action string, version string, ts timestamp")
            if k:
                work(again, k)
        for _ in range(100):
            if progress.rows and not progress.running:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    answered = ev.outcomes(spark, log)
    assert {r.outcome: r.n for r in ev.outcome_counts(answered).collect()} == {"computed": 1, "cached": 2, "unsupported": 0, "no_predecessor": 0, "too_large": 0, "failed": 0, "error": 1}
    assert {r.file_uid: r.outcome for r in ev.last_outcomes(answered).collect()} == {"a": "cached", "b": "cached", "nobody": "error"}
    text = ev.metrics_text([*ev.outcome_samples(answered, ev.retried(spark, str(tmp_path / "aside"), s)), *progress.samples()])
    assert 'diff_outcomes_total{outcome="cached"} 2' in text and "diff_pending 1" in text and "streams_active 0" in text
    assert sum(progress.rows.values()) == 4 and sum(progress.batches.values()) == 2


def test_forced_results_are_never_missing(spark, tmp_path):
    s, reg, v = store.ResultStore(spark, str(tmp_path)), registry.default_registry(text=True), two_versions(spark, ["a"])
    run.run(requests_of(spark, ["a"]), v, s, reg)
    gone = []
    s.drop = lambda doomed: gone.append(doomed.count())
    assert run.run(requests_of(spark, ["a"]), v, s, reg, force=True).first().outcome == "computed"
    assert not any(gone) and s.served().count() == 1 and s.children().count() == 1
