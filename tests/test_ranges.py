"""Data sources by byte ranges: what is read of large files, and positions of independent consumers of a log."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import registry, run, store
from palimpsest.sources import files, ranges
from palimpsest.streaming import events as ev
from tests_helpers import requests_of


def test_heads_of_large_files(spark, tmp_path, monkeypatch):
    for uid, size in (("small", 3), ("large", 30 << 20)):
        for v in ("v9", "v10"):
            d = tmp_path / uid / v
            d.mkdir(parents=True)
            with open(d / "a.pdf", "wb") as f:
                f.write(b"%PDF-1.4")
                f.truncate(size)  # a hole: nothing of it is written
    (tmp_path / "_hidden").write_text("x")
    h = ranges.read_heads(spark, str(tmp_path))
    got = {(r.file_uid, r.version): (r.ord, r.n) for r in h.select("file_uid", "version", "ord", F.length("content").alias("n")).collect()}
    assert got == {("small", "v10"): (0, 3), ("small", "v9"): (1, 3), ("large", "v10"): (0, 8192), ("large", "v9"): (1, 8192)}
    whole = files.read_versions(spark, str(tmp_path)).select("file_uid", "version", "ord")
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in h.select("file_uid", "version", "ord").collect()}
    # a reader asks for no more than the first bytes
    read = []
    reader = ranges.HeadReader({"path": str(tmp_path), "filesPerPartition": "1"})

    class File:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read_at(self, n, at):
            read.append((n, at))
            return b"x" * n

    monkeypatch.setattr(ranges, "opened", lambda p: (type("S", (), {"open_input_file": staticmethod(lambda path: File())}), p))
    assert len([*reader.read(ranges.Files([("a", 5 << 30, None), ("b", 7, None)]))]) == 2 and read == [(8192, 0), (7, 0)]


def test_types_are_told_from_heads(spark, tmp_path):
    for v, text in (("v1", "a\n"), ("v2", "b\n")):
        d = tmp_path / "in" / "doc" / v
        d.mkdir(parents=True)
        (d / "t.txt").write_text(text)
    v, heads = files.read_versions(spark, str(tmp_path / "in")), ranges.read_heads(spark, str(tmp_path / "in"))
    s = store.ResultStore(spark, str(tmp_path / "out"))
    report = run.run(requests_of(spark, ["doc"]), v, s, registry.default_registry(text=True), heads=heads).first()
    assert (report.outcome, report.base, report.target) == ("computed", "v1", "v2") and s.served().count() == 1


def test_ranges_part_a_log_between_lines(tmp_path):
    rng = random.Random(2)
    lines = ["é" * rng.randint(0, 40) + str(i) for i in range(300)]
    (tmp_path / "s").write_bytes("".join(x + "\n" for x in lines).encode() + b"unfinished")
    for size in (1, 7, 50, 1 << 20):
        r = ranges.LogReader({"path": str(tmp_path), "bytesPerPartition": str(size)})
        r.STEP = 16
        end = r.latestOffset()
        assert end == {"s": len("".join(x + "\n" for x in lines).encode())}
        rows = [x for p in r.partitions({}, end) for x in r.read(p)]
        assert [x[2] for x in rows] == lines and len({x[1] for x in rows}) == 300
        later = [x for p in r.partitions({"s": rows[200][1]}, end) for x in r.read(p)]
        assert [x[2] for x in later] == lines[200:]
    assert ranges.LogReader({"path": str(tmp_path / "none")}).latestOffset() == {}


def test_consumers_keep_their_own_positions(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def put(segment, *lines, end="\n"):
        with open(log / segment, "a") as f:
            f.write("\n".join(lines) + end)

    def taken(name, start="earliest", fail=False):
        got = []

        def act(batch, _):
            if fail:
                raise RuntimeError("before its work was done")
            got.extend(r.payload for r in batch.collect())

        q = ev.start(ranges.read_log(spark, str(log), start), act, str(tmp_path / name))
        try:
            assert q.awaitTermination(120)
        except Exception as e:  # noqa: BLE001
            assert fail and "before its work" in str(e)
        return sorted(got)

    put("0", "a", "b")
    put("1", "c", "half", end="")
    assert taken("first") == ["a", "b", "c"] and taken("tail", "latest") == []
    put("1", " a line")
    put("2", "d")
    # what was read but not committed is read again; another consumer isn't touched by that
    assert taken("first", fail=True) == [] and taken("tail", "latest") == ["d", "half a line"]
    put("0", "e")
    # the batch that failed comes again as it was, then what came since
    assert taken("first") + taken("first") == ["d", "half a line", "e"] and taken("first") == [] and taken("tail", "latest") == ["e"]


def test_a_log_feeds_the_consumer(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "0").write_text('{"type":"acl.changed","file_uid":"f"}\n{broken\n{"type":"file.updated","event_id":"1","file_uid":"f"}\n')
    stream = ev.routed(ev.decoded(ranges.read_log(spark, str(tmp_path / "log")).select("payload")))
    q = stream.writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.action for r in spark.sql("SELECT * FROM log_rows").collect()) == ["compare", "ignore", "invalidate"]
