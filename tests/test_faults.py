"""What goes wrong and what is forgotten: failing pairs, voids and bounded memories in streams against their batch twins, alignments at size."""

import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import mime
from palimpsest.operators import access, registry, run, sequence, spatial, store
from palimpsest.operators.comparisons import child
from palimpsest.streaming import events as ev
from palimpsest.streaming import state

VERSIONS = "file_uid string, version string, ord int, name string, mime string, content binary"


def texts(spark, n):
    return spark.createDataFrame([(f"f{i:04d}", f"v{2 - k}", k, "t.txt", "text/plain", bytearray(b"%d" % (i + k))) for i in range(n) for k in range(2)], VERSIONS)


def claims(m):
    return F.startswith(mime.bare(m), F.lit("text/plain"))


def outcomes(spark, tmp_path, entry, n):
    reg = registry.Registry()
    reg.register(entry)
    s = store.ResultStore(spark, str(tmp_path))
    asked = spark.createDataFrame([(f"f{i:04d}", "", "") for i in range(n)], "file_uid string, target string, base string")
    return {r.file_uid: (r.outcome, r.detail) for r in run.run(asked, texts(spark, n), s, reg).collect()}, s


def test_one_bad_pair_of_a_thousand(spark, tmp_path):
    def compare(base, target):
        if target["content"] == b"500":
            raise ValueError("bad pair")
        return [{"kind": "page", "idx": 0, "ext": "svg", "mime": "m", "mode": "vector", "data": target["content"]}]

    got, s = outcomes(spark, tmp_path, registry.Entry("t", 1, claims, pair=compare), 1000)
    bad = {u: d for u, (o, d) in got.items() if o == "failed"}
    assert bad == {"f0500": "ValueError: bad pair"} and sum(o == "computed" for o, _ in got.values()) == 999
    m = s.served().where("status = 'failed'").collect()
    assert len(m) == 1 and m[0].failure.stage == "plugin" and not m[0].expected


@pytest.mark.parametrize(("made", "reason"), [(None, "TypeError: comparison returned NoneType"), ([1], "TypeError: comparison returned list"), ([{"kind": "page", "idx": "x"}], "Arrow")])
def test_what_is_no_list_of_children_fails(spark, made, reason):
    pairs = spark.createDataFrame([("k", bytearray(b"a"), None, "n", "n", "m")], "key string, base_content binary, target_content binary, base_name string, target_name string, mime string")
    rows = registry.pairwise(lambda b, t: made, pairs).collect()
    assert len(rows) == 1 and rows[0].error.startswith(reason) and rows[0].stage == "plugin"


def test_a_failing_plan_is_halved(spark, tmp_path):
    def compare(pairs):
        n = F.decode("target_content", "UTF-8")
        data = F.when(n.isin("7", "11"), F.raise_error(F.concat(F.lit("no "), n)).cast("string")).otherwise(n)
        return pairs.select(*child("page", F.lit(0), "svg", "m", F.lit("vector"), F.encode(data, "UTF-8")))

    got, _ = outcomes(spark, tmp_path, registry.Entry("t", 1, claims, compare), 24)
    assert {u for u, (o, _) in got.items() if o == "failed"} == {"f0007", "f0011"} and "no 11" in got["f0011"][1]

    def nonsense(pairs):
        return pairs.select("missing")

    got, _ = outcomes(spark, tmp_path / "x", registry.Entry("t", 1, claims, nonsense), 3)
    assert {o for o, _ in got.values()} == {"failed"} and all("missing" in d for _, d in got.values())


@pytest.mark.parametrize("told", [True, False])
def test_attempts_grow_with_slices_and_failing_pairs(spark, monkeypatch, told):
    monkeypatch.setattr(registry, "SLICE", 16)
    monkeypatch.setattr(registry, "MOST_BRANCHES", 8)
    made = []

    def compare(pairs):
        made.append(1)
        data = F.when(F.col("n") % 25 == 3, F.raise_error(F.concat(F.lit("no "), F.col("key") if told else F.lit("more")))).otherwise("")
        return pairs.select(*child("page", F.lit(0), "svg", "m", F.lit("vector"), F.encode(data.cast("string"), "UTF-8")))

    pairs = spark.range(200).select(F.format_string("key-%05d", "id").alias("key"), F.col("id").alias("n"))
    rows = registry.isolated(compare, pairs).collect()
    assert sorted(r.key for r in rows) == [f"key-{i:05d}" for i in range(200)]
    bad = {r.key: r.error for r in rows if r.error}
    assert set(bad) == {f"key-{i:05d}" for i in range(3, 200, 25)} and all(e.startswith("SparkRuntimeException: [USER_RAISED_EXCEPTION] no ") and (not told or k in e) for k, e in bad.items())
    # halves of everything took more than 40
    assert not told or len(made) <= 1 + 13 + 2 * 8


def test_keys_that_failed_are_left_out_by_name(spark, monkeypatch):
    monkeypatch.setattr(registry, "SLICE", 64)
    named = []

    def compare(pairs):
        named.append(pairs._jdf.queryExecution().analyzed().toString().count("key-0"))
        data = F.when(F.col("n") % 25 == 3, F.raise_error(F.concat(F.lit("no "), F.col("key")))).otherwise("")
        return pairs.select(*child("page", F.lit(0), "svg", "m", F.lit("vector"), F.encode(data.cast("string"), "UTF-8")))

    # a key of several rows, and slices without any
    pairs = spark.range(120).select(F.format_string("key-%05d", "id").alias("key"), F.col("id").alias("n"))
    rows = registry.isolated(compare, pairs.union(pairs.where("n = 5 or n = 28"))).collect()
    assert {r.key for r in rows if r.error} == {f"key-{i:05d}" for i in range(3, 120, 25)} and sum(r.error is None for r in rows) == 116
    # all the others of a slice were named before, some dozens
    assert max(named) <= 5
    same = spark.range(300).select(F.lit("key-0").alias("key"), F.col("id").alias("n"))
    assert [(r.key, r.error is None) for r in registry.isolated(compare, same).collect()] == [("key-0", False)]


def test_lines_that_are_not_compared_are_told(spark, tmp_path):
    text = lambda n, last: "\n".join([*map(str, range(n)), last]).encode()
    rows = [(u, f"v{2 - k}", k, "t.txt", "text/plain", bytearray(text(n, str(k)))) for u, n in (("long", 2400), ("short", 3)) for k in range(2)]
    s = store.ResultStore(spark, str(tmp_path))
    asked = spark.createDataFrame([(u, "", "") for u in ("long", "short")], "file_uid string, target string, base string")
    got = {r.file_uid: (r.outcome, r.detail) for r in run.run(asked, spark.createDataFrame(rows, VERSIONS), s, registry.default_registry(text=True)).collect()}
    assert got == {"long": ("computed", "only the first 2000 lines of each version are compared"), "short": ("computed", "")}


def test_python_kernels_of_a_plan_name_their_error(spark):
    pairs = spark.createDataFrame([(f"k{i}", i) for i in range(9)], "key string, n int")

    def kernel(frames):
        for f in frames:
            if (f.n == 4).any():
                raise KeyError("four")
            yield f[["key"]]

    plan = lambda p: p.mapInPandas(kernel, "key string").select(*child("page", F.lit(0), "svg", "m", F.lit("vector"), F.lit(b"")))
    rows = registry.isolated(plan, pairs.repartition(1)).collect()
    assert [(r.key, r.error) for r in rows if r.error] == [("k4", "KeyError: 'four'")] and len(rows) == 9


# Streams and their twins --------------------------------------------------------


def streamed(spark, tmp_path, make, batches, schema):
    src = tmp_path / "in"
    src.mkdir()
    name = f"out_{tmp_path.name.replace('-', '_')}"
    for k, rows in enumerate(batches):
        (src / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        q = make(spark.readStream.schema(schema).json(str(src))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).queryName(name).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_a_void_reaches_its_member_only(spark, tmp_path):
    row = lambda kind, at, user=None, file=None, allowed=None: {"tenant": "t", "user": user, "file_uid": file, "at": float(at), "kind": kind, "allowed": allowed}
    checks = [row("check", 10, u, f, True) for u in "abc" for f in ("f", "g")]
    asks = lambda at: [row("ask", at, u, f) for u in "abc" for f in ("f", "g")]
    batches = [checks, [row("void", 20, user="a"), *asks(21)], [row("void", 30, file="g"), *asks(31)], [row("void", 40), *asks(41)], [row("check", 50, "a", "f", False), row("check", 50, "b", "f", None), *asks(51), *asks(400)]]
    out = streamed(spark, tmp_path, lambda s: state.decision_stream(s, 300, buckets=4), batches, state.REQUEST)
    got = {(r.at, r.user, r.file_uid): r.allowed for r in out.where("kind = 'ask'").collect()}
    known = lambda at: {(u, f) for u in "abc" for f in ("f", "g") if got[at, u, f] is not None}
    assert known(21) == {("b", "f"), ("b", "g"), ("c", "f"), ("c", "g")} and known(31) == {("b", "f"), ("c", "f")} and known(41) == set()
    assert known(51) == {("a", "f")} and got[51.0, "a", "f"] is False and known(400) == set()
    assert out.where("kind = 'check' and user = 'b' and at = 50").first().allowed is False


def test_decisions_equal_their_batch_twin(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        at, kind = float(i // 2), rng.choice(["check", "ask", "ask", "void"])
        user, file = rng.choice("abcd"), rng.choice("fgh")
        if kind == "void" and rng.random() < 0.8:
            kind = "ask"
        if kind == "void":
            which = rng.randrange(8)
            user, file = (user, None) if which < 4 else (None, file) if which < 7 else (None, None)
        rows.append({"tenant": rng.choice(["t", "s"]), "user": user, "file_uid": file, "at": at, "kind": kind, "allowed": rng.choice([True, False, None]) if kind == "check" else None, "n": i})
    # within one moment the stream decides, voids and then asks: so does the twin if no moment parts a batch
    batches = [[r for r in rows if int(r["at"]) // 120 == b] for b in range(5)]
    out = streamed(spark, tmp_path, lambda s: state.decision_stream(s.drop("n"), 60, buckets=3), batches, state.REQUEST + ", n long")
    got = sorted((r.tenant, r.user, r.file_uid, r.at, str(r.allowed)) for r in out.where("kind = 'ask'").collect())
    d = spark.createDataFrame(rows, state.REQUEST + ", n long").withColumn("at", F.timestamp_seconds("at"))
    # of two checks of one moment the later row counts
    made = d.where("kind = 'check'").groupBy("tenant", "user", "file_uid", "at").agg(F.max_by("allowed", F.when(F.col("allowed").isNotNull(), F.col("n"))).alias("allowed")).withColumnRenamed("at", "decided_at")
    kind = F.when(F.col("user").isNotNull(), "role.assigned").when(F.col("file_uid").isNotNull(), "acl.changed").otherwise("role.deleted")
    events = d.where("kind = 'void'").select(kind.alias("type"), "tenant", "file_uid", F.col("user").alias("member"), "at")
    answered = access.answers(d.where("kind = 'ask'").select("tenant", "user", "file_uid", "at", F.col("n").alias("request")), made, events, 60)
    want = sorted((r.tenant, r.user, r.file_uid, r.at.timestamp(), str(r.allowed)) for r in answered.collect())
    assert got == want and {"True", "False", "None"} == {x[4] for x in got}


def test_void_rows_name_their_target(spark):
    e = spark.createDataFrame([("acl.changed", "", "f", "m", 1.0), ("role.assigned", "t", "f", "m", 2.0), ("role.member_removed", "t", "f", "", 3.0), ("other", "t", "f", "m", 4.0)], "type string, tenant string, file_uid string, member string, at double")
    got = [(r.tenant, r.user, r.file_uid, r.at) for r in state.void_rows(e).orderBy("at").collect()]
    assert got == [("default", None, "f", 1.0), ("t", "m", None, 2.0), ("t", None, None, 3.0)]


@pytest.mark.parametrize("shards", [1, 3])
def test_the_oldest_id_is_forgotten(spark, tmp_path, shards):
    rng = random.Random(shards)
    rows = [{"event_id": rng.choice(["", *map(str, range(60))]), "n": i} for i in range(600)]
    schema = "event_id string, n long"
    out = streamed(spark, tmp_path, lambda s: state.seen_within(s, 20, shards, ("n",)), [rows[i : i + 150] for i in range(0, 600, 150)], schema)
    twin = ev.first_within(spark.createDataFrame(rows, schema), ["n"], 20, shards)
    got = sorted(r.n for r in out.collect())
    assert got == sorted(r.n for r in twin.collect()) and 60 < len(got) < 600


def test_id_4097_evicts_the_first(spark):
    ids = [*map(str, range(4097)), "0", "4096", "2"]
    d = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "event_id string, n long")
    # the first id comes again after 4,096 others and puts the second out; the last but two is still known, the third isn't
    assert {r.n for r in ev.first_within(d, ["n"]).where("n > 4096").collect()} == {4097}
    assert {r.n for r in ev.first_within(d, ["n"], 4095).where("n > 4096").collect()} == {4097, 4099}


# Alignments -----------------------------------------------------------------------


def table_walk(a, b):
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_rows_of_bits_give_the_tables_pairs():
    rng = random.Random(6)
    for k in range(400):
        letters = "abcdefgh"[: rng.randint(1, 8)]
        a, b = (rng.choices(letters, k=rng.randint(0, 70)) for _ in range(2))
        assert sequence.lcs(a, b, None)[0] == table_walk(a, b), k
        assert sequence.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks()][:-1]
    assert sequence.lcs(["a"] * 30, ["a"] * 30, 800) == ([], True)


def test_long_sides_with_few_changes():
    rng = random.Random(7)
    a = [f"line {rng.randint(0, 9000)}" for _ in range(12_000)]
    b = list(a)
    for _ in range(60):
        k = rng.randrange(len(b))
        b[k : k + 1] = [] if rng.random() < 0.5 else ["new", "x"]
    pairs, _ = sequence.lcs(a, b, None)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) >= len(a) - 60 and pairs == sorted(pairs)


def test_pages_of_equal_dots():
    rng = np.random.default_rng(0)
    for _ in range(60):
        p, q = (np.round(rng.standard_normal((k, 2)) * rng.choice([1, 3, 40])) for k in rng.integers(0, 60, 2))
        free, want = np.ones(len(q), bool), []
        for i in range(len(p) if len(q) else 0):
            d = np.where(free, np.hypot(*(q - p[i]).T), np.inf)
            if d.min() < 72:
                want.append((i, int(d.argmin())))
                free[want[-1][1]] = False
        assert spatial.in_turn(p, q, 72.0) == want
    n = 20_000
    assert spatial.in_turn(np.zeros((n, 2)), np.full((n, 2), 3.0), 72.0) == [(i, i) for i in range(n)]


@pytest.mark.parametrize("grid", [0, 1, 3])
def test_a_hot_shape_by_joins_equals_the_kernel(spark, grid):
    rng = np.random.default_rng(grid)

    def side(n):
        p = rng.standard_normal((n, 3)) * (4 if grid else 1)
        p = np.round(p / grid) * grid if grid else p
        rows = [("m", "s" if i % 7 else "rare", i, tuple(map(float, x))) for i, x in enumerate(p)]
        return spark.createDataFrame(rows, "model string, shape string, idx int, center struct<x:double,y:double,z:double>")

    old, new = side(260), side(220)
    rows = lambda many: sorted((r.old_idx, r.new_idx, round(r.distance, 9)) for r in spatial.nearest_first(old, new, ["model"], many).collect())
    got = rows(100)
    assert got == rows(10**9) and len({i for i, *_ in got}) == len(got) > 200


def test_mutual_pairs_find_most_of_a_hot_shape(spark):
    rng = np.random.default_rng(5)
    p = rng.random((400, 3)) * 50
    at = "m string, idx int, x double, y double, z double"
    old = spark.createDataFrame([("m", i, *map(float, x)) for i, x in enumerate(p)], at)
    new = spark.createDataFrame([("m", i, *map(float, x + 0.05)) for i, x in enumerate(p)], at)
    edges = spatial.near_candidates(old, new, ["m"]).checkpoint()
    assert edges.count() < 60 * 400
    found = [r for part in spatial.mutual_pairs(edges, ["m"]) for r in part.collect()]
    assert len(found) > 360 and all(r.old_idx == r.new_idx for r in found)


def test_contents_in_any_order_are_equal(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (4, None)], "p int, s string")
    got = {r.p: r.m for r in d.groupBy("p").agg(sequence.multiset("s").alias("m")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == "0|0|0"
