"""Rows whose id is null or stands in other rows are documents of their own: nothing unique is lost, one of each kind stays."""

import hashlib
import random

from pyspark.sql import functions as F

from palimpsest.llm import common, linedup, neardup, windows

DOCS = "doc_id long, text string, lang string"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    rng = random.Random(31)
    passage, twice = prose(rng, 70), prose(rng, 60)
    rows = [(7, passage), (7, passage), (7, prose(rng, 50)), (None, twice + " " + twice), (None, prose(rng, 90)), (None, passage + "\nown " + prose(rng, 30)), (None, None), (3, ""), (3, prose(rng, 40)), (3, None), (8, prose(rng, 80))]
    return [(d, t, "en") for d, t in rows]


def test_numbers_are_unique_and_follow_the_ids(spark):
    d = spark.createDataFrame(odd_rows(), DOCS).withColumn("k", F.lit("clash"))
    got = common.numbered(d).select("k", "row.doc_id", "row.text").orderBy("k").collect()
    assert len({r.k for r in got}) == len(got) == 11
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    plain = spark.createDataFrame([(5, "a", ""), (2, "b", "")], DOCS)
    assert {r.k for r in common.numbered(plain).collect()} == {2, 5}
    assert common.numbered(plain.limit(0)).count() == 0


def brute_digests(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append((len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_windows_with_null_and_repeated_ids(spark):
    d = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    order = [r.text for r in common.numbered(d).orderBy("k").select("row.text").collect()]
    got = sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in windows.removal_digests(d).collect())
    # among rows of one doc_id the order is the library's own; which bytes go in all follows from it
    assert got == sorted(brute_digests(order))
    left = [r.text for r in windows.removed(d).collect()]
    passage = odd_rows()[0][1]
    assert sum(passage in (t or "") for t in left) == 1
    for t in (odd_rows()[4][1], odd_rows()[10][1]):
        assert t in left


def test_radix_groups_are_the_equal_strings():
    import numpy as np

    rng = random.Random(3)
    data = np.frombuffer("".join(rng.choices("ab", k=4000)).encode() * 2, np.uint8)
    for length in (3, 9, 100):
        at = np.arange(len(data) - length + 1)
        which, group = windows.radix_groups(data, at, length)
        by, raw = {}, data.tobytes()
        for i in at.tolist():
            by.setdefault(raw[i : i + length], []).append(i)
        want = sorted(tuple(v) for v in by.values() if len(v) > 1)
        got = {}
        for i, g in zip(which.tolist(), group.tolist(), strict=True):
            got.setdefault(g, []).append(i)
        assert sorted(tuple(sorted(v)) for v in got.values()) == want


def test_lines_with_null_and_repeated_ids(spark):
    line, other = "this very line stands in several documents", "another line that nobody else has at all"
    rows = [(None, f"{line}\nfirst own line of this text, quite long"), (None, f"{other}\n{line}"), (5, f"{line}\nunique text of five, the first of two"), (5, f"unique text of five, the other one\n{line}"), (5, line)]
    d = spark.createDataFrame([(a, b, "en") for a, b in rows], DOCS)
    out = [r.text for r in linedup.deduplicated(d).collect()]
    assert sum(line in t for t in out) == 1
    for x in ("first own line", other, "the first of two", "the other one"):
        assert sum(x in t for t in out) == 1
    assert len(out) == 4
    classes = linedup.line_classes(d).collect()
    assert len(classes) == 9 and sum(not r.kept for r in classes) == 4


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    w = prose(rng, 60).split()
    v = [*w]
    v[30] = "changed"
    text, near, own = " ".join(w), " ".join(v), [prose(rng, 40) for _ in range(3)]
    rows = [(9, text), (9, text), (9, own[0]), (None, near), (None, own[1]), (None, own[1]), (4, own[2]), (None, None), (None, "")]
    d = spark.createDataFrame([(a, b, "en") for a, b in rows], DOCS)
    out = neardup.deduplicated(d)
    left = [r.text for r in out.collect()]
    assert out.columns == d.columns and len(left) == 6
    assert sum(t in (text, near) for t in left) == 1 and all(left.count(t) == 1 for t in [*own, None, ""])
    assert neardup.classes(d).count() == 9


def test_subsequence_scores_by_direct_enumeration():
    """A machine's position scores against every gapped subsequence of four characters, written out."""
    from itertools import combinations

    import numpy as np

    from palimpsest.llm import toxicity

    s = toxicity.Settings()
    weight = np.random.default_rng(3).standard_normal(32**4).astype(np.float32)
    m = toxicity.Machine(s, weight)
    rng = random.Random(6)
    for _ in range(20):
        code = np.array([rng.randrange(29) for _ in range(rng.randint(4, 25))], np.uint8)
        total = 0.0
        for at in combinations(range(len(code)), 4):
            span = at[3] - at[0]
            if span < s.max_span:
                a, b, c, d = (int(code[i]) for i in at)
                total += s.decay ** (span + 1) * float(weight[a << 15 | b << 10 | c << 5 | d])
        void = sum(float(x) for x in m.position_scores(np.concatenate([code, np.full(s.max_span, toxicity.VOID, np.uint8)]))[: len(code)])
        tail = sum(s.decay ** (b - a + 1) * float(weight[_code4(code, a, i, j, b)]) for a in range(len(code)) for i, j, b in _through_the_end(code, a, s.max_span))
        assert abs(void - total - tail) < 1e-2


def _through_the_end(code, a, most):
    from itertools import combinations

    return [(i, j, b) for i, j, b in combinations(range(a + 1, a + most), 3) if b >= len(code)]


def _code4(code, a, i, j, b):
    x = [int(code[k]) if k < len(code) else 31 for k in (a, i, j, b)]
    return x[0] << 15 | x[1] << 10 | x[2] << 5 | x[3]


def test_training_takes_long_texts_too(spark):
    from palimpsest.llm import toxicity

    rng = random.Random(2)
    s = toxicity.Settings(per_class=5, max_train_bytes=200, long_per_class=2, max_long_bytes=500)
    docs = spark.createDataFrame([(i, prose(rng, 300 if i % 2 else 20), "en") for i in range(40)] + [(None, "x", "en"), (90, None, "en")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (90, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, s).collect()
    assert sum(r.toxic for r in rows) == 2 and len(rows) == 7 and max(len(r.text) for r in rows) <= 500


def test_recurrent_network_by_scalars():
    """Document probabilities against a forward pass written out byte by byte."""
    import math

    import numpy as np

    from palimpsest.llm import langid

    net = langid.Network(3, 2, 5)
    steps = np.array([[104], [195], [169], [32]], np.uint8)
    got = np.asarray(net.gradients(steps, np.array([1]))[0])
    p, h = {k: v.astype(float) for k, v in net.p.items()}, net.h
    sig = lambda v: 1 / (1 + math.exp(-v))

    def run(d, seq):
        state, out = [0.0] * h, []
        for byte in seq:
            x, u = p["x" + d][:, byte], p["u" + d]
            r = [sig(x[i] + sum(u[i, k] * state[k] for k in range(h)) + bias(d, i)) for i in range(h)]
            z = [sig(x[h + i] + sum(u[h + i, k] * state[k] for k in range(h)) + bias(d, h + i)) for i in range(h)]
            inner = [sum(u[2 * h + i, k] * state[k] for k in range(h)) for i in range(h)]
            n = [math.tanh(x[2 * h + i] + r[i] * inner[i] + bias(d, 2 * h + i)) for i in range(h)]
            state = [n[i] + z[i] * (state[i] - n[i]) for i in range(h)]
            out.append(state)
        return out

    def bias(d, i):
        return float(p["b" + d][i]) if "b" + d in p else 0.0

    seq = steps[:, 0].tolist()
    fwd, bwd = run("f", seq), run("b", seq[::-1])[::-1]
    out = next(k for k in p if p[k].ndim == 2 and p[k].shape[0] == net.c or p[k].ndim == 2 and p[k].shape[1] == net.c)
    w = p[out] if p[out].shape[0] == net.c else p[out].T
    b = next((p[k] for k in p if p[k].ndim == 1 and len(p[k]) == net.c), np.zeros(net.c))
    probs = []
    for f, g in zip(fwd, bwd, strict=True):
        logits = [sum(w[c, k] * (f + g)[k] for k in range(2 * h)) + b[c] for c in range(net.c)]
        e = [math.exp(v - max(logits)) for v in logits]
        probs.append([v / sum(e) for v in e])
    per_position = -sum(math.log(q[1]) for q in probs) / len(probs)
    assert abs(float(got) - per_position) < 1e-3
