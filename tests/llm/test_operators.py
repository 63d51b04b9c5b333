"""Each operator against brute force, an exact round trip or held-out accuracy, and its defined edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, chroma, common, langid, linedup, neardup, packing, queries, topk, toxicity, windows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clashing(df):
    """Extra columns whose names the operators use inside."""
    return df.withColumns({"k": F.lit("x"), "ranges": F.lit(1), "_k": F.lit(2.0), "bucket": F.lit(b"b"), "gone": F.lit("g")})


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls, empty and long texts, copies, near copies, shared passages and lines."""
    rng = random.Random(5)
    long, passage = prose(rng, 9000), prose(rng, 60)
    out = [None, "", " \n ", "one two", "one two", long]
    for i in range(12):
        out.append(prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30))
    for t in out[6:9]:
        w = t.split(" ")
        w[20] = "changed"
        out += [t, " ".join(w), t.replace("a", "ab", 1)]
    return out + ["é" * 300, "aaaa" * 80, "é" * 150 + "x"]


# --- common -----------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(2001, 2100)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            r, s = root(a), root(b)
            up[max(r, s)] = min(r, s)
    got = {r.node: r.root for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_rolling_hashes_depend_on_content_only():
    r = common.Rolling(1)
    data = np.frombuffer(b"abcabc" * 50, np.uint8)
    p = r.prefix(data)
    assert r.of(p, [0, 3, 0], [3, 6, 4])[0] == r.of(p, [0, 3, 0], [3, 6, 4])[1] != r.of(p, [0], [4])[0]
    assert (r.windows(p, 7) == r.of(p, np.arange(294), np.arange(294) + 7)).all()


# --- 1 chroma ---------------------------------------------------------------


def test_chroma_finds_a_shifted_noisy_excerpt(spark):
    s, rng = chroma.Settings(), np.random.default_rng(2)
    sound = chroma.played(rng.standard_normal((12, 64)).astype(np.float32) * 0.4, s, 8.0)
    cut = sound[3][s.hop * 5 : s.hop * 5 + 5 * s.rate] + 0.002 * rng.standard_normal(5 * s.rate).astype(np.float32)
    rows = [(i, bytearray(chroma.encode_wave(x / 6, s.rate)), "x") for i, x in enumerate([*sound, cut])]
    rows += [(50, None, "x"), (51, bytearray(b"junk"), "x"), (52, bytearray(chroma.encode_wave(np.zeros(30000), s.rate)), "x"), (53, bytearray(b""), "x")]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, pcm binary, fp string"), "pcm", s)
    assert {r.id for r in prints.collect() if not r.fp} == {50, 51, 52, 53}
    m = [(r.query_id, r.match_id, r.offset) for r in chroma.match(prints, prints.where("id = 12"), s).collect()]
    assert (12, 3, 5) in m


def test_chroma_recall_against_every_offset(spark):
    s, rng = chroma.Settings(), np.random.default_rng(4)
    base = rng.standard_normal((25, 64)) * 0.3
    vec = np.concatenate([base + rng.standard_normal(base.shape) * e for e in (0, 0.003, 0.01)]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, v array<float>")
    prints = chroma.fingerprints(df, "v", s, chroma.decode_vectors(s))
    fp = {r.id: np.frombuffer(r.fp, "<u4") for r in prints.collect()}
    want = set()
    for a in range(0, 25):
        for b in fp:
            if b != a:
                for d in range(-len(fp[a]) + s.least_overlap, len(fp[b]) - s.least_overlap + 1):
                    x = [(fp[a][i], fp[b][i + d]) for i in range(len(fp[a])) if 0 <= i + d < len(fp[b])]
                    if sum(bin(int(p ^ q)).count("1") for p, q in x) / (32 * len(x)) <= s.most_errors:
                        want.add((a, b))
    rows = chroma.match(prints, prints.where("id < 25"), s).collect()
    got = {(r.query_id, r.match_id) for r in rows}
    assert want and got <= want and len(got & want) / len(want) >= 0.9
    assert chroma.match(prints.limit(0), prints, s).count() == 0
    # one row for each query, with the number of its matches and the best of them
    looked = {r.query_id: r for r in chroma.lookups(prints, prints.where("id < 25"), s).collect()}
    assert set(looked) == {a for a in range(25) if len(fp[a])}
    for a, r in looked.items():
        mine = sorted((x.bit_errors, x.match_id) for x in rows if x.query_id == a)
        assert r.n_links == len(mine) and (r.best_id == mine[0][1] if mine else r.best_id is None)


def test_chroma_recall_on_the_given_table(spark):
    """The index of op1 against every offset of every recording, over the smallest table."""
    s = chroma.Settings()
    rows = common.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    prints = chroma.fingerprints(rows, "embedding", s, chroma.decode_vectors(s)).checkpoint()
    fp = {r.id: np.frombuffer(r.fp, "<u4") for r in prints.collect() if r.fp}
    ids, all_of, want = list(fp), np.stack(list(fp.values())), set()
    m = all_of.shape[1]
    for a in ids:
        for d in range(s.least_overlap - m, m - s.least_overlap + 1):
            i, j = max(0, -d), min(m, m - d)
            errors = np.bitwise_count(all_of[:, i + d : j + d] ^ fp[a][i:j]).sum(1) / (32 * (j - i))
            want |= {(a, ids[c]) for c in np.flatnonzero(errors <= s.most_errors) if ids[c] != a}
    got = {(r.query_id, r.match_id) for r in chroma.match(prints, prints, s).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_chroma_rows_without_an_id(spark):
    s, rng = chroma.Settings(), np.random.default_rng(6)
    v = (rng.standard_normal(64) * 0.3).astype(np.float32).tolist()
    df = spark.createDataFrame([(None, v), (100, v), (100, v)], "id long, v array<float>")
    prints = chroma.fingerprints(df, "v", s, chroma.decode_vectors(s)).checkpoint()
    got = chroma.lookups(prints, prints.where("id % 100 = 0"), s).collect()
    assert [(r.query_id, r.n_links, r.offset, r.bit_errors) for r in got] == [(100, 2, 0, 0.0)] * 2


# --- 2 lines ----------------------------------------------------------------


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_edit_distance(most):
    rng, pairs = random.Random(most), []
    for _ in range(1500):
        a = bytes(rng.choices(b"abc", k=rng.randint(0, 25)))
        b = bytearray(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = bytes(rng.choices(b"abc", k=rng.randint(0, 1)))
        pairs.append((a, bytes(b)))
    got = linedup.edit_distances([a for a, _ in pairs], [b for _, b in pairs], most)
    assert got.tolist() == [min(edit(a, b), most + 1) for a, b in pairs]


def brute_lines(texts, s):
    occ = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").encode().split(b"\n")) if t is not None and len(x) >= s.least and x.strip()]
    lines = sorted({x for *_, x in occ})
    up, links = {x: x for x in lines}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= s.edits and edit(a, b) <= s.edits:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    head, copies = {}, Counter(x for *_, x in occ)
    for d, k, x in sorted(occ):
        head.setdefault(root(x), (d, k))
    return {(d, k): (*head[root(x)], links[x], copies[x], head[root(x)] == (d, k)) for d, k, x in occ}


@pytest.mark.parametrize("block", [256, 4])
def test_line_classes_against_brute_force(spark, block):
    rng = random.Random(9)
    base = ["the quick brown fox jumps over the dog", "an altogether different line of text here", "short"]
    texts = [None, "", "\n\n", "x" * 24]
    for _ in range(30):
        lines = []
        for _ in range(3):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = rng.choices("abé", k=rng.randint(0, 1))
            lines.append("".join(x))
        texts.append("\n".join(lines))
    s = linedup.Settings(block=block)
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.n_links, r.n_copies, r.kept) for r in linedup.line_classes(clashing(docs_of(spark, texts)), s).collect()}
    assert got == brute_lines(texts, s)


def test_line_removal_keeps_columns_and_clean_documents(spark):
    line = "this very line stands in several documents"
    d = docs_of(spark, [line, f"own start\n{line}\nown end", "nothing shared here at all, really", None, "", line + "."])
    out = {r.doc_id: r.text for r in linedup.deduplicated(clashing(d)).collect()}
    assert out == {0: line, 1: "own start\nown end", 2: "nothing shared here at all, really", 3: None, 4: ""}
    assert linedup.deduplicated(clashing(d)).columns == clashing(d).columns
    assert linedup.line_classes(d.limit(0)).count() == 0


# --- 3 windows --------------------------------------------------------------


def brute_windows(texts, length):
    seen, out = set(), {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_windows_against_brute_force(spark, corpus, monkeypatch):
    want = brute_windows(corpus, 100)
    d = clashing(docs_of(spark, corpus)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in windows.removal_digests(d).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 1000
    assert windows.removal_digests(d.limit(0)).count() == 0


def test_very_long_texts_go_in_blocks():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    s, old = windows.Settings(), windows.BLOCK
    try:
        windows.BLOCK = 1000
        covered = Counter()
        for part, off, _, base in windows.blocks(data, np.array([0, len(data)]), s.length - 1):
            _, start, n, _, _ = windows.sampled(part, off, s)
            for i, m in zip(start + base, n, strict=True):
                covered.update(range(i, i + m))
    finally:
        windows.BLOCK = old
    assert covered == Counter(range(9000 - 99))


def test_large_groups_are_settled_by_window(spark, corpus, monkeypatch):
    monkeypatch.setattr(windows, "MANY", 1)
    want = brute_windows(corpus, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in windows.removal_digests(docs_of(spark, corpus)).collect()}
    assert got == want


def test_windows_cut_whole_characters(spark):
    t = "é" * 60
    out = {r.doc_id: r.text for r in windows.removed(clashing(docs_of(spark, [t, "abc" + t + "def", None, ""]))).collect()}
    assert out[0] is not None and out[1].startswith("abc") and out[1].endswith("def") and "�" not in "".join(x or "" for x in out.values()) and out[2] is None


# --- 4 top-k ----------------------------------------------------------------


@pytest.mark.parametrize("direct", [4, 256])
def test_top_k_is_exact(spark, direct):
    rng = np.random.default_rng(3)
    v = np.floor(rng.standard_normal((400, 16)) * 6).astype(int)
    v[50:90] = v[3]
    v[200:] //= 3
    rows = [(i, [*map(float, x)]) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    s = topk.Settings(k=7, block=64, query_block=16, direct=direct)
    got = best_of(topk.search(d, d.where("id % 20 = 0"), s))
    for q in range(0, 400, 20):
        want = sorted(((int(v[q] @ v[i]), -i) for i in range(400) if i != q), reverse=True)[:7]
        assert got[q] == [(-i, sc) for sc, i in want]
    few = spark.createDataFrame(rows[:3], "id long, v array<double>")
    assert topk.search(few, few.where("id = 0"), s).count() == 2 and topk.search(few.limit(0), few, s).count() == 0


def best_of(found):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    return got


@pytest.mark.parametrize("large", [1e6, 1e9, 1e30])
def test_top_k_of_large_components_and_mixed_lengths(spark, large):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        x = rng.standard_normal(rng.choice([4, 12, 12, 12, 30]))
        if i % 7 == 0:
            x[rng.integers(len(x))] *= large
        rows.append((i, x.tolist()))
    rows += [(200, []), (201, [0.0] * 12), (40, rows[3][1]), (40, rows[3][1])]
    d = spark.createDataFrame(rows, "id long, e array<double>").select("id", topk.quantised("e", 64).alias("v"))
    import math

    whole = [(i, [math.floor(64 * x) for x in e]) for i, e in rows]
    s, top = topk.Settings(k=9, block=50, query_block=16), 2**63 - 1
    got = best_of(topk.search(d, d.where("id % 20 = 0 and id < 180"), s))
    for q in range(0, 160, 20):
        mine = [v for i, v in whole if i == q]
        want = sorted({(-max(-top, min(top, sum(a * b for a, b in zip(v, w)))), i, n) for n, (i, w) in enumerate(whole) if i != q for v in mine})
        if q != 40:
            assert got[q] == [(i, -sc) for sc, i, _ in want[:9]]
    assert set(got) == set(range(0, 180, 20)) - {160}


def test_quantising_leaves_bad_vectors_out(spark):
    d = spark.createDataFrame([(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1e30, -0.015625])], "id long, e array<double>")
    assert {r.id: r.v for r in d.select("id", topk.quantised("e", 64).alias("v")).collect()} == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: [64e30, -1]}


# --- 5 language -------------------------------------------------------------


def test_gradients_agree_with_differences():
    net = langid.Network(3, 2, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    steps, y = rng.integers(97, 101, (6, 5)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    net32 = lambda: net.gradients(steps, y)
    _, g = net32()
    for k, p in net.p.items():
        for i in rng.permutation(p.size)[:200]:
            at = np.unravel_index(i, p.shape)
            if k[0] == "x" and at[1] not in (97, 98, 99, 100):
                continue
            old, e = p[at], 1e-2
            p[at] = old + e
            hi = net32()[0]
            p[at] = old - e
            lo = net32()[0]
            p[at] = old
            assert abs((hi - lo) / (2 * e) - g[k][at]) < 2e-3


def test_language_held_out_accuracy_and_edges(spark):
    docs = common.table(spark, SF, "documents")
    model = langid.fit(docs.where(~langid.held_out()), langid.Settings(per_language=400))
    rows = docs.join(langid.predict(docs, model), "doc_id").where(langid.held_out()).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    odd = clashing(docs_of(spark, [None, "", "123 !!", "the of and", "the of and", "the and of " * 20000]))
    got = langid.predict(odd, model, odd.columns).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == got[4].lang_pred and got[0].score == 0.0
    assert langid.predict(docs.limit(0), model).count() == 0
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


# --- 6 near duplicates --------------------------------------------------------


def brute_jaccard(texts):
    sets = {}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x09-\x0d\x1c-\x20]+", t or "")
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    rep, by = {}, {}
    for d in sets:
        rep[d] = by.setdefault(sets[d], d) if sets[d] else d
    ids = [d for d in sets if rep[d] == d and sets[d]]
    up, links = {d: d for d in sets}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {d: (root(rep[d]), links[rep[d]]) for d in sets}


@pytest.mark.parametrize("block", [256, 5])
def test_near_duplicates_against_brute_force(spark, corpus, block):
    rng = random.Random(2)
    w = prose(rng, 120).split()
    texts = [*corpus]
    for k in range(25):
        v = [*w]
        for _ in range(k % 6):
            v[rng.randrange(len(v))] = "edit"
        texts.append(" ".join(v))
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(clashing(docs_of(spark, texts)), neardup.Settings(block=block)).collect()}
    assert got == brute_jaccard(texts)
    kept = {r.doc_id for r in neardup.deduplicated(clashing(docs_of(spark, texts))).collect()}
    assert kept == {d for d, (c, _) in brute_jaccard(texts).items() if c == d}


def test_pruning_never_drops_what_reaches_the_threshold():
    s = neardup.Settings()
    for n, low in neardup.least_matches(s):
        # at similarity 0.8 the chance of fewer matches is below any use
        from math import comb

        assert sum(comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(low)) < 1e-7


def test_empty_near_duplicates(spark):
    assert neardup.classes(docs_of(spark, ["a"]).limit(0)).count() == 0


# --- 7 packing ----------------------------------------------------------------


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_packing_places_every_id_once(spark, corpus):
    texts = [*corpus, "it's <|endoftext|> here", *[prose(random.Random(i), 50 + 9 * i) for i in range(60)]]
    ids, _ = reference(texts)
    rows = packing.pack_documents(clashing(docs_of(spark, texts)).coalesce(1), queries.vocabulary(), with_ids=True).collect()
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) > 0
    for d, x in enumerate(ids):
        p = sorted(pieces[d], key=lambda r: r.start)
        assert [i for r in p for i in r.ids] == [*x, 0] and all(r.doc_tokens == len(x) + 1 for r in p)
        assert all(a.start + a.length == b.start for a, b in zip(p, p[1:], strict=False))
    fill = []
    for q in seqs.values():
        q.sort(key=lambda r: r.offset)
        assert q[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(q, q[1:], strict=False)) and len(q) <= 64
        fill.append(sum(r.length for r in q))
    assert max(fill) <= 1024 and sum(f < 1000 for f in fill) <= 2
    assert packing.pack_documents(docs_of(spark, ["a"]).limit(0), queries.vocabulary()).count() == 0


def test_all_limits_hold_at_once(spark):
    rng = random.Random(1)
    ex = [(i, [1] * n, [rng.random() < 0.5 for _ in range(n)]) for i, n in enumerate(rng.randint(1, 300) for _ in range(150))] + [(900, [], []), (901, None, None), (902, [1, 2], None)]
    d = spark.createDataFrame(ex, "example_id long, ids array<int>, loss array<boolean>").coalesce(1)
    lim = packing.Limits(tokens=256, segments=4, loss_tokens=100)
    by, seen = defaultdict(list), Counter()
    for r in packing.pack_examples(d, lim).collect():
        by[r.sequence_id].append(r)
        seen[r.example_id] += r.length
    for q in by.values():
        assert sum(r.length for r in q) <= 256 and len(q) <= 4 and sum(r.loss_tokens for r in q) <= 100
    assert seen == Counter({i: len(x) for i, x, _ in ex if x})


# --- 8 byte-pair encoding -------------------------------------------------------

HARD = ["", "a", " ", "  b", "don't 's's we'll'd", "a \n b\n\nc", "<|endoftext|>", "x<|endoftext|>'s<|endoftext|>", "½ ²x 12a", "日本 語😀😀", "a\r\n\r\nb", "' s", "a" * 5000, "ab" * 4000, " " * 3000, "-" * 2500]


@pytest.mark.parametrize("native", [False, True])
def test_ids_equal_the_public_library(native):
    rng = random.Random(7)
    texts = HARD + ["".join(rng.choices(" 'sdtlrevm\n\té1!a<|", k=rng.randint(1, 30))) for _ in range(2000)] + ["".join(rng.choices("etaoinshrdlu", k=6000)) for _ in range(4)]
    want, tok = reference(texts)
    e = bpe.Encoder(queries.vocabulary(), native=native)
    raw = [t.encode() for t in texts]
    ids, n = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == want
    for g in got[:40]:
        d = bpe.Decoder(e.merges.bytes_of)
        assert "".join([*(d.feed([i]) for i in g), d.finish()]) == tok.decode(g, skip_special_tokens=False)


def test_transducer_is_stable_in_any_chunks():
    e, rng = bpe.Encoder(queries.vocabulary()), random.Random(1)
    for text in ("".join(rng.choices("etaoinshr", k=9000)), "ab" * 5000, "a" * 7001):
        data = np.frombuffer(text.encode(), np.uint8)
        whole = e._one(data).tolist()
        for size in (1000, 1843, 5000):
            chunks = [data[i : i + size] for i in range(0, len(data), size)]
            assert np.concatenate([*e.stream(chunks)]).tolist() == whole


def test_round_trip_query(spark, corpus):
    d = clashing(docs_of(spark, [*corpus, *HARD]))
    want, _ = reference([*corpus, *HARD])
    rows = bpe.round_trip(d, queries.vocabulary()).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == want and [r.decoded for r in rows] == [t or "" for t in [*corpus, *HARD]]
    dig = bpe.round_trip_digests(d, queries.vocabulary()).orderBy("doc_id").collect()
    assert [r.ids_sha256 for r in dig] == [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in want]
    assert bpe.round_trip(d.limit(0), queries.vocabulary()).count() == 0


# --- 9 toxicity -----------------------------------------------------------------


@pytest.fixture(scope="module")
def machine():
    rng = random.Random(0)
    clean = [prose(rng, rng.randint(20, 90)) for _ in range(500)]
    bad = []
    for _ in range(250):
        w = prose(rng, rng.randint(20, 90)).split()
        w.insert(rng.randrange(len(w)), rng.choice(["idiot", "worthless", "moron", "scum"]))
        bad.append(" ".join(w))
    texts = clean + bad
    y = np.array([0] * len(clean) + [1] * len(bad), bool)
    return toxicity.train([t.encode() for t in texts], y)


def scores(machine, texts):
    raw = [t.encode() for t in texts]
    return machine.probability(machine.maxima(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])[0])


def test_toxicity_held_out(machine):
    rng = random.Random(99)
    clean = [prose(rng, 60) for _ in range(300)]
    assert (scores(machine, clean) >= 0.5).mean() < 0.05
    for w in ("idiot", "worthless", "moron", "scum"):
        forms = [w, w.upper(), ".".join(w), " ".join(w), w[:2] + "-" + w[2:], w + "!"]
        assert (scores(machine, [f"{c} {f} {c}" for c in clean[:5] for f in forms]) >= 0.5).mean() > 0.9


def test_kernel_tolerates_an_inserted_letter(machine):
    rng = random.Random(5)
    clean = [prose(rng, 12) for _ in range(40)]
    best = lambda xs: np.median(scores(machine, xs))
    assert best([c + " worxthless " + c for c in clean]) > 3 * best(clean)


def test_collapsed_weights_equal_the_landmark_expansion():
    s = toxicity.Settings()
    words = [b"idiot", b"the", b"moron", b"banana", b"worthless"]
    lm = toxicity.Landmarks([toxicity.padded(w) for w in words], s)
    beta = np.random.default_rng(0).standard_normal(lm.whiten.shape[1])
    m = toxicity.Machine(s, lm.collapse(beta))
    x = toxicity.padded(b"an idiotic moron")
    direct = float(lm.inner([x])[0] @ beta)
    assert abs(float(m.position_scores(np.frombuffer(x, np.uint8)).sum()) - direct) < 1e-3


def test_toxicity_edges(spark, machine):
    d = clashing(docs_of(spark, [None, "", "x", "x", "the " * 30000]))
    rows = toxicity.score(d, machine).orderBy("doc_id").collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[2].score == rows[3].score and rows[0].score < 0.5
    assert toxicity.score(d.limit(0), machine).count() == 0
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    one_class = toxicity.fit(d, labels)
    assert set(scores(one_class, ["a", ""])) != set()


# --- 10 chat ---------------------------------------------------------------------


def test_template_round_trip():
    rng = random.Random(2)
    texts = ["\\### Assistant: </turn> ok", "", "\\", "### user: x </turn>\n", " </turn>\n", ": ", "\\\\: <"] + ["".join(rng.choices("\\#:< />turn\nA", k=rng.randint(0, 25))) for _ in range(3000)]
    turns = [(rng.choice(["user", "assistant", "a: b", ""]), t) for t in texts]
    raw, r, back = "".join(chat.write_turn(*t)[0] for t in turns), chat.Reader(), []
    for i in range(0, len(raw), 997):
        back += r.feed(raw[i : i + 997])
    assert back == turns and r.rest == ""


def test_conversation_digests(spark):
    rows = [(1, 1, "assistant", "hé"), (1, 0, "user", "a"), (2, 0, None, None), (1, 1, "assistant", "hé"), (1, 2, "assistant", "### x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digest_paths(chat.chosen_turns(chat.chain(d))).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 9
    assert got[1].turns_sha256 == hashlib.sha256("user\na\nassistant\nhé\nassistant\nhé\nassistant\n### x\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("héhé### x".encode()).hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert chat.digest_paths(chat.chosen_turns(chat.chain(d.limit(0)))).count() == 0


def test_trees_rank_and_format(spark):
    m = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "thanks", 0.5), ("t", 8, 9, "user", "cycle", 1.0), ("t", 9, 8, "user", "cycle", 1.0), ("t", 7, 99, "user", "orphan", 0.0), ("t", 10, 9, "user", "tail of a cycle", 1.0)]
    ids = {"t": 1}
    d = spark.createDataFrame([(ids[t], *r) for t, *r in m], "tree long, node long, parent long, role string, text string, score double")
    turns = chat.chosen_turns(d, best=None)
    by = defaultdict(list)
    for r in turns.orderBy("leaf", F.desc("up")).collect():
        by[r.leaf].append(r.text)
    assert by == {2: ["q", "bad"], 4: ["q", "good", "thanks"], 7: ["orphan"]}
    top = chat.format_paths(chat.chosen_turns(d)).collect()
    assert len(top) == 1 and top[0].leaf == 4
    assert [top[0].formatted[a:b] for a, b in top[0].loss] == ["good"]


def test_deep_chain_takes_few_rounds(spark):
    d = spark.createDataFrame([(5, i, "user", str(i)) for i in range(70)], "conv_id long, turn long, role string, text string")
    assert chat.paths(chat.chain(d)).count() == 70


def test_null_conversations_are_kept(spark):
    rows = [(None, 1, "assistant", "b"), (None, 0, "user", "a"), (4, 0, "user", "c")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars) for r in chat.digest_paths(chat.chosen_turns(chat.chain(d))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {None: (2, sha("user\na\nassistant\nb\n"), 1), 4: (1, sha("user\nc\n"), 0)}


def test_random_forests_against_brute_force(spark):
    """Branches, several trees, cycles of three and five with leaves on them, missing parents."""
    rng, rows = random.Random(12), []
    for tree in (1, 2, None):
        for n in range(60):
            rows.append((tree, n, rng.randrange(n) if n and rng.random() < 0.9 else None, "user", f"{tree} {n}", rng.choice([None, 0.0, 0.5, 1.0])))
        for first, size in ((100, 3), (200, 5)):
            rows += [(tree, first + i, first + (i + 1) % size, "user", "cycle", 9.0) for i in range(size)]
            rows += [(tree, first + 50 + i, first + i, "user", "on a cycle", 9.0) for i in range(size)]
        rows.append((tree, 300, 999, "user", "its parent is missing", 0.25))
    d = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    want, means = set(), defaultdict(list)
    for tree in (1, 2, None):
        parent, score = {r[1]: r[2] for r in rows if r[0] == tree}, {r[1]: r[5] or 0.0 for r in rows if r[0] == tree}
        for leaf in parent.keys() - set(parent.values()):
            way, x = [], leaf
            while x in parent and x not in way:
                way.append(x)
                x = parent[x]
            if x not in way:
                want |= {(tree, leaf, node, up) for up, node in enumerate(way)}
                means[tree].append((-sum(score[n] for n in way) / len(way), -len(way), leaf))
    assert {tuple(r) for r in chat.paths(d).collect()} == want
    ranked = {(r.tree, r["rank"]): r.leaf for r in chat.rank_paths(d).collect()}
    assert ranked == {(t, k): leaf for t, v in means.items() for k, (*_, leaf) in enumerate(sorted(v), 1)}
    turns = chat.chosen_turns(d, best=2).collect()
    assert {(r.tree, r.leaf) for r in turns} == {(t, leaf) for t, v in means.items() for *_, leaf in sorted(v)[:2]}


def brute_reach(texts, near):
    """As brute_lines, over every line that isn't blank, with any relation of nearness."""
    occ = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").encode().split(b"\n")) if t is not None and x.strip()]
    lines = sorted({x for *_, x in occ})
    up, links, copies, head = {x: x for x in lines}, Counter(), Counter(x for *_, x in occ), {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if near(a, b):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    for d, k, x in sorted(occ):
        head.setdefault(root(x), (d, k))
    return {(d, k): (*head[root(x)], links[x], copies[x], head[root(x)] == (d, k)) for d, k, x in occ}


def test_short_lines_take_part(spark):
    rng = random.Random(19)
    base = ["Les.", "ab", "x", "All rights reserved.", "twelve bytes", "eleven byte", "just under the floor 23", "right at the floor of 24", "a line that is well above the floor", " \t "]
    texts = [None, "", "Les.\nAll rights reserved.\nown text of this document", "Les.\nAll rights reserved!\nother text of that one"]
    for _ in range(25):
        lines = []
        for _ in range(4):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = rng.choices("abé", k=rng.randint(0, 1))
            lines.append("".join(x))
        texts.append("\n".join(lines))
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.n_links, r.n_copies, r.kept) for r in linedup.line_classes(docs_of(spark, texts)).collect()}

    def near(a, b):
        n = min(len(a), len(b))
        return edit(a, b) <= (2 if n >= 24 else 1 if n >= 12 else 0)

    assert got == brute_reach(texts, near)
    out = {r.doc_id: r.text for r in linedup.deduplicated(docs_of(spark, texts[:4])).collect()}
    assert out[3] == "other text of that one"


def test_pairs_left_out_by_their_bags_are_out_of_reach():
    rng, s = random.Random(23), linedup.WHOLE
    words = [bytes(rng.choices(b"abcdefgh", k=rng.randint(1, 6))) for _ in range(40)]
    a, b = [], []
    for _ in range(400):
        x = rng.choices(words, k=rng.choice([1, 3, 9, 10, 30, 70, 110]))
        y = list(x)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(y))
            y[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
            y = y or x[:1]
        a.append(b" ".join(x))
        b.append(b" ".join(y) + rng.choice([b"", b"", b"!", b"?!"]))
    near = linedup.edit_distances(a, b, s.edits) <= s.bound(np.minimum([*map(len, a)], [*map(len, b)]))
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        ends = np.cumsum([len(x), len(y)])
        h, first, last = linedup.line_words(np.frombuffer(x + y, np.uint8), ends - [len(x), len(y)], ends)
        most = int(s.word_bound(np.array([(last - first).min()]))[0])
        u, v = h[first[0] : last[0]], h[first[1] : last[1]]
        near[k] |= most > 0 and linedup.word_distance(u, v, most) <= most
    assert 20 < near.sum() < 380
    # each pair is a group of its own; equal lines are one line in the library
    i, j = linedup.near_lines([x for pair in zip(a, b, strict=True) for x in pair], np.repeat(np.arange(len(a)), 2), None, s)
    assert (j == i + 1).all() and (i % 2 == 0).all()
    got = np.zeros(len(a), bool)
    got[i // 2] = True
    differ = np.array([x != y for x, y in zip(a, b, strict=True)])
    assert (got == near)[differ].all()
    # all in one group, across two sides: what is near stays near
    u, v = linedup.near_lines([*a, *b], np.zeros(2 * len(a), int), np.arange(2 * len(a)) < len(a), s)
    assert {(k, k + len(a)) for k in np.flatnonzero(near & differ).tolist()} <= set(zip(u.tolist(), v.tolist(), strict=True)) and (u < len(a)).all() and (v >= len(a)).all()


def test_word_distance():
    rng = random.Random(21)
    for _ in range(1500):
        a = rng.choices(range(5), k=rng.randint(0, 14))
        b = list(a) if rng.random() < 0.5 else rng.choices(range(5), k=rng.randint(0, 14))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choices(range(5), k=rng.randint(0, 1))
        for most in (1, 3):
            got = linedup.word_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
            assert min(got, most + 1) == min(edit(a, b), most + 1)


@pytest.mark.parametrize("block", [256, 5])
def test_bound_grows_with_the_words(spark, block):
    rng = random.Random(23)
    made = []
    for n in (9, 10, 11, 31, 32, 33, 47, 48, 49, 64, 80, 130):
        base = [prose(rng, 1) + "é" for _ in range(n)]
        made.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, n // 16, n // 16, n // 16 + 1):
            x = list(base)
            for _ in range(edits):
                k = rng.randint(0, len(x))
                x[k : k + rng.randint(0, 1)] = [prose(rng, 2).replace(" ", "") for _ in range(rng.randint(0, 1))]
            made.append(" ".join(x))
    made += ["界" * 12 + c for c in "天地玄黄"]
    rng.shuffle(made)
    texts = ["\n".join(made[i : i + 5]) for i in range(0, len(made), 5)]

    def words(x):
        return re.findall(r"[\u3000-\uffff]|[^\s\u3000-\uffff]+", x.decode())

    def near(a, b):
        x, y, n = words(a), words(b), min(len(a), len(b))
        m = min(len(x), len(y))
        most, few = (max(1, m // 16) if m >= 10 else 0), 2 if n >= 24 else 1 if n >= 12 else 0
        return (abs(len(a) - len(b)) <= few and edit(a, b) <= few) or (abs(len(x) - len(y)) <= most and edit(x, y) <= most)

    s = linedup.Settings(block=block, least=1, full=24, share=16)
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.n_links, r.n_copies, r.kept) for r in linedup.line_classes(docs_of(spark, texts), s).collect()}
    assert got == brute_reach(texts, near)
    assert sum(not r[-1] for r in got.values()) > 40


# --- pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 34", "en", "s", 5)], docs.schema)
    docs, ids = docs.union(odd), None
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF).checkpoint()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids is None or now <= ids
        if name == "language":
            assert not now & {9000, 9001, 9002} and len(now) > 180
        if name == "near":
            got = {r.doc_id: r.text for r in docs.collect()}
            order = sorted(got)
            classes = brute_jaccard([got[d] for d in order])
            assert now == {order[d] for d, (c, _) in classes.items() if c == d}
        docs, ids = out, now
    assert cp.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len(ids)
    assert cp.run(spark, SF).count() > 0


def test_every_query_is_registered():
    import __spark_entry__ as e

    q = e.queries()
    assert {int(m[1]) for n in q if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in q
