"""SimHash, fill-in-middle and alignment against brute force; the queries over whole small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import align, fim, simhash
from palimpsest.llm.queries import vocabulary

DOCS = "doc_id long, text string, `fp` string, at int, row string"


def words(rng, n, letters="abcdefgh"):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(n))][0]


def odd_texts():
    rng = random.Random(5)
    base = words(rng, 60)
    near = base.split()
    near[30] = "changed"
    return [
        None, "", "  \n\t ", "one", "One", "two words", "a b c", "A B\x0bC", base, base.upper(), " ".join(near), base + " ", "naïve Ünïcode ěščř 北京 🙂 x", "tab\tand\x1funit \x0c end  ", "<P> held", "a<S>b<M>", "  lead and trail  ",
        words(rng, 400), "x" * 5000, "▁ low line ▁", "<|endoftext|> in text", "\x00 nul", "aaaa" * 300 + " " + "ab" * 200, base,
    ]


def odd_docs(spark):
    rows = [(i, t, "clash", 1, "r") for i, t in enumerate(odd_texts())] + [(None, "null id", "", 1, ""), (None, None, "", 1, ""), (3, "one", "", 1, ""), (3, "one", "", 1, "")]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# Fill-in-middle ---------------------------------------------------------------


def brute_fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    assert "".join(units) == t
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, sha(t), sha(t))
    spm = h4 % 100 < 80
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(units), "spm" if spm else "psm", len(p), len(m), sha(out), sha(t))


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_fill_in_middle_equals_brute_force(spark):
    d = odd_docs(spark)
    more = spark.createDataFrame([(100 + i, t, "", 0, "") for i, t in enumerate(t for _ in range(8) for t in odd_texts())], DOCS)
    d = d.union(more)
    got = fim.digests(d).collect()
    assert in_order(got) == in_order(brute_fim(r.doc_id, r.text) for r in d.collect())
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fim.digests(d.limit(0)).collect() == []
    kept = fim.transformed(d.where("doc_id = 8")).first()
    assert kept.row.fp == "clash" and kept.row.at == 1


def test_matcher_keeps_no_units():
    import tracemalloc

    text = "ab " * 400_000
    tracemalloc.start()
    assert fim.cuts(text, 3, 400_001 * 5 + 7)[0] == 400_001
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


# SimHash ----------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, f"{f:016x}", low.get(find(i))) for i, (d, f) in enumerate(rows)]


def test_simhash_equals_brute_force(spark):
    d = odd_docs(spark)
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in d.collect()])
    assert in_order(simhash.classes(d).collect()) == in_order(want)
    assert simhash.classes(d.limit(0)).collect() == []


def test_long_texts_are_read_in_stretches(monkeypatch):
    rng = random.Random(2)
    t = words(rng, 700) + " " + "y" * 300 + " Z  z"
    monkeypatch.setattr(simhash, "STRETCH", 64)
    assert simhash.fingerprint(t.encode(), simhash.Settings()) == brute_fingerprint(t)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6])
def test_bit_planes_count_distances(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 2**64, 150, dtype=np.uint64)
    for i in range(0, 120, 2):
        v[i + 1] = v[i] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 1 + i % 8, dtype=np.uint64))
    rows = np.arange(len(v))
    planes = simhash.bit_planes(v)
    near = simhash.near_lanes(v, planes, np.zeros((len(v), planes.shape[1]), np.uint64), radius)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, : len(v)].astype(bool)
    want = np.bitwise_count(v[:, None] ^ v[None]) <= radius
    assert (got == want).all() and got[rows, rows].all()


def test_every_key_is_cut_until_it_is_small_enough(spark):
    """Hot keys at every level: fingerprints that vary in few bits, far more of them than are compared at once."""
    rng = np.random.default_rng(1)
    free = np.array([3, 4, 9, 17, 18, 19, 33, 34, 40, 41, 50, 63], np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    fps = {int(base ^ np.bitwise_or.reduce(np.where(rng.random(12) < 0.5, np.uint64(1) << free, np.uint64(0)))) for _ in range(300)}
    fps |= {int(x) for x in rng.integers(0, 2**64, 100, dtype=np.uint64)}
    fps = sorted(fps)
    s = simhash.Settings(most=16)
    assert all(64 - m.bit_count() <= 4 for ms in simhash.levels(s)[-1].values() for m in ms)
    prints = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(prints, s).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    from palimpsest.llm.common import components

    got = {r.node % 2**64: r.root % 2**64 for r in components(spark, spark.createDataFrame([(simhash.signed(a), simhash.signed(b)) for a, b in edges], "a long, b long")).collect()}
    groups, want = {}, {}
    for f in fps:
        groups.setdefault(got.get(f, f), set()).add(f)
    for d, _, c in brute_components([(i, f) for i, f in enumerate(fps)]):
        want.setdefault(c, set()).add(fps[d])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


# Alignment --------------------------------------------------------------------


def brute_alignments(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from palimpsest.llm.bpe import byte_alphabet

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = byte_alphabet()
    held, best, out = {}, {}, []
    for doc_id, text in rows:
        a, b, whole = [], [], b" " + (text or "").encode()
        if text:
            a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            for i in sp.encode(text):
                p = sp.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        groups, ga, gb, la, lb, j = [], [], [], 0, 0, 0
        for i, x in a:
            ga.append(i)
            la += len(x)
            while j < len(b) and lb < la:
                gb.append(b[j][0])
                lb += len(b[j][1])
                j += 1
            if la == lb:
                groups.append((ga, gb))
                ga, gb = [], []
        # a cut may lie inside what a longer token of B has taken: only whole groups are closed
        assert not ga and not gb
        pairs = [(x, y) for u, v in groups for x in u for y in v]
        for p in set(pairs):
            held[p] = held.get(p, 0) + 1
        out.append((doc_id, len(a), len(b), groups, pairs))
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    sha = lambda g: hashlib.sha256(";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g).encode()).hexdigest() if g else ""
    return [(d, na, nb, len(g), len(p), sum(held[x] == best[x[0]] for x in p), sum(held[x] for x in p), sha(g)) for d, na, nb, g, p in out]


@pytest.mark.parametrize(("block", "wide"), [(8 << 20, 1 << 12), (50, 3)])
def test_alignment_equals_brute_force(spark, monkeypatch, block, wide):
    monkeypatch.setattr(align, "WIDE", wide)
    rng = random.Random(9)
    d = odd_docs(spark)
    extra = [(200 + i, " ".join(rng.choices(["Unbelievable", "internationalisation", "été", "12345", "北京大学", "🙂🙂", "don't", "\n\n", "   ", "qzxv", "the", "of"], k=rng.randint(1, 60))), "", 0, "") for i in range(40)]
    d = d.union(spark.createDataFrame(extra, DOCS))
    got = align.alignments(d, vocabulary(), vocabulary("piece_bpe_32k.model"), align.Settings(block=block)).collect()
    assert in_order(got) == in_order(brute_alignments([(r.doc_id, r.text) for r in d.collect()]))
    assert sum(r.n_a > 0 for r in got) > 50 and sum(r.n_a == 0 for r in got) > 3


def test_alignment_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    rows = align.alignments(d, vocabulary(), vocabulary("piece_bpe_32k.model")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align.alignments(d.limit(0), vocabulary(), vocabulary("piece_bpe_32k.model")).collect() == []


def test_wide_groups_and_chunks_agree(monkeypatch):
    """Links of one group counted by ids equal those written out, in one go or in parts."""
    al = align.aligner(vocabulary(), vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(4)
    in_a, in_b = rng.integers(1, 30, 50), rng.integers(1, 30, 50)
    a, b = rng.integers(0, 9, in_a.sum()), rng.integers(0, 9, in_b.sum())
    args = (a, b, np.sort(rng.integers(0, 5, 50)), in_a, in_b, np.cumsum(in_a), np.cumsum(in_b))
    keys, weight = al.links(*args)
    for wide, at_once in ((10, 1 << 22), (1 << 12, 100), (200, 50)):
        monkeypatch.setattr(align, "WIDE", wide)
        monkeypatch.setattr(align, "EXPANDED", at_once)
        k, w = al.links(*args)
        assert (k == keys).all() and (w == weight).all()


# Earlier operators: long texts, the queries' own columns -----------------------------


def test_many_repeated_lines_of_one_text(spark):
    import time

    from palimpsest.llm import linedup

    lines = [f"a line of some length, number {i % 500}" for i in range(60_000)]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "alone here")], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in linedup.deduplicated(d).collect()}
    kept = got[1].split("\n")
    assert got[3] == "alone here" and got[2] is None and len(kept) == len(set(kept)) <= 500 and set(kept) <= set(lines)
    assert time.time() - began < 200


def test_language_samples_are_the_lowest_of_each_language(spark):
    from palimpsest.llm import langid

    s = langid.Settings(per_language=40)
    rng = random.Random(6)
    rows = [(i, words(rng, 12), "de" if i % 5 else "fr") for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = sorted((r.lang, r.h, bytes(r.piece)) for r in langid.training_sample(d, s).collect())
    every = sorted((r.lang, r.h, bytes(r.piece)) for r in langid.training_sample(d, langid.Settings(per_language=10**6)).collect())
    assert got == [r for k in ("de", "fr") for r in [x for x in every if x[0] == k][:40]] and len(every) > 700


def test_entries_of_lines_are_packed_in_small_chunks(spark, monkeypatch):
    from palimpsest.llm import linedup

    # packing holds a chunk about six times, in every worker of an executor
    assert 6 * linedup.CHUNK * linedup.KEY.itemsize <= 64 << 20
    d = spark.createDataFrame([(i, "\n".join(f"a line of the text number {(i * k) % 30} and more of it" for k in range(9))) for i in range(60)], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, linedup.deduplicated(d).collect()))
    monkeypatch.setattr(linedup, "CHUNK", 50)
    assert sorted(map(tuple, linedup.deduplicated(d).collect())) == want and len(want) < 60


def test_lines_hash_their_bytes_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from palimpsest.llm import common, linedup

    words = " ".join(f"w{i}" for i in range(200))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{words}\nshort line of some words here\n\n x", None, words])], ["text"])
    sizes, real = [], common.Rolling.prefix
    monkeypatch.setattr(common.Rolling, "prefix", lambda self, data: sizes.append(len(data)) or real(self, data))
    made = [linedup.entries(data, begin, end, linedup.WHOLE, prefix) for data, prefix, begin, end, _ in linedup._distinct(iter([batch]), linedup.WHOLE)]
    assert len(sizes) == 1 and sum(map(len, made)) > 50
    # where words end, against the blanks
    data = np.frombuffer("a bc\t\n\u3042\u3044x y\n".encode(), np.uint8)
    begin, end = np.array([0, 6]), np.array([5, len(data) - 1])
    h, first, last = linedup.line_words(data, begin, end, real(linedup._W, data))
    alone = [linedup.line_words(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0][0] for w in ("a", "bc", "\u3042", "\u3044", "x", "y")]
    assert h.tolist() == alone and first.tolist() == [0, 2] and last.tolist() == [2, 6]


def test_contexts_are_packed_a_few_at_a_time(spark, monkeypatch):
    import random

    from palimpsest.llm import windows

    rng = random.Random(5)
    gram = "".join(rng.choices("abcdef ", k=60))
    texts = ["".join(rng.choices("abcdef ", k=80)) + gram + "".join(rng.choices("abcdef ", k=rng.randrange(90))) for _ in range(40)]
    texts += [t[10:] + "!" for t in texts[:15]]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, windows.removal_digests(d).collect()))
    assert sum(r[2] > 0 for r in want) >= 15
    monkeypatch.setattr(windows, "CONTEXT_BYTES", 1)
    assert sorted(map(tuple, windows.removal_digests(d).collect())) == want


def test_kernels_take_few_rows_and_give_back(monkeypatch):
    import pyarrow as pa

    from palimpsest.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], ["x"])
    assert [b.num_rows for b in common.few_rows(iter([batch, batch.slice(0, 3)]))] == [256, 256, 88, 3]
    told = []

    def kernel(batches):
        try:
            yield from batches
        finally:
            told.append("returned")

    monkeypatch.setattr(common, "give_back", lambda: told.append("given back"))
    assert len(list(common.given_back(kernel)(iter([batch, batch])))) == 2
    assert told == ["returned", "given back"]


def test_a_large_cluster_is_dealt_by_cells(spark):
    from palimpsest.llm import linedup

    rng, s = random.Random(31), linedup.Settings(block=16, least=1, full=24, share=32)
    lines = sorted({" ".join(rng.choices(["ab", "cde", "fghi", "k"], k=rng.randint(4, 120))) for _ in range(3000)})
    cells = linedup.cells([x.encode() for x in lines], s).to_pylist()
    assert max(map(len, cells)) <= 4
    members = spark.createDataFrame([(1, len(lines), i, x.encode(), c) for i, (x, c) in enumerate(zip(lines, cells, strict=True))], "root long, size long, node long, line binary, cells array<long>")
    # a copy of each line for each block of 16 of the cluster before, which is 187
    assert linedup.dealt(members, s).count() < 12 * len(lines)


@pytest.mark.parametrize("block", [3, 10_000])
def test_cells_find_what_one_block_finds(spark, block):
    from palimpsest.llm import linedup

    rng = random.Random(37)
    lines = [" ".join(rng.choices(["ab", "cde", "fghi", "k"], k=rng.choice([5, 9, 10, 11, 33, 64, 65, 66, 99]))) for _ in range(60)]
    lines = sorted({*lines, *(x + "y" for x in lines), *(x.replace("k", "a longer word", 1) for x in lines), *(x.replace("cde", "k", 2) for x in lines)})
    raw = [x.encode() for x in lines]
    node = [int(linedup._A.of(linedup._A.prefix(np.frombuffer(x, np.uint8)), np.array([0]), np.array([len(x)])).view(np.int64)[0]) for x in raw]
    clusters = spark.createDataFrame([(n, 1, len(lines)) for n in node], "node long, root long, size long")
    s = linedup.Settings(block=block, least=1, full=24, share=32)
    docs = spark.createDataFrame([("\n".join(lines),)], "text string")
    got: dict = {}
    for r in linedup.verified(docs, clusters, s).where("b is null").collect():
        got[r.a] = got.get(r.a, 0) + r.links
    i, j = linedup.near_lines(raw, np.zeros(len(raw), int), None, s)
    links = np.bincount(np.r_[i, j], minlength=len(raw))
    assert got == {n: k for n, k in zip(node, links.tolist(), strict=True) if k} and len(got) > 60


def test_groups_are_written_before_they_are_dealt(spark):
    prints = spark.range(200).select((F.col("id") * 3).alias("fp")).checkpoint()
    plan = simhash.links(prints)._jdf.queryExecution().optimizedPlan().toString()
    # dealt straight from the join of keys with their sizes, groups came in pieces
    assert "MapInArrow" in plan and "Join" not in plan
