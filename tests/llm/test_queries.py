"""The queries' own columns and the contents of the pipeline's stages, by direct computation; packing of turns."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from palimpsest.llm import bpe, chat, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def crc(x, mod):
    return None if x is None else zlib.crc32(str(x).encode()) % mod


# --- the queries' columns -------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in two languages with a null id, a null text and a digit's text, and labels of the toxic ones."""
    rng, at = random.Random(2), str(tmp_path_factory.mktemp("tables"))
    docs, labels = [(None, words(rng, 9), "aa", "s", 0), (-1, None, "aa", "s", 0), (-2, "12 34", None, "s", 0)], []
    for i in range(240):
        t = words(rng, 40, "abcdefgh" if i % 2 else "stuvwxyz")
        toxic = i % 4 == 1
        docs.append((i, t.replace(" ", " worthless ", 1) if toxic else t, "aa" if i % 2 else "zz", "s", 0))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_language_query(spark, folder):
    rows = queries.op5_language_id(spark, folder).collect()
    assert len(rows) == 243 and rows[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    assert all(r.held_out == (None if r.doc_id is None else crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    told = {r.doc_id: r.lang_pred for r in rows}
    assert told[-1] == told[-2] == "und" and told[None] == "aa"
    held = [r for r in rows if r.held_out and r.doc_id >= 0]
    assert len(held) > 30 and all(r.lang_pred == ("aa" if r.doc_id % 2 else "zz") for r in held)


def test_toxicity_query(spark, folder):
    rows = queries.op9_toxicity(spark, folder).collect()
    assert len(rows) == 243 and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(r.held_out == (None if r.doc_id is None else crc(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id >= 0]
    assert len(held) > 30 and np.mean([r.predicted == (r.doc_id % 4 == 1) for r in held]) > 0.9


# --- packing of turns -----------------------------------------------------------------


def conversations(rng):
    out = [(None, 0, "user", "a"), (5, 1, None, None), (5, 2, "assistant", ""), (5, None, "system", "first"), (7, 0, "user", "### x: </turn> <|endoftext|> \\"), (7, 1, "assistant", "é😀" * 700)]
    out += [(8, 3, "user", "twice"), (8, 3, "user", "twice")]
    for c in range(10, 40):
        out += [(c, t, "assistant" if t % 2 else "user", words(rng, rng.randint(1, 60))) for t in range(rng.randint(1, 9))]
    return out + [(99, t, "assistant" if t % 3 else "user", words(rng, 12)) for t in range(250)]  # half of all rows


@pytest.mark.parametrize("limits", [packing.Limits(256, 4, 150), packing.Limits(1024, 3, 1024)])
def test_turns_are_packed_whole_within_all_limits(spark, limits):
    rows = conversations(random.Random(4))
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 read", "'x' example_id").repartition(3)
    pieces = packing.pack_turns(d, queries.vocabulary(), limits).collect()
    sequences, examples = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        examples[p.conv_id, p.turn, p.n_turns].append(p)
        assert p.length == len(p.ids) == len(p.loss) > 0 and p.loss_tokens == sum(p.loss)
    for q in sequences.values():
        q.sort(key=lambda p: p.offset)
        assert q[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(q, q[1:], strict=False))
        assert sum(p.length for p in q) <= limits.tokens and len(q) <= limits.segments and sum(p.loss_tokens for p in q) <= limits.loss_tokens
    assert max(len(q) for q in sequences.values()) == limits.segments
    bytes_of = bpe.encoder(queries.vocabulary(), native=True).merges.bytes_of
    text = lambda ids: b"".join(bytes_of[i] for i in ids).decode()
    got, masked, tokens = [], [], 0
    for (conv, _, n), ps in examples.items():
        ps.sort(key=lambda p: p.start)
        ids, loss = [i for p in ps for i in p.ids], [x for p in ps for x in p.loss]
        tokens += len(ids)
        turns = list(chat.Reader().feed(text(ids)))
        assert len(turns) == n and (len(ids) <= limits.tokens and sum(loss) <= limits.loss_tokens or n == 1)
        got += [(conv, *t) for t in turns]
        masked.append((conv, chat.unescape(text([i for i, x in zip(ids, loss, strict=True) if x]))))
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(((c, r or "", t or "") for c, _, r, t in rows), key=key)
    for c in range(10, 40):
        assert sorted("".join(t for k, t in masked if k == c)) == sorted("".join(t for k, _, r, t in rows if k == c and r == "assistant"))
    # of a range's sequences only the last ones may be short, whichever limit fills the others
    assert len({p.sequence_id >> 36 for p in pieces}) > 1
    assert packing.pack_turns(d.limit(0), queries.vocabulary()).count() == 0


def test_replies_query_covers_its_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.packed_replies(spark, sf).collect()
    known = {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert {r.conv_id for r in rows} == known
    assert all(sum(r.length for r in q) <= 1024 and len(q) <= 8 and sum(r.loss_tokens for r in q) <= 768 for q in by.values())


# --- the pipeline's stages --------------------------------------------------------------


def test_lines_stage_content(spark):
    import corpus_pipeline as cp

    line, other = "a line that stands in several documents here", "another one of some length, also repeated"
    near = line.replace("several", "severul")
    texts = [f"{line}\nown {words(random.Random(1), 9)}", f"{near}\n\n  {other}\nnext", f"{other}\nlast words\n{line}", line, other + "\n" + line, None]
    out = cp.lines(spark, docs_of(spark, texts), "").collect()
    want = {0: texts[0], 1: f"\n  {other}\nnext", 2: f"{other}\nlast words", 5: None}
    got = {r.doc_id: r.text for r in out}
    # blanks at a line's beginning are part of it: the indented copy is two edits away, so it heads the other class
    assert got.keys() - {2, 4} == want.keys() - {2} and got[0] == want[0] and got[1] == want[1]
    assert got[2] in (want[2], "last words") and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_windows_stage_content(spark):
    import corpus_pipeline as cp

    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [words(rng, 50) + " " + passage, passage, passage + " " + words(rng, 20), words(rng, 9), "", None, passage[:99]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        gone = [False] * len(t or "")
        for k in range(len(gone) - 99):
            w = t[k : k + 100]
            if w in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(w)
        want[i] = t and "".join(c for c, g in zip(t, gone, strict=True) if not g)
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.repeats(spark, docs_of(spark, texts), "").collect()}
    assert got == {i: (t, None if t is None else len(t)) for i, t in want.items() if t is None or t.strip(" ")} and 1 not in got


def test_packing_stage_content(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    rng = random.Random(9)
    texts = [words(rng, n) for n in (1, 30, 700, 2500, 5)] + ["", None, "it's <|endoftext|> 日本"]
    t = Tokenizer.from_file(queries.vocabulary())
    pieces = defaultdict(list)
    for r in cp.pack(spark, docs_of(spark, texts), "").collect():
        pieces[r.doc_id].append(r)
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    assert re.fullmatch(r"\w+", cp.STAGES[-1][0]) and len(pieces) == len(texts)
