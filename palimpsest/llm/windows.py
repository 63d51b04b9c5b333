"""Repeated windows by a depth-limited radix sort over sampled suffixes.

A window is ``length`` consecutive bytes. Sorting every suffix through ``length`` bytes
would move several times the corpus, so each window is represented by one suffix: the one
that starts at the smallest of the window's grams (``gram`` bytes, by a hash, leftmost on
ties). The choice depends on the window's bytes alone, so equal windows choose equally,
and neighbouring windows mostly share a choice: about one suffix in forty is kept, and
nothing is lost. The sort then goes most significant digit first, and stops at depth
``length``:

1. the first digit is the gram itself; suffixes alone in their group drop out;
2. the second digit is everything that the suffix's windows cover (its context). Equal
   contexts are equal runs of windows: all but the earliest are repeats;
3. where one gram has several contexts, their suffixes are ordered by their bytes, four at
   a time and most significant first (``radix_groups``), alone ones dropping out after
   each pass; after ``length`` bytes equal groups are exactly the repeated windows.

The first two digits are compared by 64-bit hashes of independent families, 128 bits
together; a gram with more than ``MANY`` contexts is settled by hashes of its windows, dealt
out by them, so that no gram is one task's work.

Every task first sorts what it has read itself, so a passage that any number of
documents share reaches a reducer once for each task; no group is larger than that.
Groups travel as packed arrays, one binary row for a task and reducer.

Order is (doc_id, start). Null texts are empty; texts shorter than a window have no
repeats. A row is a document of its own also if its doc_id is null or stands in other rows
(``common.numbered``): null doc_ids come first, rows of one doc_id follow their texts' hash,
so of two equal rows one keeps the passage. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, ensure_checkpoint_dir, few_rows, given_back, numbered, shuffle_parts, text_slices

#: Records that a task sorts at a time, which holds them about six times, and bytes of contexts that it packs at a time.
CHUNK = 500_000
CONTEXT_BYTES = 4 << 20
_ROLLING: dict[int, Rolling] = {}


def rolling(seed: int) -> Rolling:
    if seed not in _ROLLING:
        _ROLLING[seed] = Rolling(seed)
    return _ROLLING[seed]


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 24

    @property
    def grams(self) -> int:
        return self.length - self.gram + 1


def leftmost_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of h[i : i + w] for every i, the leftmost one on ties."""
    value, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < w:
        step = min(span, w - span)
        right = value[step:] < value[:-step]
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        span += step
    return at


def sampled(data: np.ndarray, off: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, number of windows, gram hash, context hash) of each sampled suffix."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    if len(data) < s.length:
        return none
    one, two = rolling(101), rolling(102)
    p1 = one.prefix(data)
    h = one.windows(p1, s.gram)
    at = leftmost_minimum((h >> np.uint64(32)).astype(np.uint32), s.grams)
    n = len(data) - s.length + 1
    inside = np.zeros(n + 1, np.int32)
    begin, end = off[:-1], off[1:] - s.length + 1
    ok = end > begin
    np.add.at(inside, begin[ok], 1)
    np.add.at(inside, np.minimum(end[ok], n), -1)
    valid = np.cumsum(inside[:n]) > 0
    first = np.zeros(n + 1, bool)
    first[begin[ok]] = True
    change = np.ones(n, bool)
    change[1:] = (at[1:n] != at[: n - 1]) | ~valid[:-1]
    low = np.flatnonzero((change | first[:n]) & valid)
    if not len(low):
        return none
    doc = np.searchsorted(off, low, "right") - 1
    high = np.minimum(np.r_[low[1:], n], off[1:][doc] - s.length + 1)
    p2 = two.prefix(data)
    return doc, low - off[doc], high - low, h[at[low]], two.of(p2, low, high - 1 + s.length)


def _runs(key: np.ndarray) -> np.ndarray:
    """Whether each element of a sorted array begins a run of equal ones."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


BLOCK = 1 << 20
SAMPLE = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
WINDOW = np.dtype([("a", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: A gram with more contexts than this is settled window by window, dealt by the windows' hashes.
MANY = 512
FOUND = "k long, start long, n long, a long, kind int"
SPAN, SMALL_GROUP, LARGE_GROUP = 0, 1, 2
PACKED = "part int, blob binary"
#: First byte of a packed row: records, contexts with their bytes, or settled spans.
RECORDS, CONTEXTS, SPANS = b"\0", b"\1", b"\2"
#: Windows whose bytes are ordered at a time; bounds a reducer's memory.
ORDERED = 1_000_000


def blocks(data: np.ndarray, off: np.ndarray, overlap: int):
    """(bytes, offsets, number of the first text, its place in that text): very long texts in overlapping blocks.

    A window lies wholly in one block at least, and a cut run is only another context.
    """
    if len(off) > 2 or len(data) <= 2 * BLOCK:
        yield data, off, 0, 0
        return
    for i in range(0, max(1, len(data) - overlap), BLOCK):
        part = data[i : min(i + BLOCK + overlap, len(data))]
        yield part, np.array([0, len(part)], np.int64), 0, i


def first_of_each(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records ordered by (a, c, doc, start), and whether each begins an (a, c) group: the earliest of its kind."""
    r = r[np.lexsort((r["start"], r["doc"], r["c"], r["a"]))]
    return r, _runs(r["a"]) | _runs(r["c"])


def merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges joined where they touch or overlap."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), (start[order] + n[order]).astype(np.int64)
    group = np.cumsum(_runs(doc))
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], reach[last] - start[at]


def _packed(part: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _dealt(r: np.ndarray, parts: int) -> pa.RecordBatch:
    """One binary row of records for each reducer: a group's records always share one."""
    part = ((r["a"] >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    r, part = r[order], part[order]
    at = np.flatnonzero(_runs(part)) if len(r) else np.zeros(0, np.int64)
    # fields apart: like bytes lie together, so the shuffle's compression finds them
    blobs = [RECORDS + b"".join(np.ascontiguousarray(r[i:j][f]).tobytes() for f in r.dtype.names) for i, j in zip(at.tolist(), np.r_[at[1:], len(r)].tolist(), strict=True)]
    return _packed(part[at], blobs)


def _unpacked(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.zeros(sum(len(b) // kind.itemsize for b in blobs), kind)
    i = 0
    for b in blobs:
        m, at = len(b) // kind.itemsize, 0
        for f in kind.names:
            w = kind[f].itemsize * m
            out[f][i : i + m] = np.frombuffer(b[at : at + w], kind[f])
            at += w
        i += m
    return out


def _spans(r: np.ndarray, parts: int):
    """What a task has settled itself, joined and in one row, to any reducer."""
    if len(r):
        doc, start, n = merged(r["doc"], r["start"], r["n"])
        yield _packed(np.array([int(doc[0]) % parts], np.int32), [SPANS + b"".join(x.astype("<i8").tobytes() for x in (doc, start, n))])


def _settled(records: list[np.ndarray], parts: int):
    """Of records read by one task: the earliest of each kind to its reducer, the others as spans."""
    r, first = first_of_each(np.concatenate(records))
    yield _dealt(r[first], parts)
    yield from _spans(r[~first], parts)


def _found(doc, start, n, a, kind):
    m = len(doc)
    kind = np.full(m, kind, np.int32) if np.isscalar(kind) else kind.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64) if len(a) else np.zeros(0, np.int64)), pa.array(kind)], ["k", "start", "n", "a", "kind"])


def _found_spans(doc, start, n):
    return _found(doc, start, n, np.zeros(len(doc), np.uint64), SPAN)


def _received(batches) -> tuple[dict[bytes, list[bytes]], list[pa.RecordBatch]]:
    """A reducer's rows by their first byte, and the spans among them."""
    by: dict[bytes, list[bytes]] = {RECORDS: [], CONTEXTS: []}
    spans = []
    for b in batches:
        for blob in b.column("blob").to_pylist():
            if blob[:1] == SPANS:
                spans.append(_found_spans(*np.frombuffer(blob, "<i8", offset=1).reshape(3, -1)))
            else:
                by[blob[:1]].append(blob[1:])
    return by, spans


def repeated(keyed: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(k, text, ...) with unique k to (k, start, n): windows start .. start + n - 1 of row k occur earlier. Ranges may overlap."""
    spark = keyed.sparkSession
    parts = shuffle_parts(spark)

    def sample(batches):
        held, size = [], 0
        for data, off, _, rows in text_slices(batches, BLOCK):
            ids = rows.column("k").to_numpy()
            for part, part_off, t, base in blocks(data, off, s.length - 1):
                doc, start, n, a, c = sampled(part, part_off, s)
                r = np.zeros(len(doc), SAMPLE)
                r["a"], r["c"], r["doc"], r["start"], r["n"] = a, c, ids[doc + t], start + base, n
                held.append(r)
                size += len(r)
                if size >= CHUNK:
                    yield from _settled(held, parts)
                    held, size = [], 0
        if size:
            yield from _settled(held, parts)

    def by_context(batches):
        by, spans = _received(batches)
        yield from spans
        if not by[RECORDS]:
            return
        r, first = first_of_each(_unpacked(by[RECORDS], SAMPLE))
        again = r[~first]
        if len(again):
            yield _found(again["doc"], again["start"], again["n"], again["a"], SPAN)
        r = r[first]
        at = np.flatnonzero(_runs(r["a"]))
        size = np.diff(np.r_[at, len(r)])
        contexts = np.repeat(size, size)
        r, contexts = r[contexts > 1], contexts[contexts > 1]
        if len(r):
            yield _found(r["doc"], r["start"], r["n"], r["a"], np.where(contexts > MANY, LARGE_GROUP, SMALL_GROUP))

    passed = keyed.select("k", "text").mapInArrow(given_back(sample), PACKED).repartitionById(parts, "part").mapInArrow(given_back(by_context), FOUND)
    # read twice below: written once to the shared folder, a few bytes for each group that is not settled
    ensure_checkpoint_dir(spark)
    passed = passed.checkpoint()
    open_groups = passed.where(f"kind <> {SPAN}").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("start", "n", "a", "kind"))).alias("open"))

    def contexts(batches):
        held, size = [], 0
        small: list[tuple] = []
        weight = 0
        for b in few_rows(batches):
            for k, text, todo in zip(*(b.column(c).to_pylist() for c in ("k", "text", "open")), strict=True):
                raw = (text or "").encode()
                data = np.frombuffer(raw, np.uint8)
                for x in todo:
                    i, n = x["start"], x["n"]
                    if x["kind"] == LARGE_GROUP:
                        r = window_records(data[i : i + n + s.length - 1], k, i, s)
                        held.append(r)
                        size += len(r)
                    else:
                        small.append((x["a"] % (1 << 64), k, i, n, raw[i : i + n + s.length - 1]))
                        # a tuple and its numbers in Python, beside the bytes
                        weight += n + s.length + 300
                if size >= CHUNK:
                    yield from _settled(held, parts)
                    held, size = [], 0
                if weight >= CONTEXT_BYTES:
                    yield _context_batch(small, parts)
                    small, weight = [], 0
        if small:
            yield _context_batch(small, parts)
        if size:
            yield from _settled(held, parts)

    def by_window(batches):
        by, spans = _received(batches)
        yield from spans
        found = []
        if by[RECORDS]:
            r, first = first_of_each(_unpacked(by[RECORDS], WINDOW))
            found.append([r[~first][c] for c in ("doc", "start", "n")])
        for doc, start in repeated_in_contexts(by[CONTEXTS], s):
            found.append([doc, start, np.ones(len(doc), np.int64)])
        if found:
            doc, start, n = (np.concatenate([np.asarray(f[c], np.int64) for f in found]) for c in range(3))
            if len(doc):
                yield _found_spans(*merged(doc, start, n))

    # all columns stay, though two are read, so that the same exchange serves the join that cuts the texts
    more = keyed.join(open_groups.hint("shuffle_hash"), "k").mapInArrow(given_back(contexts), PACKED).repartitionById(parts, "part").mapInArrow(given_back(by_window), FOUND)
    return passed.where(f"kind = {SPAN}").union(more).select("k", "start", "n")


def window_records(part: np.ndarray, k: int, start: int, s: Settings) -> np.ndarray:
    """One record for each window of a stretch; the window's own hash takes the gram's place."""
    one, two = rolling(103), rolling(104)
    a, c = one.windows(one.prefix(part), s.length), two.windows(two.prefix(part), s.length)
    m = max(0, len(part) - s.length + 1)
    r = np.zeros(m, WINDOW)
    r["a"], r["c"], r["doc"], r["start"], r["n"] = a[:m], c[:m], k, start + np.arange(m), 1
    return r


def _context_batch(small: list[tuple], parts: int) -> pa.RecordBatch:
    """Contexts of small groups, packed by the reducer of their gram: bounds first, then the bytes."""
    by: dict[int, list[tuple]] = {}
    for x in small:
        by.setdefault((x[0] >> 20) % parts, []).append(x)
    blobs = []
    for rows in by.values():
        head = np.array([(a - (1 << 64) if a >> 63 else a, k, i, n, len(raw)) for a, k, i, n, raw in rows], "<i8")
        blobs.append(CONTEXTS + np.int64(len(rows)).tobytes() + head.tobytes() + b"".join(x[4] for x in rows))
    return _packed(np.array([*by], np.int32), blobs)


def radix_groups(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the suffix, group): suffixes data[at:] ordered through ``length`` bytes, four in each pass.

    Passes go from the most significant digit on; a suffix alone in its group drops out.
    Those that are left share all of the ``length`` bytes with their group.
    """
    which, group = np.arange(len(at)), np.zeros(len(at), np.uint64)
    for depth in range(0, length, 4):
        digit = np.zeros(len(which), np.uint64)
        for i in range(depth, min(depth + 4, length)):
            digit = digit << np.uint64(8) | data[at[which] + i]
        key = group << np.uint64(32) | digit
        order = np.argsort(key)
        which, key = which[order], key[order]
        new = _runs(key)
        begin = np.flatnonzero(new)
        keep = np.repeat(np.diff(np.r_[begin, len(key)]), np.diff(np.r_[begin, len(key)])) > 1
        which, group = which[keep], np.cumsum(new)[keep].astype(np.uint64)
        if not len(which):
            break
    return which, group


def repeated_in_contexts(blobs: list[bytes], s: Settings):
    """(row, start) of the windows that another window of a context of their gram equals and precedes, some grams at a time."""
    heads, bodies = [], []
    for b in blobs:
        m = int(np.frombuffer(b[:8], "<i8")[0])
        heads.append(np.frombuffer(b[8 : 8 + 40 * m], "<i8").reshape(m, 5))
        bodies.append(b[8 + 40 * m :])
    if not heads:
        return
    head, data = np.concatenate(heads), np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.cumsum(head[:, 4]) - head[:, 4]
    order = np.argsort(head[:, 0], kind="stable")
    head, begin = head[order], begin[order]
    count = np.maximum(head[:, 4] - s.length + 1, 0)
    # a gram's contexts stay together; they are few, and none is much longer than two windows
    cut = np.cumsum(count) // ORDERED
    edge = np.flatnonzero(_runs(head[:, 0]))
    edge = edge[np.r_[True, cut[edge[1:]] != cut[edge[:-1]]]]
    for i, j in zip(edge.tolist(), np.r_[edge[1:], len(head)].tolist(), strict=True):
        some, n = head[i:j], count[i:j]
        context = np.repeat(np.arange(len(some)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        which, group = radix_groups(data, begin[i:j][context] + place, s.length)
        if len(which):
            doc, start = some[context[which], 1], some[context[which], 2] + place[which]
            by = np.lexsort((start, doc, group))
            again = ~_runs(group[by])
            yield doc[by][again], start[by][again]


def spans_of(ranges: list, length: int, size: int) -> list[tuple[int, int]]:
    """Maximal removed byte runs of one text from its window ranges."""
    out: list[list[int]] = []
    for i, n in sorted((x["start"], x["n"]) for x in ranges):
        j = min(i + n - 1 + length, size)
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        elif i < j:
            out.append([i, j])
    return [tuple(x) for x in out]


def with_ranges(docs: DataFrame, s: Settings, columns: list[str]) -> DataFrame:
    """(k, text, row, ranges): every row with its window ranges (null: none); ``row`` holds ``columns``. No column name can clash."""
    rows = numbered(docs)
    # one projection for both joins: the texts are dealt out once
    keyed = rows.select("k", F.col("row.text").alias("text"), F.struct(*[F.col("row")[c].alias(c) for c in columns]).alias("row"))
    ranges = repeated(keyed, s).groupBy("k").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    return keyed.join(ranges.hint("shuffle_hash"), "k", "left").select("text", "row", "ranges")


def removal_digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in few_rows(batches):
            rows = []
            for k, text, ranges in zip(b.column("row").field("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                spans = spans_of(ranges or [], s.length, len(raw))
                h, at = sha256(), 0
                for i, j in spans:
                    h.update(raw[at:i])
                    at = j
                h.update(raw[at:])
                rows.append((k, len(raw), sum(j - i for i, j in spans), len(spans), h.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)], names)

    return with_ranges(docs, s, ["doc_id"]).mapInArrow(given_back(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with the repeats cut out of ``text``; a character that loses a byte goes whole. Columns stay; null texts stay null."""
    others = [c for c in docs.columns if c != "text"]

    def cut(batches):
        for part in few_rows(batches):
            out, rows = [], part.column("row")
            for t, r in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                if t is not None and r:
                    raw, kept, done = t.encode(), [], 0
                    for i, j in spans_of(r, s.length, len(raw)):
                        kept.append(raw[done:i])
                        done = j
                    t = b"".join([*kept, raw[done:]]).decode("utf-8", "ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else rows.field(c) for c in docs_columns], docs_columns)

    docs_columns = docs.columns
    return with_ranges(docs, s, others).mapInArrow(given_back(cut), docs.schema)
