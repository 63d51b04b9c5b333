"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its word n-grams (five words; a shorter text is one n-gram of all
its words; words are runs of bytes between ASCII white space). Texts with equal sets form
one representative first, so copies cost nothing further.

Candidates come from banded MinHash: representatives that share a band's values are tied
in a star to the band's smallest member, and the stars' components are clusters. Within
a cluster all pairs are compared, in blocks of bounded size that are dealt out as pairs
of blocks: MinHash values are compared a batch at a time, and a pair is dropped as soon
as the posterior probability that its similarity reaches the threshold (uniform prior;
matches are binomial) falls below ``tolerance``. What is left is verified exactly on the
sets. A block emits a count of links for each member and a spanning forest, never its pairs.

Results: one row for each row with its class (the doc_id of the first row of its component)
and its number of links (other representatives at or above the threshold). Null and
empty texts have no n-gram: each is a class of its own without links. Repeated rows are
copies of each other. Rows are told apart and ordered by ``common.numbered``: those whose
doc_id is null or stands in other rows take part like any other, and come first or follow
their texts' hash; a class whose first row has a null doc_id has a null ``class_id``
(``classed`` has row numbers). An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, components, ensure_checkpoint_dir, few_rows, given_back, mix64, numbered, shuffle_parts, text_slices


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: similarity of at least above / below
    above: int = 4
    below: int = 5
    bands: int = 24
    rows: int = 3
    tolerance: float = 1e-9
    block: int = 256
    seed: int = 17

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ROLLING = Rolling(201)


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of every distinct n-gram, ordered."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.r_[False, ~_BLANK[data], False]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(text[1:-1] & (~text[:-2] | cut[:-1]))
    ends = np.flatnonzero(text[1:-1] & (~text[2:] | cut[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = _ROLLING.of(_ROLLING.prefix(data), starts, ends)
    doc = np.searchsorted(off, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(len(off) - 1))
    count = np.diff(np.r_[first, len(doc)])
    # position of a word among those of its text; n-grams start where n words are left, short texts once
    at = np.arange(len(doc)) - first[doc]
    size = np.minimum(count, n)[doc]
    begins = np.flatnonzero(at <= count[doc] - size)
    h = np.zeros(len(begins), np.uint64)
    for k in range(n):
        some = k < size[begins]
        nxt = np.minimum(begins + k, len(w) - 1)
        h = np.where(some, mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[nxt]), h)
    d = doc[begins]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[keep], h[keep]


def multipliers(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    return rng.integers(1, 2**63, s.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, s.hashes, dtype=np.uint64)


def signatures(h: np.ndarray, first: np.ndarray, s: Settings) -> np.ndarray:
    """(sets, hashes) MinHash values; ``first`` gives where each set begins, none is empty."""
    a, b = multipliers(s)
    out = np.empty((len(first), s.hashes), np.uint32)
    for k in range(s.hashes):
        out[:, k] = np.minimum.reduceat(((h * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is dropped).

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t, out = s.above / s.below, []
    for n in range(s.rows * 4, s.hashes + 1, s.rows * 4):
        total, m = 0.0, -1
        while m < n:
            p = comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if total + p >= s.tolerance:
                break
            total, m = total + p, m + 1
        out.append((n, m + 1))
    return out


SIGNED = "k long, doc_id long, c1 long, c2 long, n int, sig binary"


def signed(keyed: DataFrame, s: Settings) -> DataFrame:
    """(k, doc_id, c1, c2, n, sig) of every row with words: a digest of its set, its size, its MinHash values."""

    def run(batches):
        for data, off, _, rows in text_slices(batches):
            d, h = shingles(data, off, s.words)
            if not len(d):
                continue
            which, first, n = np.unique(d, return_index=True, return_counts=True)
            c1, c2 = np.add.reduceat(mix64(h), first), np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first)
            sig = signatures(h, first, s)
            raw = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((np.arange(len(sig) + 1) * sig.shape[1] * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sig))])
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(which)) for c in ("k", "doc_id")), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(n.astype(np.int32)), raw], ["k", "doc_id", "c1", "c2", "n", "sig"])

    return keyed.select("k", "doc_id", "text").mapInArrow(given_back(run), SIGNED)


def band_keys(reps: DataFrame, s: Settings) -> DataFrame:
    """(key, rep) for each band of each representative."""

    def run(batches):
        salt = mix64(np.arange(1, s.bands + 1, dtype=np.uint64))
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, s.bands, s.rows)
            key = np.broadcast_to(salt, (b.num_rows, s.bands)).copy()
            for r in range(s.rows):
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), s.bands))], ["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


def compare(sig_a: np.ndarray, sig_b: np.ndarray, same: bool, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that no batch of MinHash values has ruled out; i < j if both are the same block."""
    upto, low = bounds[0]
    m = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for k in range(upto):
        m += sig_a[:, k, None] == sig_b[None, :, k]
    i, j = np.nonzero(np.triu(m >= low, 1) if same else m >= low)
    count, done = m[i, j].astype(np.int32), upto
    for upto, low in bounds[1:]:
        if not len(i):
            break
        count = count + (sig_a[i, done:upto] == sig_b[j, done:upto]).sum(1)
        keep = count >= low
        i, j, count, done = i[keep], j[keep], count[keep], upto
    return i, j


def common_counts(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs, exactly."""
    if len(i) <= 2 * (len(sets_a) + len(sets_b)):
        return np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    used_a, used_b = np.unique(i), np.unique(j)
    flat = np.concatenate([*(sets_a[x] for x in used_a), *(sets_b[y] for y in used_b)])
    _, at = np.unique(flat, return_inverse=True)
    split = sum(len(sets_a[x]) for x in used_a)
    row_a = np.repeat(np.arange(len(used_a)), [len(sets_a[x]) for x in used_a])
    row_b = np.repeat(np.arange(len(used_b)), [len(sets_b[y]) for y in used_b])
    col_a, col_b, width = at[:split], at[split:], 8192
    inter = np.zeros((len(used_a), len(used_b)), np.float64)
    for c in range(0, int(at.max()) + 1, width):
        x, y = np.zeros((len(used_a), width), np.float32), np.zeros((len(used_b), width), np.float32)
        sa, sb = (col_a >= c) & (col_a < c + width), (col_b >= c) & (col_b < c + width)
        x[row_a[sa], col_a[sa] - c] = 1
        y[row_b[sb], col_b[sb] - c] = 1
        inter += x @ y.T
    return inter[np.searchsorted(used_a, i), np.searchsorted(used_b, j)].astype(np.int64)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, n - 1 at most."""
    up, out = list(range(n)), []

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def linked(keyed: DataFrame, clusters: DataFrame, s: Settings) -> DataFrame:
    """(a, b, links): each member's number of links within a pair of blocks (b null), and forest edges (links 0)."""

    def sets(batches):
        for data, off, _, rows in text_slices(batches):
            d, h = shingles(data, off, s.words)
            which, first = np.unique(d, return_index=True)
            sig = signatures(h, first, s)
            ends = np.r_[first[1:], len(h)]
            get = rows.select(["k", "root", "size"]).to_pydict()
            out, held = [], 0
            for x, (t, i, j) in enumerate(zip(which.tolist(), first.tolist(), ends.tolist(), strict=True)):
                k, n_blocks = get["k"][t], -(-get["size"][t] // s.block)
                mine = int(mix64(np.array([k], np.int64).view(np.uint64))[0] % np.uint64(n_blocks))
                raw, own = h[i:j].tobytes(), sig[x].tobytes()
                for other in range(n_blocks):
                    lo, hi = min(mine, other), max(mine, other)
                    out.append((get["root"][t], lo, hi, k, mine == lo, own, raw))
                    held += len(raw)
                    # a few copies at a time: a large cluster asks for many of each member
                    if len(out) >= 512 or held > 4 << 20:
                        yield packed(out)
                        out, held = [], 0
            if out:
                yield packed(out)

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)

    def blocks(batches):
        bounds, key, members = least_matches(s), None, []
        for b in few_rows(batches):
            cols = [b.column(c).to_pylist() for c in NAMES]
            for root, lo, hi, k, low_side, sig, h in zip(*cols, strict=True):
                if (root, lo, hi) != key:
                    if len(members) > 1:
                        yield from settle(key, members, bounds)
                    key, members = (root, lo, hi), []
                members.append((k, low_side, sig, h))
        if len(members) > 1:
            yield from settle(key, members, bounds)

    def settle(key, members, bounds):
        members = sorted(members)
        same = key[1] == key[2]
        sides = [members, members] if same else [[m for m in members if m[1]], [m for m in members if not m[1]]]
        if not all(sides):
            return
        ids = [np.array([m[0] for m in x]) for x in sides]
        sigs = [np.frombuffer(b"".join(m[2] for m in x), np.uint32).reshape(len(x), -1) for x in sides]
        own = [[np.frombuffer(m[3], np.uint64) for m in x] for x in sides]
        i, j = compare(sigs[0], sigs[1], same, bounds)
        if not len(i):
            return
        inter = common_counts(own[0], own[1], i, j)
        size_a, size_b = (np.array([len(x) for x in o]) for o in own)
        keep = inter * s.below >= s.above * (size_a[i] + size_b[j] - inter)
        i, j = i[keep], j[keep]
        if not len(i):
            return
        n = len(ids[0])
        links = [np.bincount(i, minlength=n), np.bincount(j, minlength=len(ids[1]))]
        if same:
            rows = [(int(k), None, int(c)) for k, c in zip(ids[0], links[0] + links[1], strict=True) if c]
            edges = [(int(ids[0][x]), int(ids[0][y]), 0) for x, y in forest(n, i, j)]
        else:
            rows = [(int(k), None, int(c)) for side in (0, 1) for k, c in zip(ids[side], links[side], strict=True) if c]
            edges = [(int(ids[0][x]), int(ids[1][y - n]), 0) for x, y in forest(n + len(ids[1]), i, j + n)]
        rows += edges
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "links"])

    members = keyed.select("k", "text").join(clusters.select(F.col("node").alias("k"), "root", "size"), "k")
    dealt = members.select("k", "text", "root", "size").mapInArrow(given_back(sets), "root long, lo int, hi int, k long, low_side boolean, sig binary, h binary")
    return dealt.repartition(shuffle_parts(keyed.sparkSession), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(given_back(blocks), "a long, b long, links long")


NAMES = ["root", "lo", "hi", "k", "low_side", "sig", "h"]
KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]


def classed(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows as ``common.numbered`` has them, and (k, doc_id, class_k, class_id, n_links, n_copies) for each."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = numbered(docs)
    keyed = rows.select("k", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    # computed once: a few hundred bytes for each document
    table = signed(keyed, s).checkpoint()
    reps = table.groupBy("c1", "c2").agg(F.min(F.struct("k", "doc_id")).alias("of"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    reps = reps.select("c1", "c2", F.col("of.k").alias("rep"), F.col("of.doc_id").alias("rep_id"), "n_copies", "sig")
    keys = band_keys(reps, s)
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    stars = keys.join(hubs, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = components(spark, stars)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    found = linked(keyed, clusters.join(sizes, "root"), s).checkpoint()
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("n_links"))
    roots = components(spark, found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), F.col("root").alias("class_k"))
    roots = roots.join(reps.select(F.col("rep").alias("class_k"), F.col("rep_id").alias("class_id")), "class_k")
    each = reps.select("c1", "c2", "rep", "rep_id", "n_copies").join(links, "rep", "left").join(roots, "rep", "left")
    class_id = F.when(F.col("class_k").isNull(), F.col("rep_id")).otherwise(F.col("class_id"))
    each = each.select("c1", "c2", "n_copies", F.coalesce("class_k", "rep").alias("class_k"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = ["k", "doc_id", "class_k", "class_id", "n_links", "n_copies"]
    with_words = table.select("k", "doc_id", "c1", "c2").join(each, ["c1", "c2"]).select(out)
    rest = keyed.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x09-\x0d\x1c-\x20]"))
    return rows, with_words.union(rest.select("k", "doc_id", F.col("k").alias("class_k"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies")))


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for every row."""
    return classed(docs, s)[1].select("doc_id", "class_id", "n_links", "n_copies")


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with the first row of each class only."""
    rows, found = classed(docs, s)
    drop = found.where("k <> class_k").select("k")
    return rows.join(drop, "k", "left_anti").select("row.*")
