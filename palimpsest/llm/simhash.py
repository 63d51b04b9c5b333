"""SimHash near-duplicates: fingerprints compared as bit planes with carry-save counters.

A text's fingerprint has a bit set where more than half of its word shingles' hashes
have it. Equal fingerprints are one node. Two fingerprints within the radius r agree on
at least two of any r + 2 pieces of their bits, so every pair of pieces makes a key, and
near fingerprints meet under one of them. A key that more than ``most`` fingerprints
share is not compared as it is: within it the bits that still vary are cut into pieces
again, and again, until so few bits vary that no more than ``most`` values exist. No
group is therefore larger than ``most``, whatever the data, and nothing is left out.

Within a group the fingerprints lie as 64 bit planes, one lane each. A query's bit turns
a plane into a plane of differences; a full adder takes two such planes into binary
counters, one per lane, and a sticky plane keeps what ran over. Every eight planes the
rows of lanes that are all beyond the radius are abandoned. Each group gives the links
of a spanning star for each of its components, never all its pairs.

Null texts and texts without a word have fingerprint zero and are linked like any other.
Rows whose doc_id is null take part; component_id is the smallest doc_id that isn't null,
null where the component has none. Repeated rows give a row each. Texts of any length are
read a stretch at a time; other columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ensure_checkpoint_dir, shuffle_parts, text_slices

BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of one text that are taken into words at a time.
STRETCH = 1 << 20
#: Lanes of a block of small groups, and queries that go over a block together.
LANES, QUERIES = 512, 256
ALL = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Settings:
    words: int = 3
    seed: int = 42
    radius: int = 2
    #: fingerprints that are compared as one group at most
    most: int = 4096


# Fingerprints ----------------------------------------------------------------


def stretches(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-case in A-Z, a stretch at a time."""
    i = 0
    while i < len(raw):
        j = i + STRETCH
        if j < len(raw):
            found = BLANK.search(raw, j)
            j = found.start() if found else len(raw)
        yield raw[i:j].lower().split()
        i = j


def fingerprint(raw: bytes, s: Settings) -> int:
    from xxhash import xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal n
        bits = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        np.add(votes, np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64), out=votes)
        n += len(hashes)

    votes, n, held = np.zeros(64, np.int64), 0, []
    for part in stretches(raw):
        words = held + part
        count = len(words) - s.words + 1
        if count < 1:
            held = words
            continue
        joined = b" ".join(words)
        start = [0, *accumulate(len(w) + 1 for w in words)]
        add([xxh64_intdigest(joined[i : j - 1], s.seed) for i, j in zip(start[:count], start[s.words :], strict=True)])
        held = words[count:]
    if not n and held:
        add([xxh64_intdigest(b" ".join(held), s.seed)])
    return sum(1 << b for b in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint as a signed long) for every row of (doc_id, text)."""

    def run(batches):
        for data, off, _, rows in text_slices(batches):
            raw = data.tobytes()
            made = np.array([fingerprint(raw[i:j], s) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


# Comparison ------------------------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit i of plane b is bit b of values[i]; lanes past the end are zero."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -len(values) % 64 + len(values)), np.uint8)
    lanes[:, : len(values)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def lane_mask(rows: np.ndarray, words: int) -> np.ndarray:
    """(rows, words) with one lane set in each row."""
    out = np.zeros((len(rows), words), np.uint64)
    out[np.arange(len(rows)), rows // 64] = np.uint64(1) << (rows % 64).astype(np.uint64)
    return out


def near_lanes(queries: np.ndarray, planes: np.ndarray, beyond: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words): the lanes within the radius of each query, without those that are ``beyond`` from the start."""
    out = np.zeros_like(beyond)
    live, over = np.arange(len(queries)), beyond.copy()
    size = max(1, radius.bit_length())
    count = [np.zeros_like(beyond) for _ in range(size)]
    for b in range(0, 64, 2):
        flip = [np.uint64(0) - ((queries[live] >> np.uint64(b + k)) & np.uint64(1)) for k in (0, 1)]
        one, two = (planes[b + k] ^ flip[k][:, None] for k in (0, 1))
        # a full adder takes both planes into the lowest counter, its carry runs up the others
        odd = one ^ two
        carry = (one & two) | (odd & count[0])
        count[0] = odd ^ count[0]
        for j in range(1, size):
            count[j], carry = count[j] ^ carry, count[j] & carry
        over |= carry
        if b % 8 == 6:
            more, equal = over.copy(), np.full_like(over, ALL)
            for j in reversed(range(size)):
                if radius >> j & 1:
                    equal &= count[j]
                else:
                    more |= equal & count[j]
                    equal &= ~count[j]
            over |= more
            kept = (over != ALL).any(1)
            if not kept.all():
                live, over, count = live[kept], over[kept], [c[kept] for c in count]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def stars(values: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the position of the first one that it is linked with, over any number of links among ``values``."""
    m = len(values)
    planes = bit_planes(values)
    words = planes.shape[1]
    near = np.zeros((m, words), np.uint64)
    past = np.zeros(words * 64, np.uint8)
    past[m:] = 1
    past = np.packbits(past, bitorder="little").view("<u8")
    for i in range(0, m, QUERIES):
        rows = np.arange(i, min(i + QUERIES, m))
        near[rows] = near_lanes(values[rows], planes, past | lane_mask(rows, words), radius)
    root, seen = np.arange(m), np.zeros(m, bool)
    for i in np.flatnonzero(near.any(1)).tolist():
        if seen[i]:
            continue
        reach = lane_mask(np.array([i]), words)[0]
        front = np.array([i])
        while len(front):
            new = np.bitwise_or.reduce(near[front], axis=0) & ~reach
            reach |= new
            front = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
            root[front] = i
            seen[front] = True
    return root


def levels(s: Settings) -> list[dict[int, list[int]]]:
    """For each level the masks of key bits, by the mask of the level before; the last ones leave ``most`` values at most."""
    out, before = [], [0]
    while True:
        step = {}
        for mask in before:
            free = [b for b in range(64) if not mask >> b & 1]
            pieces = [p.tolist() for p in np.array_split(free, s.radius + 2)]
            step[mask] = [mask | sum(1 << b for p in two for b in p) for two in combinations(pieces, 2)]
        out.append(step)
        before = sorted({m for ms in step.values() for m in ms})
        if all(2 ** (64 - m.bit_count()) <= s.most for m in before):
            return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def compared(groups: DataFrame, s: Settings) -> DataFrame:
    """(a, b): spanning links of each group (mask, value) of fingerprints; several small groups share a block."""

    def links(values: np.ndarray) -> pa.RecordBatch:
        values = np.unique(values)
        root = stars(values.view(np.uint64), s.radius)
        k = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(values[k]), pa.array(values[root[k]])], ["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        group, n = None, 0
        for batch in batches:
            mask, value, fp = (batch.column(c).to_numpy() for c in ("mask", "value", "fp"))
            new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]) if len(mask) else []
            for i, j in zip(new, [*new[1:], len(mask)], strict=True):
                if (mask[i], value[i]) != group:
                    group = (mask[i], value[i])
                    if n >= LANES:
                        yield links(np.concatenate(held))
                        held, n = [], 0
                held.append(fp[i:j])
                n += j - i
        if n:
            yield links(np.concatenate(held))

    dealt = groups.repartition(shuffle_parts(groups.sparkSession), "mask", "value").sortWithinPartitions("mask", "value")
    return dealt.select("mask", "value", "fp").mapInArrow(run, "a long, b long").distinct()


def links(prints: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp`` from which every pair within the radius can be reached.

    Counts of keys are combined before they are shuffled and written to the shared
    folder; they decide which keys are compared and which are cut further.
    """
    keyed = lambda rows: rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")
    found, rows = None, None
    for step in levels(s):
        if rows is None:
            rows = keyed(prints.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in step[0]])).alias("mask")))
        else:
            finer = F.create_map(*[x for m, ms in step.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in ms]))])
            rows = keyed(rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct())
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
        # written before it is dealt: straight from this join, groups reached the kernel in pieces and lost links
        shared = rows.join(sizes, ["mask", "value"]).checkpoint()
        pairs = compared(shared.where(F.col("n") <= s.most), s)
        found = pairs if found is None else found.union(pairs)
        if sizes.where(F.col("n") > s.most).isEmpty():
            break
        rows = shared.where(F.col("n") > s.most).select("mask", "fp")
    return found


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) for every row."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    table = fingerprints(docs, s).checkpoint()
    nodes = table.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(spark, links(nodes.select("fp"), s)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp")
    low = rooted.groupBy("root").agg(F.min("first").alias("low"))
    whole = rooted.join(low, "root").select("fp", F.col("low"), F.lit(True).alias("linked"))
    each = nodes.join(whole, "fp", "left").select(F.col("fp").alias("fingerprint"), F.when(F.col("linked"), F.col("low")).otherwise(F.col("first")).alias("component_id"))
    return table.join(each, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
