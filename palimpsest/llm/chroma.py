"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, alignment.

A recording is cut into overlapping frames whose spectra are folded into twelve pitch
classes, smoothed over time and normalised. Sixteen rectangular filters, evaluated on
the integral image of the resulting (time, class) picture, compare the energy of two
areas; each comparison is quantised to two bits of Gray code, and the sixteen make one
32-bit integer for each position.

The index of a block of recordings lists the places of every value of each 16-bit window
of the integers (windows begin at every eighth bit and wrap around). A query looks its own
values up and counts the hits by recording and offset: the offset histogram. Every offset
in it is judged by the share of differing bits over the whole overlap, exactly, and the
best one of each recording stays.

The filters follow from a rule (``filters``), not from a table. Recordings that are null,
unreadable, shorter than a fingerprint or silent have no integers and match nothing.
Repeated rows and rows without an id are recordings of their own (``common.numbered``); ties
between offsets go to the smaller shift, between recordings to the smaller id; an empty
table gives no rows; other columns are ignored.

A stated set of queries is looked up in the index of every block; ``match`` returns all
matches, ``lookups`` one row for each query with their number and the best one.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, shuffle_parts


@dataclass(frozen=True)
class Settings:
    rate: int = 5512
    frame: int = 2048
    hop: int = 682
    low_hz: float = 60.0
    high_hz: float = 2600.0
    #: quantiser steps, in logarithms of energy ratios
    step: float = 0.25
    least_overlap: int = 8
    most_errors: float = 0.15
    least_votes: int = 1
    block: int = 4096
    query_block: int = 128
    #: candidate offsets that are judged at a time, in positions; bounds a task's memory
    judged: int = 1 << 21


SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
TALL = 12


def filters() -> list[tuple[str, int, int, int]]:
    """(kind, first class, height, width in time): sixteen, from all kinds in turn at growing sizes.

    Kinds: left against right half, upper against lower half, diagonal quarters, middle against edges.
    """
    kinds, out = ("time", "pitch", "cross", "middle"), []
    for i in range(16):
        height = (2, 4, 6, 12)[i // 4]
        width = (4, 2, 6, 8)[(i + i // 4) % 4]
        out.append((kinds[i % 4], (5 * i) % (TALL - height + 1), height, width))
    return out


WIDEST = max(w for *_, w in filters())


def pitch_classes(s: Settings) -> np.ndarray:
    """(bins, 12): which class each spectrum bin counts for."""
    hz = np.fft.rfftfreq(s.frame, 1 / s.rate)
    out = np.zeros((len(hz), 12), np.float32)
    ok = (hz >= s.low_hz) & (hz <= s.high_hz)
    out[np.flatnonzero(ok), np.round(12 * np.log2(hz[ok] / 440)).astype(int) % 12] = 1
    return out


def chroma(audio: np.ndarray, s: Settings) -> np.ndarray:
    """(recordings, samples) to (recordings, times, 12), each frame of unit length, silence zero."""
    n_frames = (audio.shape[1] - s.frame) // s.hop + 1
    if n_frames < len(SMOOTH):
        return np.zeros((len(audio), 0, 12), np.float32)
    window = np.hamming(s.frame).astype(np.float32)
    fold = pitch_classes(s)
    raw = np.empty((len(audio), n_frames, 12), np.float32)
    for t in range(n_frames):
        spectrum = np.fft.rfft(audio[:, t * s.hop : t * s.hop + s.frame] * window, axis=1)
        raw[:, t] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ fold
    m = n_frames - len(SMOOTH) + 1
    smooth = sum(w * raw[:, k : k + m] for k, w in enumerate(SMOOTH))
    norm = np.sqrt((smooth**2).sum(2, keepdims=True))
    return np.where(norm > 1e-2, smooth / np.maximum(norm, 1e-9), 0).astype(np.float32)


def integers(picture: np.ndarray, s: Settings) -> np.ndarray:
    """(recordings, times, 12) to (recordings, positions) packed integers, by sums of areas."""
    n, t, _ = picture.shape
    m = t - WIDEST + 1
    if m < 1:
        return np.zeros((n, 0), np.uint32)
    area = np.zeros((n, t + 1, 13))
    area[:, 1:, 1:] = np.cumsum(np.cumsum(picture.astype(np.float64), 1), 2)

    def box(dx: int, w: int, y: int, h: int) -> np.ndarray:
        x0, x1 = area[:, dx : dx + m], area[:, dx + w : dx + w + m]
        return x1[:, :, y + h] - x0[:, :, y + h] - x1[:, :, y] + x0[:, :, y]

    out = np.zeros((n, m), np.uint32)
    for i, (kind, y, h, w) in enumerate(filters()):
        if kind == "time":
            a, b = box(0, w // 2, y, h), box(w // 2, w // 2, y, h)
        elif kind == "pitch":
            a, b = box(0, w, y, h // 2), box(0, w, y + h // 2, h // 2)
        elif kind == "cross":
            a = box(0, w // 2, y, h // 2) + box(w // 2, w // 2, y + h // 2, h // 2)
            b = box(w // 2, w // 2, y, h // 2) + box(0, w // 2, y + h // 2, h // 2)
        else:
            third = max(1, w // 3)
            a = box(third, max(1, w - 2 * third), y, h)
            b = box(0, third, y, h) + box(w - third, third, y, h)
        value = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (value > -s.step).astype(np.uint32) + (value > 0) + (value > s.step)
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * i)
    return out


def decode_wave(raw: bytes | None, rate: int) -> np.ndarray | None:
    """16-bit PCM in a WAVE container to mono samples at ``rate`` (linear resampling); unreadable: None."""
    if not raw:
        return None
    try:
        with wave.open(io.BytesIO(raw)) as w:
            if w.getsampwidth() != 2:
                return None
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32).reshape(-1, w.getnchannels()).mean(1) / 32768
            own = w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return None
    if own != rate and len(x):
        x = np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x).astype(np.float32)
    return x


def encode_wave(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def played(vectors: np.ndarray, s: Settings, seconds: float = 4.0) -> np.ndarray:
    """Sounds of numeric vectors: successive chords of eight tones whose loudness follows the components.

    For tables that hold no recordings: like vectors sound alike.
    """
    n, d = vectors.shape
    chords = -(-d // 8)
    v = np.zeros((n, chords * 8), np.float32)
    v[:, :d] = vectors
    each = int(seconds * s.rate / chords)
    tones = 220 * 2 ** (np.array([0, 2, 4, 5, 7, 9, 11, 13]) / 12)
    basis = np.sin(2 * np.pi * tones[:, None] * np.arange(each) / s.rate).astype(np.float32)
    loud = np.exp(6 * np.clip(v, -1, 1)) / 50
    return np.concatenate([loud[:, 8 * k : 8 * k + 8] @ basis for k in range(chords)], axis=1)


def fingerprints(rows: DataFrame, column: str, s: Settings = Settings(), decode: Callable | None = None) -> DataFrame:
    """(id, ``column``) rows to (k, id, fp binary): little-endian packed integers of each recording, ``k`` its row's own number.

    ``decode`` turns a list of the column's values into a list of sample arrays (or None); WAVE bytes by default.
    """

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                values = part.column(column).to_pylist()
                sounds = decode(values) if decode else [decode_wave(v, s.rate) for v in values]
                out: list[bytes] = [b""] * len(sounds)
                by: dict[int, list[int]] = {}
                for k, x in enumerate(sounds):
                    if x is not None and len(x) >= s.frame:
                        by.setdefault(len(x), []).append(k)
                for ks in by.values():
                    picture = chroma(np.stack([sounds[k] for k in ks]), s)
                    silent = (picture == 0).all((1, 2)) if picture.shape[1] else np.ones(len(ks), bool)
                    for k, fp, no in zip(ks, integers(picture, s), silent, strict=True):
                        out[k] = b"" if no else fp.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("id"), pa.array(out, pa.binary())], ["k", "id", "fp"])

    keyed = numbered(rows.select("id", column), "id").select("k", F.col("row.id").cast("long").alias("id"), F.col("row")[column].alias(column))
    return keyed.mapInArrow(run, "k long, id long, fp binary")


def decode_vectors(s: Settings) -> Callable:
    def decode(values: list) -> list:
        good = [k for k, v in enumerate(values) if v and all(x is not None and np.isfinite(x) for x in v)]
        out: list = [None] * len(values)
        sizes = {len(values[k]) for k in good}
        for d in sizes:
            ks = [k for k in good if len(values[k]) == d]
            for k, x in zip(ks, played(np.array([values[k] for k in ks], np.float32), s), strict=True):
                out[k] = x
        return out

    return decode


#: First bits of the 16-bit windows under which an integer is listed.
WINDOWS = (0, 8, 16, 24)


def window_of(codes: np.ndarray, shift: int) -> np.ndarray:
    turned = codes if not shift else (codes >> np.uint32(shift)) | (codes << np.uint32(32 - shift))
    return (turned & np.uint32(0xFFFF)).astype(np.uint16)


class Index:
    """The recordings of a block, and for each window the places of its values in order."""

    def __init__(self, fps: list[bytes]):
        self.size = np.array([len(f) // 4 for f in fps])
        self.codes = np.frombuffer(b"".join(fps), "<u4")
        self.first = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(fps)), self.size)
        self.place = np.arange(len(self.codes)) - self.first[self.owner]
        self.listed = []
        for shift in WINDOWS:
            value = window_of(self.codes, shift)
            order = np.argsort(value, kind="stable")
            self.listed.append((shift, order, np.searchsorted(value[order], np.arange((1 << 16) + 1))))

    def offsets(self, q: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(recording, offset, votes) of every offset with enough hits and overlap."""
        m = len(q)
        # a recording's offsets from 1 - m on are cells of one histogram
        base = np.cumsum(self.size + m - 1) - (self.size + m - 1)
        votes = np.zeros(int((self.size + m - 1).sum()), np.int32)
        for shift, order, begin in self.listed:
            value = window_of(q, shift)
            n = begin[value + np.int64(1)] - begin[value]
            at = order[np.repeat(begin[value] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            cell = base[self.owner[at]] + self.place[at] + (m - 1) - np.repeat(np.arange(m), n)
            votes += np.bincount(cell, minlength=len(votes)).astype(np.int32)
        hit = np.flatnonzero(votes >= s.least_votes)
        rec = np.searchsorted(base, hit, "right") - 1
        off = hit - base[rec] - (m - 1)
        wide = np.minimum(m, self.size[rec] - off) - np.maximum(0, -off) >= s.least_overlap
        return rec[wide], off[wide], votes[hit[wide]]

    def aligned(self, q: np.ndarray, s: Settings) -> np.ndarray:
        """Matches of one query: rows of recording, offset, votes, errors, overlap."""
        rec, off, votes = self.offsets(q, s)
        i, out = np.arange(len(q)), [np.zeros((0, 5))]
        step = max(1, s.judged // max(1, len(q)))
        for c in range(0, len(rec), step):
            r, d, v = rec[c : c + step], off[c : c + step], votes[c : c + step]
            at = i[None, :] + d[:, None]
            inside = (at >= 0) & (at < self.size[r][:, None])
            code = self.codes[np.where(inside, self.first[r][:, None] + at, 0)]
            overlap = inside.sum(1)
            errors = (np.bitwise_count(code ^ q[None, :]) * inside).sum(1) / (32 * overlap)
            ok = errors <= s.most_errors
            out.append(np.c_[r, d, v, errors, overlap][ok])
        m = np.concatenate(out)
        m = m[np.lexsort((m[:, 1], np.abs(m[:, 1]), m[:, 3], m[:, 0]))]
        return m[np.r_[True, m[1:, 0] != m[:-1, 0]]] if len(m) else m


MATCH = "query_k long, query_id long, match_id long, offset int, votes int, bit_errors double, overlap int"


def match(prints: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(k, id, fp) tables: (query_k, query_id, match_id, offset, votes, bit_errors, overlap) of every match but a row's own."""
    spark = prints.sparkSession
    some = prints.where("octet_length(fp) > 0")
    total = some.count()
    if not total:
        return spark.createDataFrame([], MATCH)
    n_blocks = -(-total // s.block)
    rows = some.select(F.pmod(F.xxhash64("k"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), F.array(F.struct("k", "id", "fp")).alias("rows"))
    asks = queries.where("octet_length(fp) > 0")
    # queries travel a few at a time, to every block
    packs = asks.groupBy(F.pmod(F.xxhash64("k"), F.lit(max(1, total // (100 * s.query_block)))).alias("pack")).agg(F.collect_list(F.struct("k", "id", "fp")).alias("rows"))
    packs = packs.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("asks"), "rows")
    met = rows.union(packs).repartitionById(max(n_blocks, shuffle_parts(spark)), "block").sortWithinPartitions("block", "asks")
    names = [x.split()[0] for x in MATCH.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())

    def run(batches):
        block, held, index, out = None, [], None, []
        for b in batches:
            for here, asks, rows in zip(*(b.column(x).to_pylist() for x in ("block", "asks", "rows")), strict=True):
                if here != block:
                    block, held, index = here, [], None
                if not asks:
                    held += rows
                    continue
                if not held:
                    continue
                index = index or Index([x["fp"] for x in held])
                for q in rows:
                    for r, d, v, errors, overlap in index.aligned(np.frombuffer(q["fp"], "<u4"), s).tolist():
                        if held[int(r)]["k"] != q["k"]:
                            out.append((q["k"], q["id"], held[int(r)]["id"], int(d), int(v), errors, int(overlap)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []

    return met.mapInArrow(run, MATCH)


def lookups(prints: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row for each query with a fingerprint.

    (query_id, n_links, best_id, offset, votes, bit_errors, overlap): the number of recordings within
    reach and, of those, the one with the fewest differing bits (none: null).
    """
    best = F.min(F.struct("bit_errors", "match_id", "offset", "votes", "overlap"))
    found = match(prints, queries, s).groupBy("query_k").agg(F.count("*").alias("n_links"), best.alias("best"))
    asked = queries.where("octet_length(fp) > 0").select(F.col("k").alias("query_k"), F.col("id").alias("query_id"))
    out = asked.join(found, "query_k", "left")
    return out.select("query_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("best.match_id").alias("best_id"), "best.offset", "best.votes", "best.bit_errors", "best.overlap")
