"""Toxicity by a subsequence string-kernel machine with Nystroem landmarks.

The kernel counts common subsequences of four characters, gaps allowed, each weighted
by ``decay`` to the power of its span (``max_span`` at most), so a character put into
an insult takes away only part of its weight; marks between letters and blanks between
single letters are read over, other marks count as blanks.

Training sentences are windows of labelled documents: the strings that a document's
label depends on are found by contrast between the classes and then, round by round,
as the windows that the machine scores highest (multiple-instance learning), with the
highest windows of clean documents as counter-examples. Instances are mapped to inner
products with the landmarks, whitened by the landmarks' own kernel matrix, and a
squared-hinge machine is fitted by Newton's method. The machine is linear in the
kernel, so all landmarks collapse into one weight for each subsequence, and scoring a
text costs one look-up for each start and gap pattern, whatever the number of landmarks.
A document's score is its highest window's, through a logistic fitted on training rows.

Learning takes a bounded sample of labelled rows (``Settings``). Scoring covers all bytes of
every text.

Defined cases: null and empty texts score as a text without any evidence; equal texts score
alike; a doc_id that labels hold more than once is toxic if one of them says so; null ids and
null labels teach nothing; without labels of both classes every score is the one class's; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .langid import fold

LETTERS, FOREIGN, DIGIT, BLANK, MARK, VOID = 26, 26, 27, 28, 29, 31


@dataclass(frozen=True)
class Settings:
    per_class: int = 2000
    max_train_bytes: int = 8_000
    max_word: int = 20
    landmarks: int = 224
    decay: float = 0.85
    max_span: int = 7
    window: int = 11
    rounds: int = 4
    penalty: float = 3e-4
    seed: int = 3
    #: changed copies of each toxic training text's window that the logistic is fitted with
    put_in: int = 0
    #: changed copies of each seed word that the machine learns from
    varied: int = 4
    long_per_class: int = 100
    max_long_bytes: int = 64_000


def classes() -> np.ndarray:
    """Character classes: each small letter, bytes of other letters, digits, blanks, marks."""
    t = np.full(256, MARK, np.uint8)
    t[97:123] = np.arange(26)
    t[128:] = FOREIGN
    t[48:58] = DIGIT
    t[[9, 10, 13, 32]] = BLANK
    return t


_CLASS = classes()


def patterns(s: Settings) -> list[tuple[tuple[int, int, int], float]]:
    """Offsets of the second to fourth character and the weight, for every span allowed."""
    out = []
    for a, b, c in product(range(1, s.max_span), repeat=3):
        if a + b + c < s.max_span:
            out.append(((a, a + b, a + b + c), s.decay ** (a + b + c + 1)))
    return out


def coded(data: np.ndarray) -> np.ndarray:
    return _CLASS[fold(data)]


def squeezed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes without the marks that stand between two letters and the blanks
    between two single letters, with the offsets that are left: ``i.d-i o t`` reads ``idiot``.
    """
    code = coded(data)
    n = len(code)
    if n < 3:
        return code, off
    edge = np.zeros(n + 2, bool)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = code <= FOREIGN
    edge[1:-1] = code == BLANK
    edge[[0, -1]] = True
    first = np.zeros(n + 1, bool)
    first[off] = True
    edge_after = edge[2:] | first[1:]
    between = letter[:-2] & letter[2:] & ~first[:-1] & ~first[1:]
    drop = between & (code == MARK)
    # a letter alone: a blank or the text's end on either side
    alone = letter[1:-1] & (edge[:-2] | first[:-1]) & edge_after
    drop[1:-1] |= (between & (code == BLANK))[1:-1] & alone[:-2] & alone[2:]
    code, off = code[~drop], off - np.concatenate([[0], np.cumsum(drop)])[off]
    # what marks are left part words as blanks do; a run of blanks is one
    code = np.where(code == MARK, np.uint8(BLANK), code)
    drop = np.zeros(len(code), bool)
    drop[1:] = (code[1:] == BLANK) & (code[:-1] == BLANK)
    drop[off[off < len(code)]] = False
    return code[~drop], off - np.concatenate([[0], np.cumsum(drop)])[off]


@dataclass
class Machine:
    settings: Settings
    weight: np.ndarray = field(default_factory=lambda: np.zeros(32**4, np.float32))
    slope: float = 1.0
    shift: float = 0.0

    def position_scores(self, code: np.ndarray) -> np.ndarray:
        """Weighted sum of the subsequences that start at each position."""
        n = len(code)
        c = np.concatenate([code, np.full(self.settings.max_span, VOID, np.uint8)]).astype(np.int32)
        c1, c2, c3 = c << 15, c << 10, c << 5
        out = np.zeros(n, np.float32)
        for (i, j, k), w in patterns(self.settings):
            at = c1[:n] | c2[i : i + n] | c3[j : j + n]
            at |= c[k : k + n]
            out += np.take(self.weight, at) * np.float32(w)
        return out

    def maxima(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest window sum of each text and where it begins; empty texts: 0 at their start.

        Texts are parted by void characters, so no subsequence crosses from one to the next.
        """
        s, n = self.settings, len(off) - 1
        own, off = squeezed(data, off)
        gap = s.window + s.max_span
        code = np.full(len(own) + gap * (n + 1), VOID, np.uint8)
        doc = np.repeat(np.arange(n), np.diff(off))
        to = np.arange(len(own)) + gap * (doc + 1)
        code[to] = own
        # texts begin and end as words do
        code[off[:-1] + gap * np.arange(1, n + 1) - 1] = BLANK
        code[off[1:] + gap * np.arange(1, n + 1)] = BLANK
        begin = off + gap * np.arange(n + 1)
        total = np.concatenate([[0.0], np.cumsum(self.position_scores(code), dtype=np.float64)])
        sums = np.zeros(len(code))
        w = s.window
        sums[: len(code) - w] = total[w : len(code)] - total[: len(code) - w]
        best = np.maximum.reduceat(sums, begin[:-1]) if n else np.zeros(0)
        return best, begin

    def best_windows(self, data: np.ndarray, off: np.ndarray) -> list[tuple[float, bytes]]:
        s, out = self.settings, []
        for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            x, _ = squeezed(data[i:j], np.array([0, j - i]))
            code = np.concatenate([[BLANK], x, np.full(s.window, BLANK)]).astype(np.uint8)
            p = np.concatenate([[0.0], np.cumsum(self.position_scores(code), dtype=np.float64)])
            sums = p[s.window :] - p[: -s.window]
            k = int(sums.argmax())
            out.append((float(sums[k]), code[k : k + s.window + s.max_span].tobytes()))
        return out

    def window_score(self, code: bytes) -> float:
        """Highest window sum of one coded string."""
        s = self.settings
        x = np.concatenate([np.frombuffer(code, np.uint8), np.full(s.window, VOID, np.uint8)])
        p = np.concatenate([[0.0], np.cumsum(self.position_scores(x), dtype=np.float64)])
        return float((p[s.window :] - p[: -s.window]).max())

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -40, 40)))


def features(instances: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(instances, patterns x positions) subsequence numbers, -1 where none, and the weight of each column."""
    width = max(map(len, instances))
    code = np.full((len(instances), width + s.max_span), VOID, np.int64)
    for i, x in enumerate(instances):
        code[i, : len(x)] = np.frombuffer(x, np.uint8)
    cols, weights = [], []
    for (i, j, k), w in patterns(s):
        f = code[:, :width] << 15 | code[:, i : i + width] << 10 | code[:, j : j + width] << 5 | code[:, k : k + width]
        f[(code[:, :width] == VOID) | (code[:, k : k + width] == VOID)] = -1
        cols.append(f)
        weights.append(np.full(width, w, np.float32))
    return np.concatenate(cols, 1), np.concatenate(weights)


class Landmarks:
    def __init__(self, chosen: list[bytes], s: Settings):
        f, w = features(chosen, s)
        self.s, self.known = s, np.unique(f[f >= 0])
        self.phi = np.zeros((len(chosen), len(self.known) + 1), np.float32)
        for i in range(f.shape[1]):
            ok = np.flatnonzero(f[:, i] >= 0)
            np.add.at(self.phi, (ok, np.searchsorted(self.known, f[ok, i])), w[i])
        gram = (self.phi @ self.phi.T).astype(np.float64)
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-6 * values.max()
        self.whiten = vectors[:, good] / np.sqrt(values[good])

    def inner(self, instances: list[bytes]) -> np.ndarray:
        """Whitened kernel values with the landmarks."""
        f, w = features(instances, self.s)
        at = np.searchsorted(self.known, f)
        at[at >= len(self.known)] = 0
        at[self.known[at] != f] = len(self.known)
        k = np.zeros((len(instances), len(self.phi)), np.float32)
        columns = np.ascontiguousarray(self.phi.T)
        for i in range(f.shape[1]):
            some = np.flatnonzero(at[:, i] < len(self.known))
            if len(some):
                k[some] += w[i] * columns[at[some, i]]
        return k @ self.whiten

    def collapse(self, beta: np.ndarray) -> np.ndarray:
        out = np.zeros(32**4, np.float32)
        out[self.known] = ((self.whiten @ beta) @ self.phi)[: len(self.known)]
        return out


def squared_hinge(x: np.ndarray, y: np.ndarray, importance: np.ndarray, penalty: float) -> np.ndarray:
    """Weights with the bias last: Newton steps on the active set until it settles."""
    a = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(a.shape[1])
    ridge = penalty * len(x) * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(25):
        live = y * (a @ w) < 1
        b = a[live] * importance[live, None]
        new = np.linalg.solve(b.T @ a[live] + ridge, b.T @ y[live])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def padded(word: bytes) -> bytes:
    return bytes([BLANK, *coded(np.frombuffer(word, np.uint8)).tolist(), BLANK])


def varied(x: bytes, rng: np.random.Generator) -> bytes:
    """The string with one character put in somewhere."""
    body = list(x[1:-1])
    if len(body) > 3:
        body.insert(int(rng.integers(1, len(body))), int(rng.integers(28)))
    return bytes([BLANK, *body, BLANK])


def put_in(code: bytes, rng: np.random.Generator) -> bytes:
    """The window with one letter or digit put in between two letters; unchanged if there are none."""
    x = np.frombuffer(code, np.uint8)
    between = np.flatnonzero((x[:-1] <= FOREIGN) & (x[1:] <= FOREIGN)) + 1
    if not len(between):
        return code
    k = int(rng.choice(between))
    return code[:k] + bytes([int(rng.integers(28))]) + code[k:]


def train(texts: list[bytes], toxic: np.ndarray, s: Settings = Settings()) -> Machine:
    """Fits the machine on whole labelled texts; with one class only, every score is that class's."""
    m = Machine(s)
    if not len(texts) or toxic.all() or not toxic.any():
        m.slope, m.shift = 0.0, (2.0 if len(texts) and toxic.all() else -2.0)
        return m
    rng = np.random.default_rng(s.seed)
    pos, neg = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        words = {w.strip(b".,;:!?\"'()[]|*$%&#") for w in re.split(rb"\s+", fold(np.frombuffer(t, np.uint8)).tobytes())}
        (pos if y else neg).update(w for w in words if 2 < len(w) <= s.max_word)
    n_pos, n_neg = int(toxic.sum()), int((~toxic).sum())
    odds = {w: np.log((c + 0.1) / (n_pos + 1)) - np.log((neg[w] + 0.5) / (n_neg + 1)) for w, c in pos.items() if c >= 4}
    ranked = sorted(((v * np.sqrt(pos[w]), w) for w, v in odds.items() if v > 1.6), reverse=True)
    seeds = [w for _, w in ranked[:160]] or [w for w, _ in pos.most_common(20)]
    common = sorted(neg)
    clean_words = [common[i] for i in rng.choice(len(common), min(len(common), 2500), replace=False)] + [w for w, _ in neg.most_common(600)] if common else [b"the"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    chosen = [padded(w) for w in seeds] + [padded(w) for w in clean_words[: max(16, s.landmarks - len(seeds))]]
    marks = Landmarks([x for x in dict.fromkeys(chosen) if len(x) > 3][: s.landmarks], s)
    good = [padded(w) for w in seeds for _ in range(min(6, 1 + pos[w] // 12))]
    gapped = [varied(padded(w), rng) for w in seeds for _ in range(s.varied)]
    bad = [padded(w) for w in clean_words]
    for r in range(s.rounds):
        x = marks.inner(good + gapped + bad)
        y = np.concatenate([np.ones(len(good) + len(gapped)), -np.ones(len(bad))])
        importance = np.concatenate([np.full(len(g), len(y) / (w * len(g))) for g, w in ((good, 3), (gapped, 6), (bad, 2))])
        beta = squared_hinge(x, y, importance, s.penalty)
        m.weight, bias = marks.collapse(beta[:-1]), beta[-1]
        if r < s.rounds - 1:
            tops = m.best_windows(data, off)
            # what a clean text's highest window holds is clean; a toxic text's counts once it is on the right side
            bad += [b for (v, b), t in zip(tops, toxic, strict=True) if not t]
            good += [b for (v, b), t in zip(tops, toxic, strict=True) if t and v + bias > 0]
    best = np.concatenate([m.maxima(data[off[i] : off[j]], off[i : j + 1] - off[i])[0] for i in range(0, len(texts), 64) for j in [min(i + 64, len(texts))]])
    # the same windows with a character put in count as positive too: the mark of 0.5 stands below both
    changed = [m.window_score(put_in(w, rng)) for (_, w), t in zip(m.best_windows(data, off), toxic, strict=True) if t for _ in range(s.put_in)]
    m.slope, m.shift = platt(np.r_[best, changed], np.r_[toxic, np.ones(len(changed), bool)])
    return m


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic in x by damped Newton steps; classes weigh alike."""
    scale = x.std() or 1.0
    z, w = np.c_[(x - x.mean()) / scale, np.ones(len(x))], np.zeros(2)
    share = np.where(y, 1.0, 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (share * (p - y)) + 1e-2 * w
        h = (z * (share * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    return float(w[0] / scale), float(w[1] - w[0] * x.mean() / scale)


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """A bounded sample of each class, lowest hash first: (doc_id, text, toxic, long).

    ``per_class`` texts of up to ``max_train_bytes`` and ``long_per_class`` longer ones, these
    with their first ``max_long_bytes``. Ids and lengths are joined first; the texts of the
    sample's ids, whose number is bounded, by a broadcast.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    sized = docs.where("text is not null").groupBy("doc_id").agg((F.max(F.octet_length("text")) > s.max_train_bytes).alias("long"))
    known = one.join(sized, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [known.where((F.col("toxic") == y) & (F.col("long") == far)).orderBy(*order).limit(s.long_per_class if far else s.per_class) for y in (1, 0) for far in (False, True)]
    ids = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    return texts.select("doc_id", F.when(F.col("long"), F.substring("text", 1, s.max_long_bytes)).otherwise(F.col("text")).alias("text"), "toxic", "long")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Machine:
    """Longer texts say less about where their label comes from: they fill a class up to ``long_per_class`` texts only."""
    got = sorted((r.long, r.doc_id, r.text, r.toxic == 1) for r in training_rows(docs, labels, settings).collect())
    rows: list[tuple] = []
    for y in (True, False):
        mine = [r for r in got if r[3] == y]
        short = sum(not r[0] for r in mine)
        rows += mine[: max(short, min(len(mine), settings.long_per_class))]
    rows.sort(key=lambda r: r[1])
    return train([r[2].encode() for r in rows], np.array([r[3] for r in rows], bool), settings)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for every row. Null texts count as empty and score as a text without any evidence."""

    def run(batches):
        for data, off, _, rows in text_slices(batches):
            best, _ = machine.maxima(data, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(machine.probability(best))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")

