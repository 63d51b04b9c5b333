"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent passes, one in each direction, read the lower-cased bytes of a text in
segments; their states give every byte position a distribution over languages, and a
document's distribution is the mean over all positions of its whole text. The weights
are learned here, in numpy, by backpropagation through time with Adam.

Learning takes a bounded sample: at most ``per_language`` stretches of ``train_bytes``
bytes for each language (``per_document`` of a document), spread by a hash over all
labelled documents. The sample grows with the number of languages that the labels name.

Defined cases: null texts and texts without a letter are ``und`` with score 0; equal texts are
predicted alike, and repeated rows give a row each; of languages with the same probability the
first by name is told; null and repeated doc_ids are rows like any other (``held_out`` of a null
doc_id is null: such a row is predicted and teaches nothing where a query learns by it); a text of
any length is read whole, a segment of each stretch at a time, but lies in memory while it is; an
empty table gives no rows, one without two languages a model that says ``und``; other columns are
ignored or kept as asked.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import given_back, text_slices

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    hidden: int = 6
    segment: int = 128
    per_language: int = 1500
    train_bytes: int = 96
    epochs: int = 9
    least_updates: int = 400
    per_document: int = 3
    batch: int = 128
    rate: float = 0.02
    seed: int = 5


def lower_table() -> np.ndarray:
    """ASCII capitals to small letters; the second byte of Latin-1 capitals is handled in ``fold``."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


_LOWER = lower_table()


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented capitals U+00C0 to U+00DE, byte for byte."""
    out = _LOWER[data]
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    return out


class Network:
    """Parameters of both directions; layout (3H, N) keeps each gate contiguous.

    r = s(x), z = s(x), n = tanh(x_n + r * (U_n h)); h' = n + z * (h - n).
    """

    def __init__(self, hidden: int, classes: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = hidden
        self.h, self.c = h, classes
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((3 * h, 256)) * 0.3).astype(np.float32)
            self.p["u" + d] = (rng.standard_normal((3 * h, h)) / np.sqrt(h)).astype(np.float32)
        self.p["o"] = (rng.standard_normal((classes, 2 * h)) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros((classes, 1), np.float32)

    def forward(self, steps: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """steps (T, N) bytes to states (T, 2H, N)."""
        t_len, n = steps.shape
        h = self.h
        states = np.empty((t_len, 2 * h, n), np.float32)
        trace: dict[str, list] = {"f": [], "b": []}
        for d, order, at in (("f", range(t_len), slice(0, h)), ("b", range(t_len - 1, -1, -1), slice(h, 2 * h))):
            # gates use tanh: s(x) = (1 + tanh(x / 2)) / 2, so the halves are put in the weights
            x, u = self.p["x" + d].copy(), self.p["u" + d].copy()
            x[: 2 * h] *= 0.5
            u[: 2 * h] *= 0.5
            s = np.zeros((h, n), np.float32)
            for t in order:
                g = np.take(x, steps[t], axis=1)
                a = u @ s
                rz = g[: 2 * h]
                rz += a[: 2 * h]
                np.tanh(rz, out=rz)
                rz += 1
                rz *= 0.5
                m = g[2 * h :]
                un = a[2 * h :]
                m += rz[:h] * un
                np.tanh(m, out=m)
                new = s - m
                new *= rz[h:]
                new += m
                if keep:
                    trace[d].append((t, s, rz, m, un))
                s = new
                states[t, at] = s
        return states, trace

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, C, N)."""
        z = np.matmul(self.p["o"], states) + self.p["c"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def gradients(self, steps: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross entropy of every position against the segment's language, through time."""
        t_len, n = steps.shape
        h = self.h
        states, trace = self.forward(steps, keep=True)
        pr = self.probabilities(states)
        loss = float(-np.log(pr[:, y, np.arange(n)] + 1e-9).mean())
        dz = pr
        dz[:, y, np.arange(n)] -= 1
        dz /= t_len * n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.einsum("tcn,thn->ch", dz, states, optimize=True)
        g["c"] = dz.sum((0, 2))[:, None]
        ds = np.matmul(self.p["o"].T, dz)
        for d, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, carry = self.p["u" + d], np.zeros((h, n), np.float32)
            gx, onehot_g, bytes_seen = g["x" + d], [], []
            for t, s, rz, m, un in reversed(trace[d]):
                dh = ds[t, at] + carry
                r, z = rz[:h], rz[h:]
                dm = dh * (1 - z) * (1 - m * m)
                da = np.empty((3 * h, n), np.float32)
                da[:h] = dm * un * r * (1 - r)
                da[h : 2 * h] = dh * (s - m) * z * (1 - z)
                da[2 * h :] = dm
                du = da.copy()
                du[2 * h :] *= r
                g["u" + d] += du @ s.T
                carry = dh * z + u.T @ du
                onehot_g.append(da)
                bytes_seen.append(steps[t])
            flat, seen = np.concatenate(onehot_g, 1), np.concatenate(bytes_seen)
            for k in range(3 * h):
                gx[k] = np.bincount(seen, flat[k], 256)
        return loss, g

    def train(self, segments: np.ndarray, y: np.ndarray, s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        n, t = len(y), 0
        # small samples are gone over more often
        epochs = max(s.epochs, -(-s.least_updates // max(1, -(-n // s.batch))))
        total = max(1, epochs * -(-n // s.batch))
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, s.batch):
                some = order[i : i + s.batch]
                _, g = self.gradients(np.ascontiguousarray(segments[some].T), y[some])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                t += 1
                rate = s.rate * (1 - t / total) + 1e-4
                for k, v in g.items():
                    v = v / max(1.0, norm)
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.01 * (v * v - m2[k])
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    network: Network | None
    settings: Settings

    def predict(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(documents, languages): the mean over all byte positions of each whole text."""
        n_docs, n_lang = len(off) - 1, len(self.languages)
        if self.network is None or not n_lang:
            return np.full((n_docs, max(n_lang, 1)), 1.0)
        size, seg = np.diff(off), self.settings.segment
        parts = -(-size // seg)
        doc = np.repeat(np.arange(n_docs), parts)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        # a text's segments are of equal length, so the last one isn't a stub
        each = -(-size // np.maximum(parts, 1))[doc]
        begin, end = off[:-1][doc] + k * each, np.minimum(off[:-1][doc] + (k + 1) * each, off[1:][doc])
        low = fold(data)
        sums = np.zeros((n_docs, n_lang))
        length = np.maximum(end - begin, 0)
        order = np.argsort(length, kind="stable")
        for i in range(0, len(order), 1024):
            some = order[i : i + 1024]
            t_len = int(length[some].max())
            if not t_len:
                continue
            at = begin[some] + np.arange(t_len)[:, None]
            inside = at < end[some]
            steps = np.where(inside, low[np.minimum(at, len(low) - 1)], 32).astype(np.uint8)
            states, _ = self.network.forward(steps)
            pr = self.network.probabilities(states)
            pooled = np.einsum("tcn,tn->nc", pr, inside.astype(np.float32), optimize=True)
            np.add.at(sums, doc[some], pooled)
        return sums / np.maximum(size, 1)[:, None]


#: Parts in which a language's stretches are compared before they meet.
SALTS = 64


def training_sample(docs: DataFrame, s: Settings) -> DataFrame:
    """At most per_language stretches (lang, h, piece) for each language, lowest hash first.

    Each task keeps its own lowest first, then each of ``SALTS`` parts of a language, so what meets at a language is no more
    than that many times ``per_language``, however many tasks there are.
    """

    def run(batches):
        best: dict[str, list[tuple[int, bytes]]] = {}
        for data, off, _, rows in text_slices(batches):
            for doc, lang, i, j in zip(rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                if j - i < 8:
                    continue
                for part in range(s.per_document):
                    h = zlib.crc32(f"{doc}:sample:{part}".encode())
                    at = i + h % max(1, j - i - s.train_bytes + 1)
                    best.setdefault(lang, []).append((h, data[at : min(at + s.train_bytes, j)].tobytes()))
            for lang, x in best.items():
                best[lang] = sorted(x)[: s.per_language]
        rows = [(lang, h, p) for lang, x in best.items() for h, p in x]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["lang", "h", "piece"])

    some = docs.select("doc_id", "text", "lang").mapInArrow(run, "lang string, h long, piece binary")
    for parts in (["lang", F.pmod(F.xxhash64("h", "piece"), F.lit(SALTS))], ["lang"]):
        w = Window.partitionBy(*parts).orderBy("h", "piece")
        some = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= s.per_language).drop("k")
    return some


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from (doc_id, text, lang) rows with text and lang not null; no rows: a model that says ``und``."""
    rows = sorted((r.lang, r.h, bytes(r.piece)) for r in training_sample(docs.where("text is not null and lang is not null"), settings).collect())
    languages = sorted({r[0] for r in rows})
    if len(languages) < 2:
        return Model(languages, None, settings)
    t_len = settings.train_bytes
    seg = np.full((len(rows), t_len), 32, np.uint8)
    for i, r in enumerate(rows):
        seg[i, : len(r[2])] = fold(np.frombuffer(r[2], np.uint8))
    y = np.array([languages.index(r[0]) for r in rows])
    net = Network(settings.hidden, len(languages), settings.seed)
    net.train(seg, y, settings)
    return Model(languages, net, settings)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``keep`` columns (doc_id by default) with the language and its score under ``names``.

    ``und`` with score 0 where the text is null or has no letter. A map over the rows: nothing is shuffled.
    """
    keep = keep or ["doc_id"]
    fields = [f for f in docs.schema.fields if f.name in keep]
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        from .bpe import LETTER, char_classes

        for data, off, null, rows in text_slices(batches):
            pr = model.predict(data, off)
            best = pr.argmax(1)
            code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            letters = np.r_[0, np.cumsum(char_classes()[code] == LETTER)][np.searchsorted(lead, off)]
            none = null | (np.diff(letters) == 0)
            if not model.languages:
                none[:] = True
            every = np.array([*model.languages, UNDETERMINED], object)
            pred = every[np.where(none, len(every) - 1, best)]
            score = np.where(none, 0.0, np.clip(pr[np.arange(len(best)), best], 0, 1))
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in fields), pa.array(pred.tolist(), pa.string()), pa.array(score)], [f.name for f in out.fields])

    return docs.select(*dict.fromkeys([*(f.name for f in fields), "text"])).mapInArrow(given_back(run), out)


def held_out(column: str = "doc_id", mod: int = 4, rest: int = 2):
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod == rest
