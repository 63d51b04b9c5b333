"""Alignment of two tokenizers over the same bytes, and counts of the id pairs that it links.

Each text is read as a space and the text: by a byte-level BPE vocabulary (A), and by a
sentence-piece model (B), which adds the space itself. Ends of tokens are cumulative
sums of their lengths in bytes; ends that both have cut the text into groups; a
token's group is where its end falls among the cuts. As every text ends with a cut, the
arrays of many texts are laid end to end and worked on at once. Within a group every
token of A is linked with every token of B.

Spark counts the documents that hold a pair: documents are tokenised once, in blocks of
bounded size that keep their distinct pairs, and for each document the places of its
pairs among those; the blocks are written to the shared folder. The blocks' counts are
summed by (pair, salt), then by pair, so a pair that every block holds is never one
task's work. Each block then gets the counts of its own pairs, not of the corpus, and
sums them for its documents. What is broadcast is one row for each id of A.

Texts that are null or empty, or whose tokens' bytes aren't a space and the text, have
no tokens: zeros and an empty digest. Strings of special tokens are plain text. Repeated
rows count as documents of their own, so do rows with a null doc_id; other columns are
ignored; an empty table gives no row. A long text is worked on whole, its pairs a
bounded number at a time; groups with many tokens on both sides are first reduced to
their distinct ids with their multiplicity.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ensure_checkpoint_dir, text_slices


@dataclass(frozen=True)
class Settings:
    #: bytes of text after which a block ends
    block: int = 8 << 20
    salts: int = 16


#: Links that are written out at a time, and those of one group beyond which its ids are counted first.
EXPANDED, WIDE = 1 << 22, 1 << 12


class PieceModel:
    """The sentence-piece model with the bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.model.id_to_piece
        self.bytes_of = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = self.model.encode(texts, num_threads=1)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum())), count


class Aligner:
    """Both vocabularies; works on slices of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, native=True), PieceModel(path_b)
        self.bytes_a, self.bytes_b = self.a.merges.bytes_of, self.b.bytes_of
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.bits_a, self.bits_b = (max(1, (len(t) - 1).bit_length()) for t in (self.bytes_a, self.bytes_b))
        ids = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], "S")
        self.digits = ids.view(np.uint8).reshape(len(ids), -1)

    def key(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (doc << self.bits_a | a) << self.bits_b | b

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, count for each text, ids of B, count for each text); none where the bytes don't come back."""
        lengths = np.diff(off)
        spaced = np.insert(data, off[:-1], 32)
        at = off + np.arange(len(off))
        a, na = self.a.encode(spaced, at, specials=False)
        raw = spaced.tobytes()
        b, nb = self.b.encode([raw[i + 1 : j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        good = lengths > 0
        for ids, count, table, size in ((a, na, self.bytes_a, self.size_a), (b, nb, self.bytes_b, self.size_b)):
            end = np.cumsum(count)
            total = np.r_[0, np.cumsum(size[ids])]
            good &= total[end] - total[end - count] == lengths + 1
            for k in np.flatnonzero(good).tolist():
                good[k] = b"".join([table[i] for i in ids[end[k] - count[k] : end[k]].tolist()]) == raw[at[k] : at[k + 1]]
        return a[np.repeat(good, na)], np.where(good, na, 0), b[np.repeat(good, nb)], np.where(good, nb, 0)

    def slice(self, data: np.ndarray, off: np.ndarray) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """(figures of each text, digests of their groups, sorted keys of (text, a, b), number of links of each key)."""
        a, na, b, nb = self.tokens(data, off)
        n = len(na)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        # a text's last token ends with its last group
        text_of = np.searchsorted(np.cumsum(na), last_a - 1, "right")
        per_text = lambda x: np.bincount(text_of, x, n).astype(np.int64) if len(x) else np.zeros(n, np.int64)
        figures = {"n_a": na, "n_b": nb, "n_groups": np.bincount(text_of, minlength=n) if len(cuts) else np.zeros(n, np.int64), "n_links": per_text(in_a * in_b)}
        shas = self.digests(a, b, of_a, of_b, last_a, last_b, na + nb)
        keys, weight = self.links(a, b, text_of, in_a, in_b, last_a, last_b)
        return figures, shas, keys, weight

    def digests(self, a, b, of_a, of_b, last_a, last_b, count) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` for each text; each id is a row of digits with what follows it."""
        place_a = np.arange(len(a)) + np.r_[0, last_b][of_a]
        place_b = np.arange(len(b)) + last_a[of_b] if len(b) else np.zeros(0, np.int64)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        rows = np.empty((len(ids), self.digits.shape[1] + 1), np.uint8)
        rows[:, :-1], rows[:, -1] = self.digits[ids], ord(",")
        end = np.cumsum(count)
        if len(ids):
            rows[place_a[last_a - 1], -1], rows[place_b[last_b - 1], -1] = ord("|"), ord(";")
            rows[end[count > 0] - 1, -1] = 0
        return [sha256(rows[i - k : i].tobytes().translate(None, b"\0")).hexdigest() if k else "" for i, k in zip(end.tolist(), count.tolist(), strict=True)]

    def links(self, a, b, text_of, in_a, in_b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys with their number of links, sorted."""
        a, b, made = a.astype(np.int64), b.astype(np.int64), in_a * in_b
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        narrow = np.flatnonzero(made <= WIDE)
        before = np.cumsum(made[narrow])
        i = 0
        while i < len(narrow):
            j = max(i + 1, int(np.searchsorted(before, (before[i - 1] if i else 0) + EXPANDED, "right")))
            g = narrow[i:j]
            # each token of A as often as its group has tokens of B, beside those in turn
            which = np.repeat(np.arange(len(g)), in_a[g])
            rank = np.arange(len(which)) - np.repeat(np.cumsum(in_a[g]) - in_a[g], in_a[g])
            times = in_b[g][which]
            left = np.repeat((last_a[g] - in_a[g])[which] + rank, times)
            turn = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
            right = np.repeat((last_b[g] - in_b[g])[which], times) + turn
            parts.append(np.unique(self.key(np.repeat(text_of[g][which], times), a[left], b[right]), return_counts=True))
            i = j
        for g in np.flatnonzero(made > WIDE).tolist():
            ids_a, times_a = np.unique(a[last_a[g] - in_a[g] : last_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[last_b[g] - in_b[g] : last_b[g]], return_counts=True)
            parts.append((self.key(text_of[g], ids_a[:, None], ids_b[None]).ravel(), (times_a[:, None] * times_b).ravel()))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(parts) == 1:
            return parts[0]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        weight = np.zeros(len(keys), np.int64)
        np.add.at(weight, at, np.concatenate([w for _, w in parts]))
        return keys, weight


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
ROWS = f"array<struct<doc_id: long, {', '.join(f'{f}: long' for f in FIGURES)}, n_pairs: long, groups_sha256: string>>"
ROW_KIND = pa.struct([("doc_id", pa.int64()), *((f, pa.int64()) for f in FIGURES), ("n_pairs", pa.int64()), ("groups_sha256", pa.string())])


def blocks(docs: DataFrame, path_a: str, path_b: str, s: Settings) -> DataFrame:
    """(block, pairs array, held array: texts of the block with each pair, rows of its texts, at, links).

    ``at`` and ``links`` are compressed arrays: the place among the pairs and the number
    of links of each pair of each text in turn.
    """

    def run(batches):
        from pyspark import TaskContext

        al = aligner(path_a, path_b)
        low = (1 << al.bits_a + al.bits_b) - 1
        block, size, rows, keys, links = TaskContext.get().partitionId() << 32, 0, [], [], []

        def made() -> pa.RecordBatch:
            pair = np.concatenate(keys) & low
            pairs, at, held = np.unique(pair, return_inverse=True, return_counts=True)
            packed = [pa.compress(x.astype("<i8").tobytes(), "zstd", asbytes=True) for x in (at, np.concatenate(links))]
            cols = [pa.array([block]), pa.array([pairs]), pa.array([held]), pa.array([rows], pa.list_(ROW_KIND)), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(cols, ["block", "pairs", "held", "rows", "at", "links"])

        for data, off, _, batch in text_slices(batches):
            figures, shas, k, w = al.slice(data, off)
            n_pairs = np.bincount(k >> al.bits_a + al.bits_b, minlength=len(shas))
            lists = [batch.column("doc_id").to_pylist(), *(figures[f].tolist() for f in FIGURES), n_pairs.tolist(), shas]
            rows += [dict(zip(ROW_KIND.names, x, strict=True)) for x in zip(*lists, strict=True)]
            keys.append(k)
            links.append(w)
            size += len(data)
            if size >= s.block:
                yield made()
                block, size, rows, keys, links = block + 1, 0, [], [], []
        if rows:
            yield made()

    fields = f"block long, pairs array<long>, held array<long>, rows {ROWS}, at binary, links binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, fields)


def pair_counts(pairs: DataFrame, bits_b: int, s: Settings) -> DataFrame:
    """(pair, a, n): documents of the corpus that hold each pair, from (block, pair, held)."""
    salted = pairs.groupBy("pair", F.pmod(F.hash("block"), F.lit(s.salts)).alias("salt")).agg(F.sum("held").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", F.shiftright("pair", bits_b).alias("a"), "n")


def alignments(docs: DataFrame, path_a: str, path_b: str, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    bits_b = aligner(path_a, path_b).bits_b
    made = blocks(docs, path_a, path_b, s).checkpoint()
    pairs = made.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = pair_counts(pairs, bits_b, s).checkpoint()
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # as many rows as A has ids at most
    told = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = pairs.select("block", "pair").join(told, "pair").select("block", "pair", "n", "best")

    def summed(counted: pa.Table, block: pa.Table) -> pa.Table:
        rows = pa.RecordBatch.from_struct_array(pa.concat_arrays(block.column("rows").chunks).flatten())
        ends = np.r_[0, np.cumsum(rows.column("n_pairs").to_numpy())]
        at, links = (np.frombuffer(pa.decompress(block.column(c)[0].as_py(), 8 * int(ends[-1]), "zstd", asbytes=True), "<i8") for c in ("at", "links"))
        names = ["doc_id", *FIGURES]
        sums = [np.zeros(len(rows), np.int64)] * 2
        if len(at):
            order = np.argsort(counted.column("pair").to_numpy())
            each = (counted.column(c).to_numpy()[order].astype(np.int64)[at] for c in ("best", "n"))
            upto = (np.r_[0, np.cumsum(links * x)][ends] for x in each)
            sums = [np.diff(x) for x in upto]
        return pa.table([*(rows.column(c) for c in names), *(pa.array(x) for x in sums), rows.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    payload = made.select(F.col("block").alias("of"), "rows", "at", "links")
    out = f"doc_id long, {', '.join(f'{f} long' for f in FIGURES)}, n_best long, count_sum long, groups_sha256 string"
    return asked.groupBy("block").cogroup(payload.groupBy("of")).applyInArrow(summed, out)
