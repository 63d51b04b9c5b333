"""Exact top-k inner products by a score-at-a-time index ordered by impact.

Vectors are quantised to integers. The index of a block of candidates orders its postings
(row, dimension, value) by descending impact level (absolute value) and cuts them into
bands of whole levels, each laid out as a matrix of its values. A block of queries takes
the bands in turn and adds each to all accumulators at once. What a candidate still has to
come is bounded from the norm of its postings in later bands and the level reached, so
after each band the accumulators give a lower and an upper bound of every score. When the
candidates whose upper bound reaches the k-th best lower bound are few enough to score
directly, no other row can be a member - that is the proof on which processing stops - and
the possible members are scored exactly.

Sums are exact where the largest possible one is an exactly representable whole number
(below 2**24 in single, 2**53 in double precision); beyond, the bounds are widened by the
rounding error's own bound and members are scored in whole numbers of any size. A score
beyond a long is held at its bounds, and such scores tie.

The stated query set meets all rows block by block: packs of queries are dealt to every
block's task, never row by row. Each meeting returns k rows a query, merged by a window
whose limit is applied before its shuffle.

Rows whose vector is null or holds null or non-finite components take no part, an empty
vector scores 0 with all, and of vectors of different lengths the components that both have
count. Ties go to the smaller id; repeated rows are candidates each and only rows with the
query's own id are left out; rows without an id take no part; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts


@dataclass(frozen=True)
class Settings:
    k: int = 20
    scale: int = 64
    block: int = 8192
    query_block: int = 512
    #: levels are taken in bands that hold about this share of the impact mass
    bands: int = 6
    direct: int = 256
    #: numbers in a pack of vectors; bounds a task's memory for long ones
    cells: int = 1 << 22


#: Whole numbers below these are exact in single and double precision.
SINGLE, DOUBLE, LONG = 2.0**24, 2.0**53, 2**63 - 1


class Index:
    """Bands of postings of one block of like long vectors, by descending level."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bands: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order].astype(np.float64)
        size = np.abs(self.v)
        self.top = float(size.max(initial=0))
        rows, dims = np.nonzero(size)
        level = size[rows, dims]
        by = np.lexsort((rows, dims, -level))
        rows, dims, level = rows[by], dims[by], level[by]
        self.norm = np.sqrt((size * size).sum(1)) * (1 + 1e-9)
        #: (values of the band, norms of the postings of later bands, level of the next)
        self.bands: list[tuple[np.ndarray, np.ndarray, float]] = []
        later = size.copy()
        for a, b in _cuts(level, bands):
            part = np.zeros_like(self.v)
            part[rows[a:b], dims[a:b]] = self.v[rows[a:b], dims[a:b]]
            later[rows[a:b], dims[a:b]] = 0
            self.bands.append((part, np.sqrt((later * later).sum(1)) * (1 + 1e-9), float(level[b]) if b < len(level) else 0.0))

    def search(self, q_ids: np.ndarray, q: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score), k a query at most, own id left out."""
        width = min(q.shape[1], self.v.shape[1])
        q, n = q[:, :width].astype(np.float64), len(self.v)
        own = np.searchsorted(self.ids, q_ids, "right") - np.searchsorted(self.ids, q_ids)
        q_norm, q_sum = np.sqrt((q * q).sum(1)) * (1 + 1e-9), np.abs(q).sum(1)
        most = q_sum * self.top
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for rows, kind, slack in ((most < SINGLE, np.float32, 0.0), ((most >= SINGLE) & (most < DOUBLE), np.float64, 0.0), ((most >= DOUBLE) & (most < LONG), np.float64, (width + 8) * 2.0**-52)):
            for live, possible in self._proved(np.flatnonzero(rows), q, q_norm, q_sum, own, kind, slack, width, s):
                out.append(self._exact(live, q_ids[live], q[live], np.flatnonzero(possible), width, s.k))
        for row in np.flatnonzero(~(most < LONG)):  # scores may be held at a long's bounds: all are looked at
            out.append(self._exact(row, q_ids[row], q[row], np.arange(n), width, s.k))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _proved(self, live: np.ndarray, q: np.ndarray, q_norm: np.ndarray, q_sum: np.ndarray, own: np.ndarray, kind: type, slack: float, width: int, s: Settings):
        """(query row, candidates that may be members), as soon as they are few or nothing is left to come."""
        n = len(self.v)
        acc = np.zeros((len(live), n), kind)
        for part, later, left in self.bands:
            if not len(live):
                return
            acc += q[live].astype(kind) @ part[:, :width].astype(kind).T
            rest = np.minimum(q_norm[live, None] * later, (q_sum[live] * left)[:, None]) + slack * q_norm[live, None] * self.norm
            low = acc - rest
            possible = np.empty(acc.shape, bool)
            # the query's own rows may be among the best
            k = np.minimum(s.k + own[live], n)
            for size in np.unique(k):
                some = k == size
                kth = np.partition(low[some], n - size, axis=1)[:, n - size]
                possible[some] = acc[some] + rest[some] >= kth[:, None]
            few = possible.sum(1) <= (s.direct if left else n)
            yield from zip(live[few], possible[few], strict=True)
            live, acc = live[~few], acc[~few]
        for row in live:  # no impact at all: every score is 0
            yield row, np.ones(n, bool)

    def _exact(self, row: int, own: int, q: np.ndarray, at: np.ndarray, width: int, k: int):
        at = at[self.ids[at] != own]
        v = self.v[at, :width]
        if np.abs(q).sum() * self.top < DOUBLE:
            score = (v @ q).astype(np.int64)
        else:
            whole = [int(x) for x in q.tolist()]
            score = np.array([max(-LONG, min(LONG, sum(int(a) * b for a, b in zip(x, whole, strict=True)))) for x in v.tolist()], np.int64)
        best = np.lexsort((self.ids[at], -score))[:k]
        return np.full(len(best), row), self.ids[at[best]], score[best]


def _cuts(level: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Bands of whole levels, each with about half of the squared impact that is left."""
    if not len(level):
        return []
    mass, cuts = np.cumsum(level**2), [0]
    for i in range(1, n):
        at = min(int(np.searchsorted(mass, mass[-1] * (1 - 0.5**i))), len(level) - 1)
        end = int(np.searchsorted(-level, -level[at], "right"))
        if end > cuts[-1]:
            cuts.append(end)
    if cuts[-1] < len(level):
        cuts.append(len(level))
    return [*zip(cuts, cuts[1:], strict=False)]


def quantised(embedding: str | Column, scale: int) -> Column:
    """floor(scale * x) as whole numbers in an array<double>; null where a component is null or not finite.

    A component whose product passes 2**53 is a whole number already, so none overflows.
    """
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    return F.when(e.isNotNull() & ~bad, F.transform(e, lambda x: F.when(F.abs(scaled(x)) < F.lit(DOUBLE), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))))


PACK = "n int, width int, kind string, ids binary, v binary"


def packed(rows: DataFrame, cells: int) -> DataFrame:
    """(id, v) rows to packs of like long vectors, ``cells`` numbers at most, within their partitions."""

    def run(batches):
        held: dict[int, list[tuple[int, list]]] = {}

        def pack(width):
            some = held.pop(width)
            v = np.array([x for _, x in some], np.float64).reshape(len(some), width)
            top = np.abs(v).max(initial=0)
            kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
            cols = ([len(some)], [width], [kind], [np.array([x for x, _ in some], "<i8").tobytes()], [v.astype(kind).tobytes()])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["n", "width", "kind", "ids", "v"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) * len(v) >= cells:
                    yield pack(len(v))
        for width in [*held]:
            yield pack(width)

    return rows.select("id", "v").mapInArrow(run, PACK)


def search(candidates: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(id long, v array<double>) tables: (query_id, rank, vec_id, score), the k best candidates of each query."""
    spark = candidates.sparkSession
    parts = shuffle_parts(spark)
    total = candidates.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks = -(-total // s.block)
    n_packs = max(1, -(-total // (20 * s.query_block)))
    # by the row's own number, not its id: equal ids are dealt out too
    dealt = lambda rows, n: rows.withColumn("to", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")).repartitionById(n, "to")
    # a block holds vectors of the common length in one pack; longer ones come in more packs
    c = packed(dealt(candidates, n_blocks), s.cells).select(F.spark_partition_id().alias("part"), F.lit(0).alias("asks"), "n", "width", "kind", "ids", "v")
    q = packed(dealt(queries, n_packs), s.cells).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("part"), F.lit(1).alias("asks"), "n", "width", "kind", "ids", "v")
    met = c.union(q).repartitionById(max(n_blocks, parts), "part").sortWithinPartitions("part", "asks")

    def run(batches):
        last, held = None, []
        for b in batches:
            for part, asks, n, width, kind, ids, v in zip(*(b.column(x).to_pylist() for x in ("part", "asks", "n", "width", "kind", "ids", "v")), strict=True):
                if part != last:
                    last, held = part, []
                own, matrix = np.frombuffer(ids, "<i8"), np.frombuffer(v, kind).reshape(n, width)
                if not asks:
                    held.append(Index(own, matrix, s.bands))
                    continue
                for index in held:
                    for i in range(0, n, s.query_block):
                        row, vec, score = index.search(own[i : i + s.query_block], matrix[i : i + s.query_block], s)
                        yield pa.RecordBatch.from_arrays([pa.array(own[i : i + s.query_block][row]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
