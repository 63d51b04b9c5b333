"""Pieces that several operators share: table access, batching, hashing, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoints

#: Bytes of text that one kernel call works on; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; see ``session.ensure_checkpoints``."""
    ensure_checkpoints(spark)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(k, row): every row as a struct, with a long that is its own and follows ``order``, nulls first.

    Where ``order`` is never null and never repeats it is the number itself; finding that
    out shuffles that column's counts only. Else the rows are sorted by it across the
    cluster, rows of one value by their text and then by where they were read, and written
    to the shared folder, so that the numbers stay: no two rows fall together, and a value
    that a third of all rows have is spread over many tasks.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    odd = docs.groupBy(F.col(order).alias("x")).agg(F.count("*").alias("n")).where("n > 1 or x is null")
    if odd.isEmpty():
        # never null, and said to be so: no filter parts the plans that share it
        return rows.select(F.coalesce(F.col("row")[order].cast("long"), F.lit(0)).alias("k"), "row")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.col("row.text").cast("string") if "text" in docs.columns else F.lit("")
    keys = [F.col("row")[order].asc_nulls_first(), F.xxhash64(text), F.col("read")]
    spread = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(max(2, shuffle_parts(spark)), *keys).sortWithinPartitions(*keys)
    return spread.select(F.monotonically_increasing_id().alias("k"), "row").checkpoint()


def give_back() -> None:
    """Freed memory that this worker's allocators still hold goes back to the system: it lives on for other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def given_back(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, after whose last row ``give_back`` follows: what it held is free only when it has returned."""

    def run(batches):
        yield from kernel(batches)
        give_back()

    return run


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches' rows a few at a time, for kernels that make Python values of them: texts and lists of structs are large there."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(bytes uint8, offsets int64, null mask, rows) of the batches' ``text``, in runs of about ``limit`` bytes.

    A single longer text is a run of its own; null texts are empty and marked.
    """
    give_back()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        n = len(col)
        if not n:
            continue
        null = np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        if null.any():
            col = col.fill_null("")
        _, off_buf, data_buf = col.buffers()
        off = np.frombuffer(off_buf, np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
            j = min(n, max(j, i + 1))
            yield data[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64), null[i:j], batch.slice(i, j - i)
            i = j
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a polynomial hash counts."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2**64 of any substring of a buffer, from prefix sums.

    Each instance gives every byte a random 64-bit value of its own; two independent
    instances give 128 bits. All share one base, and so one table of its powers.
    """

    BASE = 0x5851F42D4C957F2D  # = 5 mod 8: of the largest order
    INVERSE = pow(BASE, -1, 2**64)
    _up = _down = np.ones(1, np.uint64)

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(x, k, 2**64))
            k += m
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(Rolling._up) <= len(data):
            n = (len(data) // (1 << 20) + 1) << 20
            Rolling._up, Rolling._down = self._powers(self.BASE, n + 1), self._powers(self.INVERSE, n + 1)
        out = np.empty(len(data) + 1, np.uint64)
        out[0] = 0
        # a byte is never out of the table: "clip" writes in place, where "raise" goes through a buffer
        np.take(self.values, data, out=out[1:], mode="clip")
        out[1:] *= self._up[: len(data)]
        np.cumsum(out[1:], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end] for arrays of bounds; the length is mixed in."""
        start, end = np.asarray(start), np.asarray(end)
        return mix64((prefix[end] - prefix[start]) * self._down[start] + (end - start).astype(np.uint64))

    def windows(self, prefix: np.ndarray, q: int) -> np.ndarray:
        n = len(prefix) - q
        return mix64((prefix[q:] - prefix[:-q]) * self._down[:n] + np.uint64(q)) if n > 0 else np.zeros(0, np.uint64)


#: Rounds after which components() gives up with an error; it needs about the logarithm of the longest path, squared at worst.
MOST_ROUNDS = 60


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Alternates large-star and small-star rounds until nothing changes. Each round is
    written to the shared checkpoint folder, so a lost executor costs one round at
    most, and a hub's neighbours meet only in aggregates, never in one task's memory.
    """
    ensure_checkpoint_dir(spark)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(MOST_ROUNDS):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node and its smaller neighbours are linked to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
