"""Comparison operators and their registry; a pair that can't be compared is a row and never ends the others' run.

An operator compares one pair at a time (``Entry.pair``, a function that runs in an Arrow kernel, where
its exceptions become error rows) or all of them as one plan (``Entry.compare``). A plan
that fails over some pair is run again on slices of its pairs until that pair stands alone.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.errors import ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, PythonException, SparkNoSuchElementException, SparkRuntimeException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.mime import bare, operator_for
from ..schemas import MOST_TEXT_LINES
from ..session import ensure_checkpoints
from . import comparisons
from .comparisons import CHILD, failures

#: What a row can do to a plan. A lost executor, a full disk or a missing table isn't among them: such errors end the run.
ROW_ERRORS = (PythonException, SparkRuntimeException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, SparkNoSuchElementException)
#: The stage under which such a pair's failure is told, and the most characters of its reason.
STAGE, REASON_CHARS = "plugin", 500
#: Of a plan that failed: pairs of a slice, parts that a failing range of slices is cut into, attempts at a time, the most keys of an error that are tried alone, the most parts of a union.
SLICE, CUT, AT_ONCE, MOST_TOLD, MOST_BRANCHES = 512, 16, 8, 4, 64
PAIR = ["key", "base_content", "target_content", "base_name", "target_name", "mime"]

Pair = Callable[[dict, dict], list[dict]]


class DiffOperator(Protocol):
    """A comparison of pairs: rows (key, base_content, target_content, mime, base_name, target_name) to children rows.

    ``Entry`` is the implementation that the registry holds.
    """

    name: str
    version: int

    def claims(self, mime: Column) -> Column: ...

    def compare(self, pairs: DataFrame) -> DataFrame: ...


@dataclass
class Entry:
    name: str
    version: int
    claims: Callable[[Column], Column]
    compare: Callable[[DataFrame], DataFrame] | None = None
    pair: Pair | None = None

    def run(self, pairs: DataFrame) -> DataFrame:
        """Children and error rows (CHILD) of all the pairs, written to the checkpoint folder."""
        if self.pair is not None:
            ensure_checkpoints(pairs.sparkSession)
            return pairwise(self.pair, pairs).checkpoint()
        return isolated(self.compare, pairs)


class Registry:
    """Operators in order of precedence; an allowlist, if there is one, limits them."""

    def __init__(self, enabled: tuple[str, ...] = ()):
        self._entries: list[Entry] = []
        self.enabled = tuple(enabled)

    def register(self, entry: Entry) -> None:
        self._entries = [e for e in self._entries if e.name != entry.name] + [entry]

    @property
    def entries(self) -> list[Entry]:
        return [e for e in self._entries if not self.enabled or e.name in self.enabled]

    def dispatch(self, mime: Column) -> Column:
        """Name of the first operator that claims the type; null for none. A claim that is null doesn't count."""
        out = F.when(F.lit(False), F.lit(""))
        for e in self.entries:
            out = out.when(F.coalesce(e.claims(mime), F.lit(False)), F.lit(e.name))
        return out

    def version(self, name: Column) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for e in self.entries:
            out = out.when(name == e.name, F.lit(e.version))
        return out

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Each operator on its own pairs, as separate branches: costly ones run only where needed. Children rows (CHILD), written once."""
        # as many names as operators at most: what no pair asks for isn't planned
        asked = {r.plugin for r in pairs.select("plugin").distinct().collect()}
        parts = [e.run(pairs.where(F.col("plugin") == e.name)) for e in self.entries if (e.compare or e.pair) and e.name in asked]
        none = pairs.sparkSession.createDataFrame([], CHILD)
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, none)


def reason_of(error: Exception) -> str:
    """``Type: text`` of what a row did; of a worker's traceback its last line."""
    text = str(error)
    told = re.findall(r"^(?:[A-Za-z_][\w.]*(?:Error|Exception|Exit|Interrupt|Iteration|Warning))(?:: .*)?$", text, re.M) if isinstance(error, PythonException) else []
    return (told[-1] if told else f"{type(error).__name__}: {text.splitlines()[0] if text else ''}")[:REASON_CHARS]


def pairwise(compare: Pair, pairs: DataFrame) -> DataFrame:
    """``compare(base, target)`` on dicts (content, name, mime) gives the children's fields; what it raises is the pair's error.

    Nothing is shuffled, and a pair is all that the function sees.
    """
    schema = pairs.sparkSession.createDataFrame([], CHILD).schema
    arrow = to_arrow_schema(schema)

    def children(row: dict) -> list[dict]:
        try:
            made = compare(*({"content": bytes(row[f"{s}_content"] or b""), "name": row[f"{s}_name"], "mime": row["mime"]} for s in ("base", "target")))
            if not isinstance(made, list) or not all(isinstance(c, dict) for c in made):
                raise TypeError(f"comparison returned {type(made).__name__}, not a list of children")
            rows = [{**c, "key": row["key"], "error": None, "stage": None} for c in made]
            pa.RecordBatch.from_pylist(rows, schema=arrow)  # a field of another type is this pair's error as well
            return rows
        except Exception as e:  # noqa: BLE001  one bad pair must not end the others
            return [{"key": row["key"], "error": f"{type(e).__name__}: {e}"[:REASON_CHARS], "stage": STAGE}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist(children(batch.slice(i, 1).to_pylist()[0]), schema=arrow)

    return pairs.select(*PAIR).mapInArrow(run, schema)


def isolated(compare: Callable[[DataFrame], DataFrame], pairs: DataFrame) -> DataFrame:
    """compare(pairs), written to the checkpoint folder; pairs over which the plan fails are error rows.

    After a failure the pairs are written in slices of about ``SLICE``, each in a folder of its own, so that an attempt
    reads no more than it tries. What fails is cut into ``CUT`` ranges of slices, then into slices; within a slice the
    pairs whose keys the error tells are tried alone and the others again, and where it tells none, either half. Attempts
    run ``AT_ONCE`` at a time and are as many as slices and failing pairs together. A plan that can't even be made fails
    for all of its pairs at once.
    """
    spark = pairs.sparkSession
    ensure_checkpoints(spark)
    try:
        plan = compare(pairs)
    except Exception as e:  # noqa: BLE001
        return failures(pairs, STAGE, F.lit(reason_of(e)))
    try:
        return plan.checkpoint()
    except ROW_ERRORS:
        n = max(1, -(-pairs.count() // SLICE))
    folder = f"{spark.sparkContext.getCheckpointDir()}/slices-{uuid.uuid4().hex}"
    dealt = pairs.withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).repartition(min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_slice")
    dealt.write.partitionBy("_slice").parquet(folder)
    slices = spark.read.schema(dealt.schema).parquet(folder)
    made: list[DataFrame] = []
    failed: list[tuple] = []

    def attempt(first: int, end: int, keys: list | None = None, without: tuple = (), only: bool = False) -> list[tuple]:
        """What is to be tried after this part: ``keys`` are a slice's that are still to be tried, ``without`` those that aren't, ``only`` says which of both tells them."""
        part = slices.where(F.col("_slice") == first if end - first == 1 else F.col("_slice").between(first, end - 1)).drop("_slice")
        # a few keys are left out by name: hundreds that stay would cost more than the attempt
        part = part.where(F.col("key").isin(keys)) if only else part.where(~F.col("key").isin(*without)) if without else part
        try:
            plan = compare(part)
        except Exception as e:  # noqa: BLE001
            made.append(failures(part, STAGE, F.lit(reason_of(e))).checkpoint())
            return []
        try:
            made.append(plan.checkpoint())
            return []
        except ROW_ERRORS as e:
            error = e
        if end - first > 1:
            step = -(-(end - first) // CUT)
            return [(i, min(i + step, end)) for i in range(first, end, step)]
        # the keys of one slice
        keys = [*dict.fromkeys(r.key for r in part.select("key").collect())] if keys is None else keys
        if len(keys) < 2:
            failed.extend((k, reason_of(error)) for k in keys)
            return []
        text = str(error)
        told = [k for k in keys if str(k) in text]
        if 0 < len(told) <= MOST_TOLD:
            left = [k for k in keys if k not in told]
            return [*((first, end, [k], (), True) for k in told), *([(first, end, left, (*without, *told), only)] if left else [])]
        return [(first, end, k, (), True) for k in (keys[: len(keys) // 2], keys[len(keys) // 2 :])]

    pool = ThreadPoolExecutor(AT_ONCE)
    try:
        waiting = {pool.submit(attempt, 0, n)} if n == 1 else {pool.submit(attempt, *p) for p in [(i, min(i + -(-n // CUT), n)) for i in range(0, n, -(-n // CUT))]}
        while waiting:
            done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
            waiting |= {pool.submit(attempt, *p) for d in done for p in d.result()}
    finally:
        pool.shutdown(cancel_futures=True)
    if failed:
        told = spark.createDataFrame(failed, StructType([pairs.schema["key"], StructField("error", StringType())]))
        made.append(failures(told, STAGE, F.col("error")).checkpoint())
    return together(made, f"{folder}-made")


def together(parts: list[DataFrame], folder: str) -> DataFrame:
    """The union of any number of written parts: many are written again as few, so that no plan has thousands of branches."""
    union = lambda some: functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), some)
    if len(parts) <= MOST_BRANCHES:
        return union(parts)
    # read as files: unions of checkpoints of unions aren't planned right
    starts = range(0, len(parts), MOST_BRANCHES)
    for i in starts:
        union(parts[i : i + MOST_BRANCHES]).write.parquet(f"{folder}/{i}")
    return parts[0].sparkSession.read.schema(union([parts[0], parts[-1]]).schema).parquet(*(f"{folder}/{i}" for i in starts))


def default_registry(text: bool = False, enabled: tuple[str, ...] = (), tools: comparisons.Tools = comparisons.Tools(), most_lines: int | None = MOST_TEXT_LINES) -> Registry:
    """PDF and 3D; plain text only where asked for, whole with ``most_lines`` None. ``tools`` are the adapters of what a Python worker can't do by itself."""
    r = Registry(enabled)
    r.register(Entry("pdf", 1, lambda m: bare(m) == "application/pdf", lambda p: comparisons.compare_pdf(p, tools)))
    r.register(Entry("3d", 1, lambda m: operator_for(m) == "3d", lambda p: comparisons.compare_models(p, tools)))
    if text:
        r.register(Entry("passthrough-text", 1, lambda m: F.startswith(bare(m), F.lit("text/plain")), lambda p: comparisons.compare_text(p, most_lines)))
    return r
