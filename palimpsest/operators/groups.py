"""Order-dependent work on groups: sorted rows streamed through a kernel, one group in memory at a time.

``groupBy().applyInPandas`` makes a frame for each group, which costs milliseconds; most
units here have a handful of rows. Rows are dealt and sorted by the JVM instead, and a
kernel gets its group as plain lists and gives back rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

Kernel = Callable[[tuple, dict[str, list]], list[tuple]]


def by_group(rows: DataFrame, keys: list[str], order: list[str], kernel: Kernel, fields: str, keep: list[str] | None = None, rows_out: int = 8192) -> DataFrame:
    """kernel(key, columns) gives tuples in the order of ``keep`` (all keys by default) and ``fields``."""
    keep = keys if keep is None else keep
    extra = rows.sparkSession.createDataFrame([], fields).schema.fields
    schema = StructType([*(StructField(k, rows.schema[k].dataType) for k in keep), *extra])
    arrow = to_arrow_schema(schema)
    names = rows.columns
    at = [names.index(k) for k in keys]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = tuple(row[i] for i in at)
                if key != now:
                    if held:
                        out += kernel(now, dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))
                    now, held = key, []
                    if len(out) >= rows_out:
                        yield batch(out)
                        out = []
                held.append(row)
        if held:
            out += kernel(now, dict(zip(names, map(list, zip(*held, strict=True)), strict=True)))
        if out:
            yield batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def by_row(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], fields: str, rows_out: int = 8192) -> DataFrame:
    """A fold over each group's sorted rows: ``step(state, row)`` gives rows of ``fields`` from the row without its keys.

    The state is all that is held of a group, so its rows may be any number.
    """
    schema = rows.sparkSession.createDataFrame([], fields).schema
    arrow = to_arrow_schema(schema)
    names = rows.columns
    at = [names.index(k) for k in keys]
    rest = [i for i, n in enumerate(names) if n not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = tuple(row[i] for i in at)
                if state is None or key != now:
                    now, state = key, start()
                out += step(state, tuple(row[i] for i in rest))
            if len(out) >= rows_out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
