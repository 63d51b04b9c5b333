"""Running a parser over a column of bytes: one row in, any number of element rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def parsed(files: DataFrame, keys: list[str], content: str, parse: Callable[[bytes], list[dict]], fields: str, rows_per_batch: int = 2000) -> DataFrame:
    """(keys, content) files to (keys, fields, problem) rows.

    A parser that raises gives one row with ``problem``, a file without elements one with only its keys, so
    nothing disappears. Rows leave in batches: a large file doesn't grow one frame. Files are dealt by their keys
    first: parsing costs far more than its input's bytes, by which Spark would cut a small table into one task.
    """
    spark = files.sparkSession
    schema = StructType([*(f for k in keys for f in files.schema.fields if f.name == k), *spark.createDataFrame([], f"{fields}, problem string").schema.fields])
    names = schema.names[len(keys) :]
    arrow = to_arrow_schema(schema)

    def made(rows: list[dict]) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pylist(rows, schema=arrow)
        except (pa.ArrowInvalid, pa.ArrowTypeError):
            # numbers of another kind than the field's, where nothing is lost by it
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=arrow.names), schema=arrow, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for head, data in zip(batch.select(keys).to_pylist(), batch.column(content), strict=True):
                try:
                    found = parse(data.as_py() or b"") or [{}]
                except Exception as e:  # noqa: BLE001
                    found = [{"problem": f"loader-error:{type(e).__name__}"}]
                for x in found:
                    out.append(head | {n: x.get(n) for n in names})
                    if len(out) >= rows_per_batch:
                        yield made(out)
                        out = []
            if out:
                yield made(out)

    dealt = files.select(*keys, content).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    return dealt.mapInArrow(run, schema)
