"""Session settings: first-of lookups for configuration, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what stateful streams (``streaming.state``) keep their state in
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def stripped(value: str) -> str:
    """A setting as written in a file: outer quotes off, a comment after a blank off if there were none."""
    v = value.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
        return v[1:-1]
    return v.split(" #", 1)[0].strip()


def settings(path: str | None = None, environ: dict[str, str] | None = None) -> dict[str, str]:
    """``NAME=value`` lines of a file under the environment, which wins."""
    out: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, eq, value = line.strip().removeprefix("export ").partition("=")
                if eq and not name.startswith("#"):
                    out[name.strip()] = stripped(value)
    return out | dict(os.environ if environ is None else environ)


def first_of(values: dict[str, str], *names: str, default: str = "") -> str:
    return next((values[n] for n in names if values.get(n, "").strip()), default)


def session(name: str = "palimpsest", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> None:
    """The cluster's own checkpoint folder. Unset: a folder of this machine if all of Spark runs in this process, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(own or os.path.join(tempfile.gettempdir(), "palimpsest-checkpoints"))
