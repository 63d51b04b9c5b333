"""Spark data sources that read byte ranges: the beginnings of files, and append-only logs from any position.

Places are what ``pyarrow.fs`` opens: local or mounted folders and the stores that it has drivers for. Workers read only
the ranges of their own partitions; names, sizes and positions are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import SNIFF_BYTES


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool) -> list:
    """The files of a folder by name, none where there is no folder; hidden ones are left out as Spark does."""
    from pyarrow import fs

    store, place = opened(path)
    found = store.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=recursive))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


# Beginnings of files ------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, files: list[tuple]):
        super().__init__(0)
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes, self.each = options["path"], int(options.get("bytes", SNIFF_BYTES)), int(options.get("filesPerPartition", 256))

    def partitions(self) -> list[Files]:
        files = [(f.path, f.size, f.mtime) for f in listed(self.path, True)]
        return [Files(files[i : i + self.each]) for i in range(0, len(files), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path, size, changed in partition.files:
            with store.open_input_file(path) as f:
                yield path, size, changed, f.read_at(min(self.bytes, size), 0)


class Heads(DataSource):
    """``file_heads``: each file below ``path`` with its size, time and first ``bytes`` bytes, whatever its length."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, modified timestamp, head binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def read_heads(spark: SparkSession, root: str) -> DataFrame:
    """The version table of ``files.read_versions`` with the first bytes of each file for its content: enough to tell its type."""
    from ..operators.versions import natural, ordered

    spark.dataSource.register(Heads)
    parts = F.split("path", "/")
    f = spark.read.format("file_heads").option("path", root).load()
    v = f.select(F.element_at(parts, -3).alias("file_uid"), F.element_at(parts, -2).alias("version"), F.element_at(parts, -1).alias("name"), F.lit("").alias("mime"), F.col("head").alias("content"))
    return ordered(v, [F.desc(natural("version")), F.desc("version")]).select("file_uid", "version", "ord", "name", "mime", "content")


# Logs -----------------------------------------------------------------------------


class Range(InputPartition):
    """Bytes of a segment; lines that begin in it are its own. ``first``: it begins where a line does."""

    def __init__(self, segment: str, begin: int, end: int, first: bool):
        super().__init__(0)
        self.segment, self.begin, self.end, self.first = segment, begin, end, first


class LogReader(DataSourceStreamReader):
    """Positions are bytes by segment, always behind a line feed: a line that isn't finished yet waits for the next batch."""

    STEP = 1 << 16

    def __init__(self, options: dict):
        self.path, self.start, self.size = options["path"], options.get("start", "earliest"), int(options.get("bytesPerPartition", 8 << 20))
        if self.start not in ("earliest", "latest"):
            raise ValueError(f"start is earliest or latest, not {self.start}")

    def initialOffset(self) -> dict:  # noqa: N802
        return {} if self.start == "earliest" else self.latestOffset()

    def latestOffset(self) -> dict:  # noqa: N802
        store, _ = opened(self.path)
        return {f.base_name: self._whole(store, f.path, f.size) for f in listed(self.path, False)}

    def _whole(self, store, path: str, size: int) -> int:
        """The end of the last finished line, looked for from the end."""
        with store.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(0, end - self.STEP)
                at = f.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for segment, to in sorted(end.items()):
            begin = start.get(segment, 0)
            out += [Range(segment, i, min(i + self.size, to), i == begin) for i in range(begin, to, self.size)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, place = opened(self.path)
        with store.open_input_file(f"{place.rstrip('/')}/{partition.segment}") as f:
            at = partition.begin
            if not partition.first:
                # the line that reaches into this range belongs to the one before
                at = self._behind(f, at - 1)
            while at < partition.end:
                stop = self._behind(f, max(at, partition.end - 1))
                raw = f.read_at(stop - at, at)
                for line in raw.split(b"\n")[:-1]:
                    yield partition.segment, at, line.decode("utf-8", "replace")
                    at += len(line) + 1

    def _behind(self, f, at: int) -> int:
        """The place behind the first line feed from ``at`` on."""
        while True:
            block = f.read_at(self.STEP, at)
            found = block.find(b"\n")
            if found >= 0 or not block:
                return at + found + 1 if found >= 0 else at
            at += len(block)

    def commit(self, end: dict) -> None:
        """Positions live in the query's checkpoint: each query is a consumer of its own, and what it didn't commit it reads again."""


class Log(DataSource):
    """``event_log``: lines of the segments of a folder, each of which only grows, as (segment, at, payload)."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "segment string, at long, payload string"

    def streamReader(self, schema) -> LogReader:  # noqa: N802
        return LogReader(self.options)


def read_log(spark: SparkSession, path: str, start: str = "earliest") -> DataFrame:
    """A log as a stream; ``latest`` passes over what is there when a query first starts."""
    spark.dataSource.register(Log)
    return spark.readStream.format("event_log").option("path", path).option("start", start).load()
