"""Results under content-addressed keys: commit, completeness, pruning, sweeps and answers.

A result counts from the moment its manifest row is there, which is written after its
children; a reader that finds some child missing treats it as pending.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import child_name, is_own, key_of, pair_key
from ..schemas import FAILED, MANIFEST


def keyed(pairs: DataFrame, plugin: Column | str = "plugin", version: Column | str = "plugin_version") -> DataFrame:
    return pairs.withColumn("key", pair_key("file_uid", "base", "target", plugin, version))


def manifests(results: DataFrame, children: DataFrame) -> DataFrame:
    """Results (key, file_uid, base, target, plugin, plugin_version, status, mode, failure) with their children
    (key, kind, idx, ext, mode) as manifest rows: names ordered by index, and the map of units."""
    per = children.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "kind", "mode", child_name("key", "kind", "idx", "ext").alias("name")))).alias("c"))
    r = results.join(per, "key", "left")
    none = F.array().cast("array<string>")
    units = F.transform("c", lambda x: F.struct(x["index"].alias("index"), x["kind"].alias("kind"), x["mode"].alias("mode")))
    return r.select(
        F.col("base").alias("base_version"), F.coalesce(F.transform("c", lambda x: x["name"]), none).alias("expected"), "failure", "file_uid", "key", "mode", "plugin", "plugin_version",
        F.lit(1).alias("schema"), "status", F.col("target").alias("target_version"), F.coalesce(units, F.array().cast("array<struct<index:int,kind:string,mode:string>>")).alias("units"),
    )


def to_json(m: DataFrame) -> Column:
    """Canonical text: names in alphabetical order, no blanks, no entry for a missing failure, ASCII only."""
    raw = F.to_json(F.struct(*sorted(m.columns)))
    wide = F.regexp_extract_all(raw, F.lit(r"([^\x00-\x7f])"), F.lit(1))
    return F.when(~raw.rlike(r"[^\x00-\x7f]"), raw).otherwise(F.aggregate(F.array_distinct(wide), raw, lambda s, c: F.replace(s, c, _escaped(c))))


def _escaped(c: Column) -> Column:
    """One character as \\uXXXX, or two of them beyond the first plane."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    return F.lower(F.regexp_replace(units, r"(.{4})", r"\\\\u$1"))


def from_json(text: Column | str) -> Column:
    """Lenient: what can't be read is null, and so pending; absent entries take their defaults."""
    m = F.from_json(text, MANIFEST)
    return F.when(m["file_uid"].isNotNull() | m["key"].isNotNull(), m)


def incomplete(m: DataFrame, present: DataFrame) -> DataFrame:
    """Keys of manifests of which an expected name is missing; nothing expected: complete."""
    return _counted(m, present).where(~F.col("_whole")).select("key").distinct()


def complete(m: DataFrame, present: DataFrame) -> DataFrame:
    return _counted(m, present).where("_whole").select(*m.columns)


def _counted(m: DataFrame, present: DataFrame) -> DataFrame:
    """Manifests with whether all they expect is there: the names there are gathered by key and met once."""
    there = present.select("file_uid", key_of("name").alias("key"), "name").where("key is not null").groupBy("file_uid", "key").agg(F.collect_set("name").alias("_there"))
    whole = F.size(F.array_except("expected", F.coalesce("_there", F.array().cast("array<string>")))) == 0
    return m.join(there, ["file_uid", "key"], "left").withColumn("_whole", whole)


def stale(m: DataFrame, plugin: Column, version: Column) -> DataFrame:
    return m.where(~(F.col("plugin").eqNullSafe(plugin) & F.col("plugin_version").eqNullSafe(version)))


def prune_keeping(names: DataFrame, keep: DataFrame) -> DataFrame:
    """(file_uid, name) rows to drop: our own whose key isn't kept for that file. Others' are never touched."""
    own = names.where(is_own("name")).withColumn("key", key_of("name"))
    return own.join(keep.select("file_uid", "key"), ["file_uid", "key"], "left_anti").select("file_uid", "name")


def prune_dropping(names: DataFrame, drop: DataFrame) -> DataFrame:
    own = names.where(is_own("name")).withColumn("key", key_of("name"))
    return own.join(drop.select("file_uid", "key"), ["file_uid", "key"], "left_semi").select("file_uid", "name")


def superseded(pairs: DataFrame) -> DataFrame:
    """(file_uid, key) of the same pairs under every earlier version of their operator."""
    v = F.col("plugin_version")
    earlier = F.when(v > 0, F.sequence(F.lit(0), v - 1)).otherwise(F.array().cast("array<int>"))
    old = pairs.withColumn("v", F.explode(earlier))
    return old.select("file_uid", pair_key("file_uid", "base", "target", "plugin", "v").alias("key"))


def pending(current: DataFrame, done: DataFrame, retry_failed: bool = False) -> DataFrame:
    """The sweep: current pairs without a complete manifest of this key, as one anti-join.

    Failed manifests count as done unless asked otherwise.
    """
    have = done.where(F.col("status") != FAILED) if retry_failed else done
    return current.join(have.select("key"), "key", "left_anti")


def swept(todo: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The pairs of one sweep, the first by key and at most so many, and whether that left some out: such a sweep is incomplete."""
    cut = todo.orderBy("key").limit(most + 1).count() > most
    return todo.orderBy("key").limit(most), cut


def outcome(state: dict[str, Column]) -> Column:
    """The first that holds: error, no_predecessor, unsupported, cached, too_large, failed; else computed."""
    out = F.when(F.lit(False), F.lit(""))
    for name in ("error", "no_predecessor", "unsupported", "cached", "too_large", "failed"):
        out = out.when(F.coalesce(state.get(name, F.lit(False)), F.lit(False)), F.lit(name))
    return out.otherwise(F.lit("computed"))


def answer(allowed: Column, verdict: Column, plugin: Column, status: Column, is_complete: Column) -> tuple[Column, Column]:
    """(HTTP code, status) of a request, in the order in which the questions are asked."""
    bad = verdict.isin("target_not_found", "base_not_found", "base_not_older", "no_versions")
    cases = [
        (~F.coalesce(allowed, F.lit(False)), 403, "denied"),
        (verdict == "no_predecessor", 200, "none"),
        (bad, 404, "not_found"),
        (plugin.isNull(), 200, "unsupported"),
        (F.coalesce(status == FAILED, F.lit(False)), 422, "failed"),
        (status.isNotNull() & F.coalesce(is_complete, F.lit(False)), 200, "ready"),
    ]
    code, text = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for when, c, t in cases:
        code, text = code.when(when, c), text.when(when, t)
    return code.otherwise(202), text.otherwise("pending")


def child_references(m: DataFrame, present: DataFrame) -> DataFrame:
    """(key, index, kind, mode, name, uid): a manifest's names with their units and stored ids, in order."""
    names = m.select("file_uid", "key", F.posexplode("expected").alias("p", "name"), "units")
    unit = F.try_element_at("units", F.col("p") + 1)
    r = names.select("file_uid", "key", "p", "name", unit["index"].alias("index"), unit["kind"].alias("kind"), unit["mode"].alias("mode"))
    return r.join(present.select("file_uid", "name", "uid"), ["file_uid", "name"], "left")


def bucket_of(key: Column | str) -> Column:
    """The folder of a key, by its first two digits. Keys are hashes, so 256 folders fill alike."""
    return F.concat(F.lit("k"), F.substring(key, 1, 2))


class ResultStore:
    """Children and manifests as Parquet folders of one place, only ever appended to; the manifest is written last.

    Rows lie in folders by the first digits of their key, and questions about given keys read those folders only. What is
    written again replaces what was there under the same name, and what is dropped is named in a third table with the
    time of it: no step rewrites a table, so a crash leaves the state before or after it. ``compact`` writes what stands
    to a new generation and names that last; readers go by the newest generation that is named. There is one writer at a time.
    """

    CHILDREN = "file_uid string, key string, kind string, idx int, ext string, mime string, mode string, name string, data binary"
    AT, DROPPED, GENERATIONS = "at timestamp", "file_uid string, key string, name string", "generation long, at timestamp"
    #: Files whose names are pushed into a scan as a list; more of them are met by a join.
    FEW = 256

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parquet(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:  # an empty place is an empty table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        """The newest generation that is whole; 0 before the first compaction. A row for each compaction is all that is read."""
        return self._parquet(f"{self.path}/generations", self.GENERATIONS).agg(F.max("generation")).first()[0] or 0

    def _read(self, name: str, schema: str, buckets: list[str] | None = None) -> DataFrame:
        rows = self._parquet(f"{self.path}/{name}/{self.generation()}", f"{schema}, {self.AT}, bucket string")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _append(self, rows: DataFrame, name: str, generation: int | None = None) -> None:
        # when a row counts from is settled as it is written, children before their manifests; a bucket is as many files as its size asks for
        timed = rows if "at" in rows.columns else rows.withColumn("at", F.current_timestamp())
        there = self.generation() if generation is None else generation
        timed.withColumn("bucket", bucket_of("key")).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{name}/{there}")

    @staticmethod
    def _buckets(keys: DataFrame | None) -> list[str] | None:
        """The folders of some keys, 256 at most."""
        return None if keys is None else sorted(r.b for r in keys.select(bucket_of("key").alias("b")).distinct().where("b is not null").collect())

    def _standing(self, rows: DataFrame, buckets: list[str] | None, keys: DataFrame | None = None) -> DataFrame:
        """The last row of each (file_uid, name) that wasn't dropped since, of the given keys only if there are any."""
        gone = self._read("dropped", self.DROPPED, buckets).groupBy("file_uid", "name").agg(F.max("at").alias("_gone"))
        if keys is not None:
            rows = rows.join(keys.select("key").distinct(), "key", "left_semi")
        last = rows.groupBy("file_uid", "name").agg(F.max("at").alias("at")).join(gone, ["file_uid", "name"], "left").where(F.col("_gone").isNull() | (F.col("_gone") < F.col("at")))
        return rows.join(last.select("file_uid", "name", "at"), ["file_uid", "name", "at"], "left_semi").dropDuplicates(["file_uid", "name"])

    def _tables(self, buckets: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """Children and manifests as they were written, with names."""
        m = self._read("manifests", MANIFEST, buckets)
        return self._read("children", self.CHILDREN, buckets), m.withColumn("name", F.concat(F.lit("diff."), "key", F.lit(".manifest.json")))

    def manifests(self, keys: DataFrame | None = None) -> DataFrame:
        buckets = self._buckets(keys)
        return self._standing(self._tables(buckets)[1], buckets, keys).drop("name", "at", "bucket")

    def children(self, keys: DataFrame | None = None) -> DataFrame:
        buckets = self._buckets(keys)
        return self._standing(self._tables(buckets)[0], buckets, keys).drop("at", "bucket")

    def commit(self, results: DataFrame, children: DataFrame, again: bool = False) -> None:
        """Children whose names are there aren't written again, unless ``again``; then the manifests."""
        named = children.withColumn("name", child_name("key", "kind", "idx", "ext"))
        names = [f.split()[0] for f in self.CHILDREN.split(", ")]
        if not again:
            there = self.children(results.select("key")).select("file_uid", "name")
            named = named.join(there, ["file_uid", "name"], "left_anti")
        self._append(named.select(*names), "children")
        self._append(manifests(results, children), "manifests")

    def served(self, keys: DataFrame | None = None) -> DataFrame:
        """Complete manifests; with ``keys``, of those only: a batch reads the folders of its own keys."""
        return complete(self.manifests(keys), self.children(keys).select("file_uid", "name"))

    def names(self, keys: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
        """(file_uid, name) of all children and manifests, of some keys' folders or some files only."""
        buckets = self._buckets(keys)
        both = [t.select("file_uid", "key", "name", "at") for t in self._tables(buckets)]
        if files is not None:
            some = [r.file_uid for r in files.select("file_uid").distinct().limit(self.FEW + 1).collect()]
            pick = (lambda t: t.where(F.col("file_uid").isin(some))) if len(some) <= self.FEW else (lambda t: t.join(files.select("file_uid").distinct(), "file_uid", "left_semi"))
            both = [pick(t) for t in both]
        return self._standing(both[0].union(both[1]), buckets).select("file_uid", "name")

    def drop(self, doomed: DataFrame) -> None:
        """From now on (file_uid, name) rows aren't there."""
        self._append(doomed.select("file_uid", key_of("name").alias("key"), "name").where("key is not null").distinct(), "dropped")

    def drop_keys(self, doomed: DataFrame) -> None:
        """Drops all that stands under the given (file_uid, key)s."""
        self.drop(prune_dropping(self.names(keys=doomed), doomed))

    def drop_files(self, files: DataFrame) -> None:
        """Drops all results of the given files."""
        self.drop(self.names(files=files).where(is_own("name")))

    def compact(self) -> None:
        """What stands becomes a generation of its own, the times of its rows kept; it is named when it is whole."""
        made = self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        for table, name in zip(self._tables(None), ("children", "manifests"), strict=True):
            standing = self._standing(table, None)
            self._append(standing.drop("bucket") if name == "children" else standing.drop("bucket", "name"), name, made)
        self.spark.createDataFrame([(made,)], "generation long").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
