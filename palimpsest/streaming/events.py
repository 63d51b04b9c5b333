"""The event side: routing, deduplication, idempotent work per micro-batch, access decisions with expiry."""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import store
from ..operators.groups import by_row
from ..operators.registry import Registry
from ..operators.run import run
from ..schemas import DEDUPE_EVENTS, EVENT, GOVERNANCE_EVENTS, HANDLED_EVENTS, MOST_PENDING, OUTCOMES
from . import state


def decoded(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """JSON payloads to event columns; what can't be read has only nulls and is ignored later, not lost."""
    keep = [c for c in payloads.columns if c != column]
    return payloads.select(*keep, F.from_json(column, EVENT).alias("e")).select(*keep, "e.*")


def action() -> Column:
    """What to do with an event, in this order: governance, other types, own output, folders, deletion, comparison."""
    kind = F.coalesce("type", F.lit(""))
    return (
        F.when(kind.isin(*GOVERNANCE_EVENTS), "invalidate")
        .when(~kind.isin(*HANDLED_EVENTS), "ignore")
        .when(F.coalesce("is_rendition", F.lit(False)), "ignore")
        .when(F.coalesce("is_folder", F.lit(False)) | (F.coalesce("file_uid", F.lit("")) == ""), "ignore")
        .when(kind == "file.deleted", "delete")
        .otherwise("compare")
    )


def routed(events: DataFrame) -> DataFrame:
    return events.withColumn("tenant", F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default"))).withColumn("action", action())


def first_of_each(events: DataFrame, order: list, key: str = "event_id") -> DataFrame:
    """The batch twin of the stream's deduplication: the first event of each id; events without an id all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    has = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return events.withColumn("_k", F.when(has, F.row_number().over(w)).otherwise(1)).where("_k = 1").drop("_k")


def first_within(events: DataFrame, order: list[str], most: int = DEDUPE_EVENTS, shards: int | Column = 1) -> DataFrame:
    """The batch twin of ``state.seen_within``: events whose id isn't among the last ``most`` new ones before them, by ``order`` in each shard."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    shard = F.pmod(F.xxhash64(F.coalesce("event_id", F.lit(""))), F.lit(shards)) if isinstance(shards, int) else shards
    dealt = events.withColumn("_shard", shard)
    at = events.columns.index("event_id")

    def step(seen: OrderedDict, row: tuple) -> list[tuple]:
        if row[at]:
            if row[at] in seen:
                return []
            seen[row[at]] = None
            if len(seen) > most:
                seen.popitem(last=False)
        return [row]

    return by_row(dealt, ["_shard"], order, OrderedDict, step, fields)


def deduplicated(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Time-bounded: an id is remembered for the watermark's delay. NTZ times are taken as UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def admitted(jobs: DataFrame, keys: list[str], running: DataFrame | None = None, most: int = MOST_PENDING) -> DataFrame:
    """One job a key, none that is running, the queue's room at most: ``accepted`` says which; the others are to be told so and come again.

    The first by key are taken, so that asking twice gives the same answer.
    """
    one = jobs.dropDuplicates(keys)
    if running is not None:
        one = one.join(running.select(*keys), keys, "left_anti")
    taken = one.select(*keys).orderBy(*keys).limit(most).withColumn("accepted", F.lit(True))
    return one.join(taken, keys, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


RETRY = "file_uid string, target string, base string, detail string, at timestamp"


def consumer(all_versions: Callable[[], DataFrame], results: store.ResultStore, registry: Registry, retry: str | None = None, log: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for routed events (``watched``): results of deleted files go, comparisons run.

    A file's comparisons count only after its last deletion in the batch. What could not be attempted is put
    aside in ``retry`` (see ``retried``); a pair that can't be compared is a failed manifest. Every step can be
    repeated: what is committed is cached, what is dropped stays so. ``log`` keeps every request's answer, a folder for
    each batch that a repeated batch writes anew (see ``outcomes``).
    """

    def act(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            last = batch.where("action = 'delete'").groupBy("file_uid").agg(F.max("ts").alias("gone"), F.count_if(F.col("ts").isNull()).alias("untimed"))
            files = last.select("file_uid")
            if not files.isEmpty():
                results.drop_files(files)
            after = F.col("gone").isNull() | (F.col("ts") > F.col("gone")) | F.col("ts").isNull()
            wanted = batch.where("action = 'compare'").join(last, "file_uid", "left").where(after & (F.coalesce("untimed", F.lit(0)) == 0))
            wanted = wanted.select("file_uid", F.coalesce("version", F.lit("")).alias("target"), F.lit("").alias("base")).distinct()
            if not wanted.isEmpty():
                report = run(wanted, all_versions(), results, registry)
                if log:
                    report.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
                if retry:
                    told = report.where("outcome = 'error'").select("file_uid", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("base", F.lit("")).alias("base"), "detail", F.current_timestamp().alias("at"))
                    told.write.mode("append").parquet(retry)
        finally:
            batch.unpersist()

    return act


def retried(spark: SparkSession, path: str, results: store.ResultStore) -> DataFrame:
    """The requests that batches have put aside, each once, without those that have a result since."""
    try:
        aside = spark.read.schema(RETRY).parquet(path)
    except AnalysisException as e:  # nothing was put aside yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RETRY).select("file_uid", "target", "base")
    done = results.manifests().select("file_uid", F.col("target_version").alias("target"))
    return aside.select("file_uid", "target", "base").distinct().join(done, ["file_uid", "target"], "left_anti")


def watched(stream: DataFrame, most: int = DEDUPE_EVENTS, shards: int = 1) -> DataFrame:
    """Events as a consumer acts on them: routed, ignored ones left out, each id of an update or deletion once among the last ``most``.

    Governance events and events without an id always pass and take no room.
    """
    acts = routed(stream).where("action <> 'ignore'")
    counted = F.when(F.col("action").isin("compare", "delete"), F.col("event_id"))
    return state.seen_within(acts, most, shards, ("ts",), counted)


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """A query of its own with its own checkpoint for each independent consumer; commits are its acknowledgements."""
    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


Sample = tuple[str, str, str, float, dict[str, str]]


def metrics_text(samples: list[Sample]) -> str:
    """(name, help, kind, value, labels) samples in the text format that scrapers read."""
    out, told = [], set()
    for name, text, kind, value, labels in samples:
        if name not in told:
            told.add(name)
            out += [f"# HELP {name} {text}", f"# TYPE {name} {kind}"]
        esc = {k: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for k, v in sorted(labels.items())}
        tag = "{" + ",".join(f'{k}="{v}"' for k, v in esc.items()) + "}" if esc else ""
        out.append(f"{name}{tag} {int(value) if float(value).is_integer() else value}")
    return "\n".join(out) + "\n"


LOG = "file_uid string, base string, target string, plugin string, plugin_version int, key string, outcome string, detail string, at timestamp, batch long"


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """The answers of all batches so far; nothing if there was none."""
    try:
        return spark.read.schema(LOG).parquet(log)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG)


def last_outcomes(answered: DataFrame) -> DataFrame:
    """(file_uid, target, base, outcome, at): how each request was answered last."""
    return answered.groupBy("file_uid", "target", "base").agg(F.max_by("outcome", F.struct("at", "batch")).alias("outcome"), F.max("at").alias("at"))


def outcome_counts(answered: DataFrame) -> DataFrame:
    """(outcome, n) for each of the outcomes there are, none left out."""
    every = answered.sparkSession.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    return every.join(answered.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def outcome_samples(answered: DataFrame, aside: DataFrame | None = None) -> list[Sample]:
    """What a scraper is told: answers by outcome, and how many requests wait to be tried again."""
    out = [("diff_outcomes_total", "Answers by outcome", "counter", float(r.n), {"outcome": r.outcome}) for r in sorted(outcome_counts(answered).collect())]
    return out if aside is None else [*out, ("diff_pending", "Requests put aside", "gauge", float(aside.count()), {})]


class Progress(StreamingQueryListener):
    """Rows, batches and the end of every query of a session, as samples; add it by ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.rows, self.batches, self.running, self.failed = Counter(), Counter(), {}, Counter()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.running[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] += p.numInputRows
        self.batches[name] += p.numInputRows > 0

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        name = self.running.pop(str(event.id), str(event.id))
        self.failed[name] += event.exception is not None

    def samples(self) -> list[Sample]:
        told = (("stream_rows_total", "Rows read", self.rows), ("stream_batches_total", "Batches with rows", self.batches), ("stream_failures_total", "Ends by an error", self.failed))
        out = [(name, text, "counter", float(n), {"query": q}) for name, text, counts in told for q, n in sorted(counts.items())]
        return [*out, ("streams_active", "Queries that run", "gauge", float(len(self.running)), {})]


def progress_samples(query: StreamingQuery) -> list[Sample]:
    p = query.lastProgress or {}
    labels = {"query": query.name or str(query.id)}
    return [("stream_rows", "Rows of the last batch", "gauge", float(p.get("numInputRows", 0)), labels), ("stream_active", "Whether the query runs", "gauge", float(query.isActive), labels)]


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A folder of JSON events as a stream, a bounded number of files at a time."""
    return spark.readStream.schema(EVENT + ", ts timestamp").option("maxFilesPerTrigger", files_per_batch).json(path)
