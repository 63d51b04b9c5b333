"""Comparisons from request to result: versions, type, cache, contents, comparison, commit, pruning.

A run is a batch of requests; each step is a join or an anti-join over all of them, and every
request ends in one row that says how (``schemas.OUTCOMES``). Results are committed children
first, manifest last, failed ones too, so a comparison that can't be made isn't tried again
by itself. ``force`` makes what is there already again; it doesn't change the order of writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import col
from ..functions.mime import detect
from ..schemas import FAILED, FAILURE, MOST_SOURCE_BYTES, RASTER, READY, XKT
from ..session import ensure_checkpoints
from . import store, versions
from .registry import Registry
from .score import overall

REPORT = ["file_uid", "base", "target", "plugin", "plugin_version", "key", "outcome", "detail"]


def dispatched(requests: DataFrame, all_versions: DataFrame, registry: Registry) -> DataFrame:
    """Requests with their pair, type, operator and key; contents aren't read beyond the bytes that tell a type."""
    r = versions.resolve(requests, all_versions).distinct()
    ok = r.where("verdict = 'ok'").select("file_uid", "base", "target")
    # bytes that nobody asks travel nowhere
    asked = F.when(F.coalesce("mime", F.lit("")) == "", F.col("content"))
    sides = versions.contents(ok, all_versions.withColumn("content", asked), prefix=True)
    told = F.coalesce(F.nullif("target_mime", F.lit("")), detect("target_content", "target_name"))
    typed = sides.select("file_uid", "base", "target", told.alias("mime"))
    typed = typed.withColumn("plugin", registry.dispatch(F.col("mime")))
    typed = store.keyed(typed.withColumn("plugin_version", registry.version(F.col("plugin"))))
    return r.join(typed, ["file_uid", "base", "target"], "left").withColumn("key", F.when(F.col("plugin").isNotNull(), F.col("key")))


def computed(todo: DataFrame, all_versions: DataFrame, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """(results, children) of pairs (key, file_uid, base, target, plugin, plugin_version, mime)."""
    ensure_checkpoints(todo.sparkSession)
    todo = todo.checkpoint()  # a few columns, met four times below
    pairs = versions.contents(todo, all_versions)
    # the comparison is the costly part: the registry has written it, and it is read for the results and for the children
    rows = registry.compare(pairs)
    children = rows.where("error is null").join(todo.select("key", "file_uid"), "key")
    wrong = rows.where("error is not null").groupBy("key").agg(F.min(F.struct("error", "stage")).alias("wrong"))
    notes = rows.where("error is null and stage is not null").groupBy("key").agg(F.min("stage").alias("note"))
    made = overall(children, ["key"])
    r = todo.join(made.select("key", "status", "mode"), "key", "left").join(wrong, "key", "left").join(notes, "key", "left")
    shown = F.col("status") == READY
    reason = F.coalesce("wrong.error", F.when(F.col("status") == FAILED, F.lit("no page could be rendered at any tier")), F.lit("nothing to compare"))
    stage = F.coalesce("wrong.stage", F.when(F.col("status") == FAILED, F.lit("render")), F.lit("diff"))
    tiers = F.when(F.col("plugin") == "3d", F.array(F.lit(XKT))).otherwise(F.array(F.lit("vector"), F.lit(RASTER)))
    failure = F.when(~F.coalesce(shown, F.lit(False)), F.struct(reason.alias("reason"), stage.alias("stage"), tiers.alias("tiers_attempted"))).cast(FAILURE)
    results = r.select("key", "file_uid", "base", "target", "plugin", "plugin_version", F.when(F.coalesce(shown, F.lit(False)), READY).otherwise(FAILED).alias("status"), F.coalesce("mode", F.lit(RASTER)).alias("mode"), failure.alias("failure"), "note")
    # what failed as a whole keeps no children
    return results, children.join(results.where(F.col("status") == READY).select("key"), "key", "left_semi")


def run(requests: DataFrame, all_versions: DataFrame, results: store.ResultStore, registry: Registry, force: bool = False, most_bytes: int = MOST_SOURCE_BYTES, retry_failed: bool = False, heads: DataFrame | None = None) -> DataFrame:
    """One row (REPORT) for each request (file_uid, target, base): what it was answered with. Commits what it computes.

    ``heads`` is the same table of versions with the first bytes for content (``sources.ranges.read_heads``): types are
    told from it, so that files whose result is there are never read.
    """
    ensure_checkpoints(requests.sparkSession)
    asked = dispatched(requests, all_versions if heads is None else heads, registry).checkpoint()
    keyed = asked.where("key is not null").select("key", "file_uid", "base", "target", "plugin", "plugin_version", "mime").dropDuplicates(["key"])
    have = results.served(keyed).select("key", "status")
    if retry_failed:
        have = have.where(F.col("status") != FAILED)
    # settled before anything is written: the store changes below
    cached = (have.select("key").limit(0) if force else have.select("key")).checkpoint()
    fresh = keyed.join(cached, "key", "left_anti")
    sized = versions.within_size(versions.contents(fresh, all_versions), most_bytes).select("key", "too_large").checkpoint()
    todo = fresh.join(sized.where("not too_large").select("key"), "key", "left_semi")
    made, children = computed(todo, all_versions, registry)
    made = made.checkpoint()
    # what is written again replaces: also under ``force`` a pair is never without a result
    results.commit(made, children, again=force or retry_failed)
    results.drop_keys(store.superseded(made.select("file_uid", "base", "target", "plugin", "plugin_version")))
    a = asked.join(cached.withColumn("cached", F.lit(True)), "key", "left").join(sized, "key", "left").join(made.select("key", F.col("status").alias("made"), F.coalesce("failure.reason", "note").alias("reason")), "key", "left")
    state = {
        "error": ~F.col("verdict").isin("ok", "no_predecessor") | (F.col("key").isNotNull() & F.coalesce("cached", F.lit(False)).eqNullSafe(False) & F.col("too_large").isNull()),
        "no_predecessor": F.col("verdict") == "no_predecessor", "unsupported": F.col("plugin").isNull(), "cached": col("cached"), "too_large": col("too_large"), "failed": F.col("made") == FAILED,
    }
    outcome = store.outcome(state)
    detail = F.when(F.col("verdict") != "ok", F.col("verdict")).when(F.col("plugin").isNull(), F.col("mime")).otherwise(F.col("reason"))
    return a.select("file_uid", "base", "target", "plugin", "plugin_version", "key", outcome.alias("outcome"), F.coalesce(detail, F.lit("")).alias("detail")).select(*REPORT)
