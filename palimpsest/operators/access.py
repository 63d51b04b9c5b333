"""Cached access decisions as of a moment, and the governance events that void them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import GOVERNANCE_EVENTS, PERMISSION_SECONDS


def checked(acl_allows: DataFrame, files: DataFrame) -> DataFrame:
    """(tenant, user, file_uid, allowed): the list allows it and the file exists. A failed check stays null: it
    denies when asked, and must not be remembered."""
    there = files.select("file_uid", F.lit(True).alias("there")).distinct()
    j = acl_allows.join(there, "file_uid", "left")
    return j.select("tenant", "user", "file_uid", F.when(F.col("allowed").isNull(), None).otherwise(F.col("allowed") & F.coalesce("there", F.lit(False))).alias("allowed"))


def remembered(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """(tenant, user, file_uid, at, request, x): x is the last decision (d: its time, allowed) at or before each request, null without one.

    Both tables go through one window by key, so there is no range join: each request
    looks back at the last decision before it.
    """
    key = ["tenant", "user", "file_uid"]
    d = decisions.where("allowed is not null").select(*key, F.col("decided_at").alias("at"), F.struct(F.col("decided_at").alias("d"), "allowed").alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("request"))
    r = requests.select(*key, "at", F.lit(None).cast(d.schema["x"].dataType).alias("x"), F.lit(1).alias("kind"), F.col("request").cast("long"))
    w = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return d.unionByName(r).withColumn("x", F.last("x", ignorenulls=True).over(w)).where("kind = 1").select(*key, "at", "request", "x")


def fresh(at: Column, ttl_seconds: int) -> Column:
    return F.col("x.d") + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS") > at


def as_of(requests: DataFrame, decisions: DataFrame, ttl_seconds: int = PERMISSION_SECONDS) -> DataFrame:
    """(tenant, user, file_uid, at) requests with the latest remembered decision not older than the time to live. Null allowed: nothing remembered."""
    seen = remembered(requests, decisions)
    return seen.select("tenant", "user", "file_uid", "at", "request", F.when(fresh(F.col("at"), ttl_seconds), F.col("x.allowed")).alias("allowed"))


def scope(events: DataFrame) -> DataFrame:
    """What each governance event voids: (tenant, at, scope, target)."""
    g = events.where(F.col("type").isin(*GOVERNANCE_EVENTS))
    tenant = F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default"))
    member = F.coalesce("member", F.lit(""))
    kind = F.when(F.col("type") == "acl.changed", "resource").when(F.col("type").isin("role.assigned", "role.member_removed") & (member != ""), "member").otherwise("tenant")
    return g.select(tenant.alias("tenant"), "at", kind.alias("scope"), F.when(kind == "resource", F.coalesce("file_uid", F.lit(""))).when(kind == "member", member).otherwise("").alias("target"))


def invalidated(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Decisions that no later event of their file, member or tenant voids.

    Only the last event of each target matters, so the events shrink to one row a target before the joins.
    """
    last = scope(events).groupBy("tenant", "scope", "target").agg(F.max("at").alias("void_at"))
    d = decisions
    for kind, column in (("resource", "file_uid"), ("member", "user"), ("tenant", None)):
        e = last.where(F.col("scope") == kind).select("tenant", F.col("target").alias(column or "_t"), F.col("void_at").alias(f"_{kind}"))
        d = d.join(e if column else e.drop("_t"), ["tenant", column] if column else ["tenant"], "left")
    gone = F.coalesce(F.greatest("_resource", "_member", "_tenant") > F.col("decided_at"), F.lit(False))
    return d.where(~gone).select(decisions.columns)


def last_void(rows: DataFrame, marks: DataFrame, keys: list[str], seconds: int, name: str) -> DataFrame:
    """rows with the last mark (keys, at) at or before their own ``at``, if it is no older than so many seconds.

    Time is cut into slices of that length and a mark stands in its own and the next one: one window
    by (keys, slice) finds it, and a key with a third of all rows is dealt out over its slices.
    """
    part = F.floor(F.col("at").cast("timestamp").cast("double") / max(1, seconds))
    columns = rows.columns
    r = rows.select(*keys, part.alias("_part"), "at", F.lit(1).alias("_kind"), F.struct(*columns).alias("_row"))
    m = marks.select(*keys, F.explode(F.array(part, part + 1)).alias("_part"), "at", F.lit(0).alias("_kind"), F.lit(None).cast(r.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*keys, "_part").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = r.unionByName(m).withColumn(name, F.last(F.when(F.col("_kind") == 0, F.col("at")), ignorenulls=True).over(w))
    return seen.where("_kind = 1").select(*(F.col("_row")[c].alias(c) for c in columns), name)


def answers(requests: DataFrame, decisions: DataFrame, events: DataFrame, ttl_seconds: int = PERMISSION_SECONDS) -> DataFrame:
    """Each request's remembered decision, unless it is too old or a later event of its file, member or tenant came before the request.

    A void at the moment of a decision comes after it only where it is later; one at the moment of the request counts.
    """
    r = remembered(requests, decisions)
    voids = scope(events)
    for kind, column in (("resource", "file_uid"), ("member", "user"), ("tenant", None)):
        marks = voids.where(F.col("scope") == kind).select("tenant", *([F.col("target").alias(column)] if column else []), "at")
        r = last_void(r, marks, ["tenant", *([column] if column else [])], ttl_seconds, f"_{kind}")
    gone = F.coalesce(F.greatest("_resource", "_member", "_tenant") > F.col("x.d"), F.lit(False))
    return r.select("tenant", "user", "file_uid", "at", "request", F.when(fresh(F.col("at"), ttl_seconds) & ~gone, F.col("x.allowed")).alias("allowed"))
