"""Stateful stream operators: access decisions with voids of any scope, and a bounded memory of event ids.

Both run on ``transformWithState`` and need the state store of RocksDB, as ``session.DEFAULTS`` sets it. State is keyed by what a row can
reach and dealt into buckets, so neither a large tenant nor a single consumer's ids are
one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.access import scope
from ..schemas import DEDUPE_EVENTS, PERMISSION_SECONDS

REQUEST = "tenant string, user string, file_uid string, at double, kind string, allowed boolean"
ANSWER = "tenant string, user string, file_uid string, at double, kind string, allowed boolean"
#: Rows of one moment: decisions are made, then voided, then asked for.
ORDER = {"check": 0, "void": 1, "ask": 2}


def void_rows(events: DataFrame) -> DataFrame:
    """Governance events (type, tenant, file_uid, member, at) as rows of the decision stream: ``user`` or ``file_uid`` or neither names the target."""
    s = scope(events)
    target = lambda kind: F.when(F.col("scope") == kind, F.col("target"))
    return s.select("tenant", target("member").alias("user"), target("resource").alias("file_uid"), F.col("at").cast("double").alias("at"), F.lit("void").alias("kind"), F.lit(None).cast("boolean").alias("allowed"))


class Decisions(StatefulProcessor):
    """What a bucket of a tenant's users remembers: decisions by (user, file), and the last void of each user, file and the tenant.

    A void is one entry however many decisions it voids: a decision counts while it is younger than its time to live and
    than every void that reaches it. Entries that can't matter any more go when the watermark passes them.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = float(ttl_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "user string, file_uid string", "allowed boolean, at double")
        self.voids = handle.getMapState("voids", "kind string, target string", "at double")

    def _void_at(self, kind: str, target: str) -> float:
        key = (kind, target)
        return self.voids.getValue(key)[0] if self.voids.containsKey(key) else float("-inf")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.assign(_o=frame["kind"].map(ORDER)).sort_values(["at", "_o"], kind="stable")
        tenant, out = key[0], []
        text = lambda v: None if v is None or pd.isna(v) else v
        for user, file, at, kind, allowed in frame[["user", "file_uid", "at", "kind", "allowed"]].itertuples(index=False):
            user, file, allowed = text(user), text(file), text(allowed)
            if kind == "void":
                which = ("member", user) if user is not None else ("resource", file) if file is not None else ("tenant", "")
                self.voids.updateValue(which, (max(at, self._void_at(*which)),))
            elif kind == "check":
                # a failed check is answered with a denial and leaves what is remembered as it is
                before = self.known.getValue((user, file)) if self.known.containsKey((user, file)) else None
                if allowed is not None and self.ttl > 0 and (before is None or at >= before[1]):
                    self.known.updateValue((user, file), (bool(allowed), float(at)))
                out.append((tenant, user, file, at, kind, bool(allowed) if allowed is not None else False))
            else:
                got = self.known.getValue((user, file)) if self.known.containsKey((user, file)) else None
                last = max(self._void_at("member", user), self._void_at("resource", file), self._void_at("tenant", ""))
                fresh = got is not None and at < got[1] + self.ttl and got[1] >= last
                out.append((tenant, user, file, at, kind, bool(got[0]) if fresh else None))
        self._wait(timerValues)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")])

    def _wait(self, timer_values) -> None:
        """One sweep a time to live after the watermark, unless one is waited for."""
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(0, timer_values.getCurrentWatermarkInMs()) + int(max(self.ttl, 1) * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() / 1000
        left = False
        for state, at in ((self.known, lambda v: v[1]), (self.voids, lambda v: v[0])):
            entries = [(tuple(k), at(v)) for k, v in state.iterator()]
            for k, t in entries:
                if t + self.ttl < now:
                    state.removeKey(k)
                else:
                    left = True
        if left:
            self._wait(timerValues)
        return iter(())


def decision_stream(stream: DataFrame, ttl_seconds: int = PERMISSION_SECONDS, buckets: int = 16, delay: str | None = None) -> DataFrame:
    """Rows (REQUEST) to one ANSWER for each ``check`` and ``ask``: the stream's twin of ``access.answers``.

    ``check`` brings a decision (null: it failed), ``ask`` wants the remembered one, ``void`` names a user, a file or
    neither. A tenant's users are dealt into buckets; a void without a user goes to all of them.
    """
    of = lambda user: F.pmod(F.xxhash64(user), F.lit(buckets)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = stream.withColumn("bucket", F.explode(F.when(F.col("user").isNull(), everywhere).otherwise(F.array(of(F.col("user"))))))
    # a second later than the rows say: the watermark begins at zero and would take a row of that moment for late
    timed = dealt.withColumn("_time", F.timestamp_seconds(F.col("at") + 1)).withWatermark("_time", delay or f"{max(1, ttl_seconds)} seconds")
    return timed.groupBy("tenant", "bucket").transformWithStateInPandas(Decisions(ttl_seconds), StructType.fromDDL(ANSWER), "Append", "EventTime")


class Seen(StatefulProcessor):
    """The last ``most`` event ids that were new, in the order they came; the oldest is forgotten first."""

    def __init__(self, most: int, fields: list[str], order: list[str], names: list[str]):
        self.most, self.fields, self.order, self.names = most, fields, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getMapState("ids", "event_id string", "n long")
        self.turn = handle.getMapState("turn", "n long", "event_id string")
        self.span = handle.getValueState("span", "first long, next long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).set_axis(self.names, axis=1)  # names with a leading underscore arrive as places
        if self.order:
            frame = frame.sort_values(self.order, kind="stable")
        first, after = self.span.get() if self.span.exists() else (0, 0)
        keep = []
        for event_id in frame["_id"]:
            if event_id == "":
                keep.append(True)
                continue
            new = not self.ids.containsKey((event_id,))
            keep.append(new)
            if new:
                self.ids.updateValue((event_id,), (after,))
                self.turn.updateValue((after,), (event_id,))
                after += 1
                if after - first > self.most:
                    self.ids.removeKey((self.turn.getValue((first,))[0],))
                    self.turn.removeKey((first,))
                    first += 1
        self.span.update((first, after))
        yield frame.loc[keep, self.fields]


def seen_within(stream: DataFrame, most: int = DEDUPE_EVENTS, shards: int = 1, order: tuple[str, ...] = (), key: Column | str = "event_id") -> DataFrame:
    """Events of which no equal id is among the last ``most`` new ones; those without an id all pass. The stream's twin of ``events.first_within``.

    With shards each remembers its own last ``most`` of the ids that fall to it, so the memory and the work are dealt out.
    """
    dealt = stream.withColumn("_id", F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit("")))
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("_shard").transformWithStateInPandas(Seen(most, stream.columns, list(order), dealt.columns), stream.schema, "Append", "None")
