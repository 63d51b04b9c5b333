"""Comparison by stable id: one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ADDED, DELETED, GEOMETRY, MODIFIED, PROPERTY, UNCHANGED


def last_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in ``order``; rows without an id take no part.

    One aggregation with a partial step per task, so a key with any number of rows costs its tasks only.
    """
    rest = [c for c in rows.columns if c not in keys]
    ok = rows.where(F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) != "")
    if not order:
        return ok.dropDuplicates(keys)
    # what can be ordered settles ties; maps can't
    by = F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest if "map<" not in ok.schema[c].dataType.simpleString()])
    top = ok.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("m"))
    return top.select(*keys, *[F.col("m")[c].alias(c) for c in rest])


def changed_keys(old: Column, new: Column) -> Column:
    """Names of map entries that differ; a missing entry equals a null one, not an empty one."""
    names = F.array_sort(F.array_union(F.coalesce(F.map_keys(old), F.array().cast("array<string>")), F.coalesce(F.map_keys(new), F.array().cast("array<string>"))))
    return F.filter(names, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))


def verdict(one_old: Column, one_new: Column, shape_differs: Column, changed: Column) -> tuple[Column, Column]:
    """(state, change): shape outranks properties; a property change alone is a modification without a visual difference."""
    both = one_old & one_new
    props = F.coalesce(F.size(changed), F.lit(0)) > 0
    state = F.when(~one_new, DELETED).when(~one_old, ADDED).when(shape_differs | props, MODIFIED).otherwise(UNCHANGED)
    change = F.when(both & shape_differs, GEOMETRY).when(both & props, PROPERTY)
    return state, change


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], shape: str, properties: str) -> DataFrame:
    """Rows unique by ``keys`` on each side; ``shape`` is compared as a value, ``properties`` as a map.

    (keys, state, change, changed_properties, old, new). The join is on the keys alone, so the
    planner is free to broadcast, hash or sort, and to reuse a partitioning by them.
    """
    body = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*body).alias("old"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("new"))
    j = o.join(n, keys, "full_outer")
    has_o, has_n = F.col("old").isNotNull(), F.col("new").isNotNull()
    changed = F.when(has_o & has_n, changed_keys(F.col(f"old.{properties}"), F.col(f"new.{properties}")))
    differs = has_o & has_n & ~F.col(f"old.{shape}").eqNullSafe(F.col(f"new.{shape}"))
    state, change = verdict(has_o, has_n, differs, changed)
    return j.select(*keys, state.alias("state"), change.alias("change"), F.coalesce(changed, F.array().cast("array<string>")).alias("changed_properties"), "old", "new")


def has_visual_delta(state: Column, change: Column) -> Column:
    return F.when(state == UNCHANGED, False).when(state == MODIFIED, F.coalesce(change == GEOMETRY, F.lit(False))).otherwise(True)


def in_order(deltas: DataFrame, keys: list[str], old_idx: Column, new_idx: Column) -> DataFrame:
    """``seq``: matched rows in the old order, then deletions, then additions."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("new").isNull(), 1).when(F.col("old").isNull(), 2).otherwise(0), old_idx, new_idx)
    return deltas.withColumn("seq", (F.row_number().over(w) - 1).cast("int"))
