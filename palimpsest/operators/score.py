"""How far a comparison can be trusted, which mode it ends in, and its totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FAILED, GEOMETRY, LEAST_CONFIDENCE, MIXED, PROPERTY, RASTER, READY, STATES, TIER_GEOMETRY, TIER_STABLE, UNAVAILABLE, VECTOR


def state_counts(deltas: DataFrame, keys: list[str]) -> DataFrame:
    extra = [F.count_if(F.col("change") == c).alias(f"{c}_changes") for c in (GEOMETRY, PROPERTY)] if "change" in deltas.columns else []
    return deltas.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], *extra)


def confidence(matched: Column, n_old: Column, n_new: Column, n_problems: Column) -> Column:
    """Share of the smaller side that is matched, at most 1 / (1 + distinct problems); 1 if a side is empty."""
    smaller = F.least(n_old, n_new)
    return F.when(smaller == 0, F.lit(1.0)).otherwise(F.bround(F.least(matched / smaller, F.lit(1.0) / (F.lit(1) + n_problems)), 4))


def trustworthy(value: Column) -> Column:
    return value >= LEAST_CONFIDENCE


def distinct_problems(*lists: Column) -> Column:
    """Number of different entries in the lists together."""
    out = F.array().cast("array<string>")
    for x in lists:
        out = F.array_union(out, F.coalesce(x, F.array().cast("array<string>")))
    return F.size(out)


def first_problems(problems: Column, n: int = 4) -> Column:
    return F.slice(F.array_sort(F.array_distinct(problems)), 1, n)


def identity_tiers(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tier): stable ids carry the comparison if more than half of either side's elements have one."""
    def share(d: DataFrame, s: str) -> DataFrame:
        return d.groupBy(*keys).agg((F.count_if(F.coalesce("stable_id", F.lit("")) != "") * 2 > F.count("*")).alias(s))

    j = share(old, "a").join(share(new, "b"), keys, "full_outer")
    both = F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))
    return j.select(*keys, F.when(both, TIER_STABLE).otherwise(TIER_GEOMETRY).alias("tier"))


def image_only(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that show pictures and nothing else."""
    return objects.groupBy(*keys).agg((F.bool_or(F.col("kind") == "image") & ~F.bool_or(F.col("kind") != "image")).alias("image_only"))


def vector_possible(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, possible) of page pairs from the objects of both sides (``side`` 0/1, ``outlinable`` for texts).

    Neither side is a scan, not both are empty, and every text can be drawn.
    """
    scan = lambda s: F.coalesce(F.bool_and(F.when(F.col("side") == s, F.col("kind") == "image")), F.lit(False))
    texts = F.coalesce(F.bool_and(F.when(F.col("kind") == "text", F.coalesce("outlinable", F.lit(False)))), F.lit(True))
    return objects.groupBy(*keys).agg((~scan(0) & ~scan(1) & texts & (F.count("*") > 0)).alias("possible"))


def page_mode(possible: Column, conf: Column, svg: Column, raster: Column) -> Column:
    """Vector if it is possible, trusted and drawn, else raster, else unavailable."""
    return F.when(possible & trustworthy(conf) & svg.isNotNull(), VECTOR).when(raster.isNotNull(), RASTER).otherwise(UNAVAILABLE)


def overall(children: DataFrame, keys: list[str], override: Column | None = None) -> DataFrame:
    """Children (keys, kind, idx, mode) to (keys, status, mode, units): failed if nothing could be shown."""
    modes = F.sort_array(F.collect_set("mode"))
    c = children.groupBy(*keys).agg(modes.alias("modes"), F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "kind", "mode"))).alias("units"), F.bool_and(F.col("mode") == UNAVAILABLE).alias("nothing"))
    status = F.when(F.col("nothing"), FAILED).otherwise(READY)
    own = F.when(F.size("modes") == 1, F.col("modes")[0]).otherwise(MIXED)
    return c.select(*keys, status.alias("status"), (own if override is None else F.coalesce(override, own)).alias("mode"), "units")


def mode_without_children(status: Column) -> Column:
    return F.when(status == FAILED, RASTER).otherwise(VECTOR)


def is_ready(status: Column, n_children: Column) -> Column:
    return (status == READY) & (n_children > 0)
