"""What a model comparison is shown with: the description of its objects, and one file of three groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import element_id
from ..schemas import STATES
from ..sources.gltf import write_glb
from .groups import by_group
from .keyed import has_visual_delta

GROUPS = ("old", "new", "difference")
#: What follows an element's id in each group, in the description as in the file.
SUFFIX = {"old": "old", "new": "new", "difference": "diff"}


def metamodels(deltas: DataFrame, keys: list[str], scores: DataFrame, project: str = "diff") -> DataFrame:
    """(keys, body): JSON of all objects by group, with states and totals.

    deltas: (keys, seq, state, change, changed_properties, old, new) with element structs;
    scores: (keys, tier, confidence). Property changes are listed but not in the difference group.
    """
    shown = F.coalesce("new", "old")
    eid = element_id(shown["stable_id"], shown["local_id"], F.col("seq"))

    def entry(group: str):
        return F.struct(
            F.coalesce("changed_properties", F.array().cast("array<string>")).alias("changedProperties"), F.coalesce("change", F.lit("")).alias("change"), F.concat(eid, F.lit(f"|{SUFFIX[group]}")).alias("id"),
            F.coalesce(F.nullif(shown["name"], F.lit("")), eid).alias("name"), F.lit(group).alias("parent"), F.col("state"), F.coalesce(F.nullif(shown["type_name"], F.lit("")), F.lit("Mesh")).alias("type"),
        )

    own = F.array(F.when(F.col("old").isNotNull(), entry("old")), F.when(F.col("new").isNotNull(), entry("new")), F.when(has_visual_delta(F.col("state"), F.col("change")), entry("difference")))
    rows = deltas.select(*keys, "seq", "state", "change", F.filter(own, lambda x: x.isNotNull()).alias("o"))
    totals = [F.count_if(F.col("state") == s).alias(s) for s in STATES] + [F.count_if(F.col("change") == c).alias(f"{c}Changes") for c in ("geometry", "property")]
    m = rows.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "o"))), lambda x: x["o"])).alias("objects"), *totals).join(scores, keys)
    summary = F.struct("tier", "confidence", *STATES, "geometryChanges", "propertyChanges")
    # the project and the groups are objects too, above those of the elements
    typed = lambda i, parent, kind, name=None: F.struct(F.array().cast("array<string>").alias("changedProperties"), F.lit("").alias("change"), F.lit(i).alias("id"), F.lit(name or i).alias("name"), F.lit(parent).cast("string").alias("parent"), F.lit(None).cast("string").alias("state"), F.lit(kind).alias("type"))
    above = F.array(typed(project, None, "Project", "Difference"), *(typed(g, project, "Layer") for g in GROUPS))
    return m.select(*keys, F.to_json(F.struct(F.lit(project).alias("id"), F.lit(project).alias("projectId"), F.concat(above, F.col("objects")).alias("metaObjects"), summary.alias("diffSummary"))).alias("body"))


def merged_files(deltas: DataFrame, keys: list[str], z_up: bool = False) -> DataFrame:
    """(keys, glb): the old side, the new side and what differs to the eye, as groups of one GLB for each pair.

    A node bears the id that its object has in ``metamodels``: the element's, with its group.
    """
    shown = F.coalesce("new", "old")
    eid = element_id(shown["stable_id"], shown["local_id"], F.col("seq"))
    flat = deltas.select(*keys, "seq", eid.alias("eid"), has_visual_delta(F.col("state"), F.col("change")).alias("visual"), *[F.col(side)[c].alias(f"{side}_{c}") for side in ("old", "new") for c in ("verts", "faces")])

    def kernel(key: tuple, g: dict[str, list]) -> list[tuple]:
        groups: dict[str, list] = {name: [] for name in GROUPS}
        for i, eid in enumerate(g["eid"]):
            sides = {s: (g[f"{s}_verts"][i], g[f"{s}_faces"][i] or []) for s in ("old", "new") if g[f"{s}_verts"][i]}
            if g["visual"][i] and sides:
                sides["difference"] = sides.get("new") or sides["old"]
            for name, mesh in sides.items():
                groups[name].append((f"{eid}|{SUFFIX[name]}", *mesh))
        return [(*key, write_glb(groups, z_up) if any(groups.values()) else None)]

    return by_group(flat, keys, ["seq"], kernel, "glb binary")
