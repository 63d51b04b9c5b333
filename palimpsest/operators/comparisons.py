"""The comparisons behind the registry: pairs of files to the children of their results.

A pair row has (key, base_content, target_content, base_name, target_name, mime); a child
(CHILD) what is stored, or an ``error``: a pair that can't be compared is a row too. Tools
that a worker lacks (fonts, a rasteriser, a CAD kernel) are adapters in ``Tools``; without
one the next tier is tried and the last is a placeholder, so no page disappears.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import svg
from ..functions.mime import format_for
from ..schemas import MASK_THRESHOLD, MOST_TEXT_LINES, STATES, TIER_STABLE, UNAVAILABLE, VECTOR, XKT
from ..sources import gltf, pdf, step
from ..sources.files import lines_of
from ..sources.kernels import parsed
from . import keyed, models, score, sequence, spatial

CHILD = "key string, kind string, idx int, ext string, mime string, mode string, data binary, error string, stage string"


@dataclass(frozen=True)
class Tools:
    """Adapters; each may be missing.

    outline: a text object's (text, size, x, y, style) columns to its glyph paths, null if a glyph is missing;
    raster: (pages: key, content, page) to (key, page, png, grey array<int>); tessellate: a STEP file's bytes
    to {global id: (vertices, faces)}; cad: bytes to element rows, for the formats of CAD and meshes.
    """

    outline: Callable[[Column], Column] | None = None
    raster: Callable[[DataFrame], DataFrame] | None = None
    tessellate: Callable[[bytes], dict] | None = None
    cad: Callable[[bytes], list[dict]] | None = None


def child(kind: str, idx: Column, ext: str, mime: str, mode: Column, data: Column, *more: Column) -> list[Column]:
    own = {"kind": F.lit(kind), "idx": idx.cast("int"), "ext": F.lit(ext), "mime": F.lit(mime), "mode": mode, "data": data, "error": F.lit(None).cast("string"), "stage": F.lit(None).cast("string")}
    return [F.col("key"), *(c.alias(name) for name, c in own.items()), *more]


def failures(rows: DataFrame, stage: str, error: Column) -> DataFrame:
    """One error row for each key of ``rows``."""
    r = rows.select("key", error.alias("error")).groupBy("key").agg(F.min("error").alias("error"))
    none = {n: F.lit(None).cast(t) for n, t in (x.split() for x in CHILD.split(", ")) if n not in ("key", "error", "stage")}
    return r.select("key", *(c.alias(n) for n, c in none.items()), "error", F.lit(stage).alias("stage"))


def sides(pairs: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    return tuple(read(pairs.select("key", F.col(f"{s}_content").alias("content"))) for s in ("base", "target"))


def compare_text(pairs: DataFrame, most: int | None = MOST_TEXT_LINES) -> DataFrame:
    """Lines of both sides as one drawing; with ``most`` only so many of each side, and the child's stage says so where there are more."""
    # both sides in one pass over the pairs
    texts = F.array(*(F.struct(F.lit(k).alias("side"), lines_of(F.col(f"{s}_content"), most).alias("lines")) for k, s in enumerate(("base", "target"))))
    both = pairs.select("key", F.inline(texts)).select("key", "side", F.posexplode("lines").alias("idx", "line"))
    drawn = svg.text_pages(sequence.line_states_of(both, ["key"]), ["key"])
    note = F.lit(None).cast("string")
    if most is not None:
        # a text has no more lines than bytes, so most needn't be parted again
        cut = functools.reduce(lambda a, b: a | b, ((F.length(f"{s}_content") > most) & (F.size(lines_of(F.col(f"{s}_content"), None)) > most) for s in ("base", "target")))
        note = F.when(cut, f"only the first {most} lines of each version are compared")
    drawn = pairs.select("key", note.alias("note")).join(drawn, "key", "left")
    # two texts without a line are an empty drawing
    empty = svg.placeholder_page(F.lit(800), F.lit(30))
    return drawn.select(*child("page", F.lit(0), "svg", "image/svg+xml", F.lit(VECTOR), F.encode(F.coalesce("svg", empty), "UTF-8"), F.col("note"))).withColumn("stage", F.col("note")).drop("note")


def compare_pdf(pairs: DataFrame, tools: Tools = Tools()) -> DataFrame:
    """Each pair of pages by the first tier that works: objects, pictures, a placeholder."""
    # each file is read once; what was read is a fraction of it and is used several times
    old, new = (x.checkpoint() for x in sides(pairs, lambda f: pdf.objects(f, ["key"])))
    pages = [page_heads(x) for x in (old, new)]
    # neither side could be opened: the pair fails as a whole
    opened = pages[0].select("key").union(pages[1].select("key")).distinct()
    shut = failures(old.unionByName(new).where("problem is not null").join(opened, "key", "left_anti"), "parse", F.concat(F.lit("neither version could be opened: "), "problem"))
    seq = sequence.pair_pages(*(p.select("key", F.col("page").alias("idx"), "signature") for p in pages), ["key"]).select("key", F.col("seq").alias("unit"), F.col("old_idx").alias("old_page"), F.col("new_idx").alias("new_page"))
    numbered = [x.where("kind is not null").join(seq.select("key", "unit", F.col(f"{s}_page").alias("page")), ["key", "page"]).drop("page", "width", "height", "has_raster", "unknown_ops", "problem") for s, x in (("old", old), ("new", new))]
    outline = tools.outline or (lambda o: F.lit(None).cast("string"))
    numbered = [x.withColumn("outline", F.when(F.col("kind") == "text", outline(F.struct("text", "size", "x", "y", "style")))) for x in numbered]
    keys = ["key", "unit"]
    deltas = spatial.compare_pages(*numbered, keys).checkpoint()
    heads = seq
    for s, p in zip(("old", "new"), pages, strict=True):
        heads = heads.join(p.select("key", F.col("page").alias(f"{s}_page"), F.struct("width", "height", "problems", "n").alias(s)), ["key", f"{s}_page"], "left")
    shown = F.coalesce("new", "old")
    heads = heads.select(*keys, "old_page", "new_page", shown["width"].alias("width"), shown["height"].alias("height"), F.coalesce("old.n", F.lit(0)).alias("n_old"), F.coalesce("new.n", F.lit(0)).alias("n_new"), score.distinct_problems(F.col("old.problems"), F.col("new.problems")).alias("n_problems"))
    both = [x.withColumns({"side": F.lit(k), "outlinable": F.col("outline").isNotNull()}).select(*keys, "side", "kind", "outlinable") for k, x in enumerate(numbered)]
    possible = score.vector_possible(both[0].union(both[1]), keys)
    placed = keyed.in_order(deltas, keys, F.col("old.idx"), F.col("new.idx")).join(heads.select(*keys, "width", "height"), keys)
    drawn = svg.render_pages(placed, keys)
    matched = deltas.groupBy(*keys).agg(F.count_if("matched").alias("matched"))
    p = heads.join(possible, keys, "left").join(drawn, keys, "left").join(matched, keys, "left")
    # a page of one side only has nothing to match: it is drawn as it is
    alone = F.col("old_page").isNull() | F.col("new_page").isNull()
    conf = F.when(alone, F.lit(1.0)).otherwise(score.confidence(F.coalesce("matched", F.lit(0)), F.col("n_old"), F.col("n_new"), F.col("n_problems")))
    p = p.join(rastered(pairs, heads, tools), keys, "left")
    mode = score.page_mode(F.coalesce("possible", F.lit(False)), conf, F.col("svg"), F.col("picture"))
    blank = svg.placeholder_page(F.col("width"), F.col("height"))
    data = F.when(mode == VECTOR, F.col("svg")).otherwise(F.coalesce("picture", blank))
    return p.select(*child("page", F.col("unit"), "svg", "image/svg+xml", mode, F.encode(data, "UTF-8"))).unionByName(shut)


def page_heads(objects: DataFrame) -> DataFrame:
    """(key, page, signature, width, height, problems, n) of every page that was opened."""
    p = objects.where("page is not null").groupBy("key", "page")
    return p.agg(sequence.multiset("signature").alias("signature"), F.max("width").alias("width"), F.max("height").alias("height"), F.flatten(F.collect_set("unknown_ops")).alias("problems"), F.count("kind").alias("n"))


def rastered(pairs: DataFrame, heads: DataFrame, tools: Tools) -> DataFrame:
    """(key, unit, picture): the raster tier, null without a tool or where it gives no picture of either side."""
    if tools.raster is None:
        return heads.select("key", "unit", F.lit(None).cast("string").alias("picture"))
    r = heads
    for s, content in (("old", "base_content"), ("new", "target_content")):
        asked = heads.where(f"{s}_page is not null").select("key", F.col(f"{s}_page").alias("page")).join(pairs.select("key", F.col(content).alias("content")), "key")
        r = r.join(tools.raster(asked).select("key", F.col("page").alias(f"{s}_page"), F.col("png").alias(f"{s}_png"), F.col("grey").alias(f"{s}_grey")), ["key", f"{s}_page"], "left")
    there = F.col("old_png").isNotNull() | F.col("new_png").isNotNull()
    changed = F.exists(svg.changed_mask(F.col("old_grey"), F.col("new_grey"), MASK_THRESHOLD), lambda x: x)
    mask = F.when(~F.coalesce(changed, F.lit(True)), F.lit(b""))
    return r.select("key", "unit", F.when(there, svg.raster_page("old_png", "new_png", mask, "width", "height")).alias("picture"))


def compare_models(pairs: DataFrame, tools: Tools = Tools()) -> DataFrame:
    """Elements of both sides by the tier that their identities allow; a GLB of three groups and its description."""
    tag = F.coalesce(F.nullif(format_for("mime", "target_name"), F.lit("")), format_for("mime", "base_name"))
    typed = pairs.withColumn("format", tag)
    readers = {"gltf": gltf.parse, "ifc": step.parser(tools.tessellate), **({f: tools.cad for f in ("step", "iges", "brep", "obj", "stl")} if tools.cad else {})}

    def load(side: str) -> DataFrame:
        parts = [parsed(typed.where(F.col("format") == f).select("key", F.col(f"{side}_content").alias("content")), ["key"], "content", read, gltf.ELEMENT) for f, read in readers.items()]
        return functools.reduce(DataFrame.unionByName, parts)

    # each file is read once
    old, new = load("base").checkpoint(), load("target").checkpoint()
    problems = old.unionByName(new).where("problem is not null").groupBy("key").agg(F.collect_set("problem").alias("problems"))
    strange = failures(typed.where(F.col("format") == ""), "dispatch", F.lit("unrecognised 3D format"))
    no_tool = failures(typed.where((F.col("format") != "") & ~F.col("format").isin(*readers)), "parse", F.concat(F.lit("no geometry could be read from either version: tool missing for "), "format"))
    old, new = (x.where("problem is null and verts is not null").drop("problem") for x in (old, new))
    found = old.select("key").union(new.select("key")).distinct()
    empty = typed.where(F.col("format").isin(*readers)).join(found, "key", "left_anti").join(problems, "key", "left")
    nothing = failures(empty, "parse", F.concat(F.lit("no geometry could be read from either version: "), F.array_join(score.first_problems(F.coalesce("problems", F.array().cast("array<string>"))), ",")))
    deltas, scores = match_models(old, new, problems)
    deltas = deltas.checkpoint()
    described = models.metamodels(deltas, ["key"], scores).select(*child("metamodel", F.lit(1), "json", "application/json", F.lit(XKT), F.encode("body", "UTF-8")))
    merged = models.merged_files(deltas, ["key"]).where("glb is not null").select(*child("model", F.lit(0), "glb", "model/gltf-binary", F.lit(XKT), F.col("glb")))
    return merged.unionByName(described).unionByName(strange).unionByName(no_tool).unionByName(nothing)


def match_models(old: DataFrame, new: DataFrame, problems: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, seq, state, change, changed_properties, old, new) of models' elements, and (key, tier, confidence)."""
    body = [c for c in old.columns if c != "key"]
    tiers = score.identity_tiers(old, new, ["key"])
    stable = tiers.where(F.col("tier") == TIER_STABLE).select("key")
    shape = F.struct("verts", "faces")
    one = lambda d: keyed.last_of_each(d.join(stable, "key", "left_semi").withColumn("shape", shape), ["key", "stable_id"], ["idx"]).withColumn("row", F.struct(*body)).select("key", "stable_id", "shape", "properties", "row")
    by_id = keyed.keyed_diff(one(old), one(new), ["key", "stable_id"], "shape", "properties")
    by_id = by_id.select("key", "state", "change", "changed_properties", F.col("old.row").alias("old"), F.col("new.row").alias("new"), (F.col("old").isNotNull() & F.col("new").isNotNull()).alias("matched"))
    rest_old, rest_new = (d.join(stable, "key", "left_anti") for d in (old, new))
    pairs = spatial.compare_shapes(rest_old, rest_new, ["key"])
    row = lambda d, s: d.select("key", F.col("idx").alias(f"{s}_idx"), F.struct(*body).alias(s))
    by_shape = pairs.join(row(rest_old, "old"), ["key", "old_idx"], "left").join(row(rest_new, "new"), ["key", "new_idx"], "left")
    by_shape = by_shape.select("key", "state", F.lit(None).cast("string").alias("change"), F.array().cast("array<string>").alias("changed_properties"), "old", "new", "matched")
    deltas = keyed.in_order(by_id.unionByName(by_shape), ["key"], F.col("old.idx"), F.col("new.idx"))
    n = lambda d, name: d.groupBy("key").agg(F.count("*").alias(name))
    m = deltas.groupBy("key").agg(F.count_if("matched").alias("matched"))
    s = tiers.join(n(old, "n_old"), "key", "left").join(n(new, "n_new"), "key", "left").join(m, "key", "left").join(problems, "key", "left").na.fill(0, ["n_old", "n_new", "matched"])
    conf = score.confidence(F.col("matched"), F.col("n_old"), F.col("n_new"), F.size(F.coalesce("problems", F.array().cast("array<string>"))))
    return deltas, s.select("key", "tier", conf.alias("confidence"))


__all__ = ["CHILD", "STATES", "Tools", "UNAVAILABLE", "compare_models", "compare_pdf", "compare_text", "match_models"]
