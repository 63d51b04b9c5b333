"""Page drawings as strings: objects, layers and whole pages, built by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ADDED, DELETED, MODIFIED, RASTER, UNAVAILABLE, UNCHANGED, VECTOR
from .keys import col

FILLING = ("f", "F", "f*", "B", "B*", "b", "b*")
LAYERS = ("diff-old", "diff-new", "diff-changes")


def escaped(text: Column | str) -> Column:
    return F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def short(value: Column | str) -> Column:
    """Two decimals at most, none that are zero."""
    s = F.regexp_replace(F.format_string("%.2f", F.bround(col(value).cast("double"), 2)), r"\.?0+$", "")
    return F.when(s == "", F.lit("0")).otherwise(s)


def path_data(points: Column | str, ops: Column | str) -> Column:
    p = F.transform(col(points), lambda q, i: F.concat(F.when(i == 0, F.lit("M")).otherwise(F.lit("L")), short(q["x"]), F.lit(","), short(q["y"])))
    closed = F.arrays_overlap(col(ops), F.array(F.lit("re"), F.lit("h")))
    return F.concat(F.array_join(p, " "), F.when(closed & (F.size(p) > 0), F.lit(" Z")).otherwise(F.lit("")))


def stroke_width(style: Column | str) -> Column:
    w = F.regexp_extract(F.coalesce(col(style), F.lit("")), r"(?:^|;)w=([^;]*)", 1)
    return F.coalesce(w.try_cast("double"), F.lit(1.0))


def drawn(o: Column, state: Column) -> Column:
    """One page object; null if it can't be drawn here (texts need outlines, which come as ``outline``)."""
    tag = F.concat(F.lit('data-diff-state="'), state, F.lit('"'))
    d = path_data(o["points"], o["ops"])
    filled = F.arrays_overlap(o["ops"], F.array(*map(F.lit, FILLING)))
    path = F.when(filled, F.concat(F.lit("<path "), tag, F.lit(' data-diff-kind="path" d="'), d, F.lit('"/>'))).otherwise(
        F.concat(F.lit("<path "), tag, F.lit(' data-diff-kind="path" d="'), d, F.lit('" stroke-width="'), short(stroke_width(o["style"])), F.lit('" fill="none"/>'))
    )
    return (
        F.when(o["kind"] == "image", F.concat(F.lit("<g "), tag, F.lit(' data-diff-kind="image"></g>')))
        .when((o["kind"] == "path") & (d != ""), path)
        .when((o["kind"] == "text") & o["outline"].isNotNull(), F.concat(F.lit("<g "), tag, F.lit(' data-diff-kind="text">'), o["outline"], F.lit("</g>")))
    )


def layer_state(state: Column, layer: str) -> Column:
    """The old layer never shows an addition, the new one never a deletion."""
    own = {"diff-old": DELETED, "diff-new": ADDED}.get(layer)
    return state if own is None else F.when(state.isin(own, MODIFIED), state).otherwise(F.lit(UNCHANGED))


def _group(name: str, body: Column) -> Column:
    return F.concat(F.lit(f'<g id="{name}">'), body, F.lit("</g>"))


def _page(width: Column, height: Column, mode: str, body: Column) -> Column:
    w, h = short(width), short(height)
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), w, F.lit(" "), h, F.lit('" width="'), w, F.lit('" height="'), h, F.lit(f'" data-diff-mode="{mode}">'), body, F.lit("</svg>"))


def flipped(height: Column, body: Column) -> Column:
    """Pages count upwards from the bottom, drawings downwards from the top."""
    return F.concat(F.lit('<g transform="translate(0,'), short(height), F.lit(') scale(1,-1)">'), body, F.lit("</g>"))


def render_pages(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas (keys, seq, state, old, new, width, height) to one drawing for each page; null if an object can't be drawn.

    Whole-page additions and deletions are pages whose deltas all have that state.
    """
    old, new, state = F.col("old"), F.col("new"), F.col("state")
    shown = F.when(new.isNotNull(), drawn(new, state)).otherwise(drawn(old, state))
    d = deltas.select(
        *keys, "seq", "width", "height",
        F.when(old.isNotNull(), drawn(old, layer_state(state, "diff-old"))).alias("o"),
        F.when(new.isNotNull(), drawn(new, layer_state(state, "diff-new"))).alias("n"),
        F.when(state != UNCHANGED, shown).alias("c"),
        ((old.isNotNull() & drawn(old, state).isNull()) | (new.isNotNull() & drawn(new, state).isNull())).alias("failed"),
    )

    def ordered(c: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("s")))))
        return F.array_join(F.transform(rows, lambda x: x["s"]), "")

    page = d.groupBy(*keys).agg(*(ordered(c).alias(c) for c in "onc"), F.max("width").alias("width"), F.max("height").alias("height"), F.max("failed").alias("failed"))
    body = flipped(F.col("height"), F.concat(*(_group(name, F.col(c)) for name, c in zip(LAYERS, "onc", strict=True))))
    return page.select(*keys, F.when(~F.col("failed"), _page(F.col("width"), F.col("height"), VECTOR, body)).alias("svg"))


def raster_page(old_png: Column | str, new_png: Column | str, mask_png: Column | str, width: Column | str, height: Column | str) -> Column:
    """The same three layers around pictures; the changes layer holds the mask where there is one, else the new page."""
    w, h = col(width), col(height)

    def picture(data: Column, state: str) -> Column:
        s = F.concat(F.lit(f'<image data-diff-state="{state}" data-diff-kind="raster" x="0" y="0" width="'), short(w), F.lit('" height="'), short(h), F.lit('" href="data:image/png;base64,'), F.regexp_replace(F.base64(data), r"\s", ""), F.lit('"/>'))
        return F.when(F.coalesce(F.length(data), F.lit(0)) > 0, s).otherwise(F.lit(""))

    changes = picture(F.coalesce(col(mask_png), col(new_png)), MODIFIED)
    return _page(w, h, RASTER, F.concat(_group(LAYERS[0], picture(col(old_png), DELETED)), _group(LAYERS[1], picture(col(new_png), ADDED)), _group(LAYERS[2], changes)))


def placeholder_page(width: Column | str, height: Column | str) -> Column:
    """A page that nothing could draw keeps its place."""
    return _page(col(width), col(height), UNAVAILABLE, F.concat(*(_group(name, F.lit("")) for name in LAYERS)))


def text_rows(text: Column | str, line: Column, state: Column) -> Column:
    """A line of a text comparison; lines are 14 high below a margin of 8."""
    return F.concat(F.lit('<text x="8" y="'), (F.lit(22) + line * 14).cast("string"), F.lit('" data-diff-state="'), state, F.lit('" xml:space="preserve">'), escaped(text), F.lit("</text>"))


def changed_mask(old: Column, new: Column, threshold: int) -> Column:
    """Pixels of two grey pictures that differ by more than the threshold."""
    return F.zip_with(old, new, lambda a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))) > threshold)


def text_pages(states: DataFrame, keys: list[str]) -> DataFrame:
    """Line states (keys, layer, row, line, state) as one drawing for each text."""
    body = text_rows("line", F.col("row"), F.col("state"))
    layers = states.groupBy(*keys, "layer").agg(F.array_sort(F.collect_list(F.struct("row", body.alias("s")))).alias("rows"))
    one = lambda name: F.coalesce(F.max(F.when(F.col("layer") == name, F.array_join(F.transform("rows", lambda r: r["s"]), ""))), F.lit(""))
    page = layers.groupBy(*keys).agg(*(one(name).alias(f"l{i}") for i, name in enumerate(LAYERS)), F.max(F.size("rows")).alias("n"))
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 800 '), (F.lit(30) + F.col("n") * 14).cast("string"), F.lit(f'" data-diff-mode="{VECTOR}">'))
    return page.select(*keys, F.concat(head, *(_group(name, F.col(f"l{i}")) for i, name in enumerate(LAYERS)), F.lit("</svg>")).alias("svg"))


GLYPHS = "map<string,struct<path:string,advance:double>>"


def run_width(text: Column | str, size: Column, glyphs: Column, units_per_em: float = 1000.0) -> Column:
    """Width of a run from its glyphs' advances; characters without a glyph have none."""
    chars = F.filter(F.split(col(text), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda w, c: w + F.coalesce(F.try_element_at(glyphs, c)["advance"], F.lit(0.0))) * size / units_per_em


def outline(text: Column | str, size: Column, x: Column, y: Column, glyphs: Column, units_per_em: float = 1000.0) -> Column:
    """A text run as placed glyph paths from a table of glyphs (column of type GLYPHS); null if one is missing.

    A font's table is a few hundred glyphs: join it to the objects by family.
    """
    chars = F.filter(F.split(col(text), ""), lambda c: c != "")
    step = F.aggregate(
        chars,
        F.struct(F.lit("").alias("d"), F.lit(0.0).alias("w"), F.lit(True).alias("ok")),
        lambda a, c: F.struct(
            F.concat(a["d"], F.lit('<path transform="translate('), short(a["w"]), F.lit(',0)" d="'), F.coalesce(F.try_element_at(glyphs, c)["path"], F.lit("")), F.lit('"/>')).alias("d"),
            (a["w"] + F.coalesce(F.try_element_at(glyphs, c)["advance"], F.lit(0.0))).alias("w"),
            (a["ok"] & F.try_element_at(glyphs, c).isNotNull()).alias("ok"),
        ),
    )
    scale = F.format_string("%.5f", size / units_per_em)
    return F.when(step["ok"], F.concat(F.lit('<g transform="translate('), short(x), F.lit(","), short(y), F.lit(") scale("), scale, F.lit(')">'), step["d"], F.lit("</g>")))
