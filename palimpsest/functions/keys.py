"""Identities: signatures, hashes and names, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import KEY_CHARS, POSITION_GRID, SIZE_GRID, VERTEX_GRID

PREFIX = "diff"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cells(value: Column | str, grid: float) -> Column:
    """Number of the grid cell, rounded half to even; an integer, so there is no negative zero."""
    return F.rint(col(value) / F.lit(grid)).cast("bigint")


def quantise(value: Column | str, grid: float = POSITION_GRID) -> Column:
    return cells(value, grid).cast("double") * F.lit(grid)


def digest(text: Column, chars: int = KEY_CHARS) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def text_signature(text: Column | str, size: Column | str, font: Column | str) -> Column:
    return F.concat(F.lit("T|"), col(font), F.lit("|"), quantise(size, SIZE_GRID).cast("string"), F.lit("|"), col(text))


def path_signature(points: Column | str, ops: Column | str) -> Column:
    """Operators, then points relative to the first one."""
    p, o = col(points), F.array_join(col(ops), ",")
    first = F.try_element_at(p, F.lit(1))
    rel = F.array_join(F.transform(p, lambda q: F.concat(quantise(q["x"] - first["x"]).cast("string"), F.lit(","), quantise(q["y"] - first["y"]).cast("string"))), ";")
    return F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, F.concat(F.lit("P|"), o)).otherwise(F.concat(F.lit("P|"), o, F.lit("|"), rel))


def image_signature(data: Column | str, width: Column | str, height: Column | str) -> Column:
    return F.concat(F.lit("I|"), col(width).cast("string"), F.lit("x"), col(height).cast("string"), F.lit("|"), digest(F.coalesce(col(data), F.lit(b"")), 16))


def xobject_signature(name: Column | str) -> Column:
    return F.concat(F.lit("X|"), col(name))


def _listed(values: Column) -> Column:
    """Each item followed by a comma."""
    return F.array_join(F.transform(values, lambda v: F.concat(v.cast("string"), F.lit(","))), "")


def geometry_hash(verts: Column | str, faces: Column | str) -> Column:
    """Shape alone: vertices on a fine grid and faces; never a name, id or property."""
    v = F.transform(col(verts), lambda x: cells(x.cast("double"), VERTEX_GRID))
    return digest(F.concat(_listed(F.coalesce(v, F.array().cast("array<bigint>"))), F.lit("|"), _listed(F.coalesce(col(faces), F.array().cast("array<int>")))))


def centroid(verts: Column | str) -> Column:
    """struct(x, y, z): mean vertex, the origin for none."""
    v = F.transform(col(verts), lambda x: x.cast("double"))
    n = F.floor(F.size(v) / 3)

    def axis(k: int) -> Column:
        one = F.filter(v, lambda x, i: F.pmod(i, F.lit(3)) == k)
        return F.when(F.coalesce(n, F.lit(0)) > 0, F.aggregate(one, F.lit(0.0), lambda a, b: a + b) / n).otherwise(F.lit(0.0))

    return F.struct(axis(0).alias("x"), axis(1).alias("y"), axis(2).alias("z"))


def shape_signature(verts: Column | str, faces: Column | str, center: Column | None = None) -> Column:
    """Geometry hash about the centroid: the same wherever the shape stands; '' without vertices."""
    c = centroid(verts) if center is None else center
    rel = F.transform(col(verts), lambda x, i: x.cast("double") - F.when(F.pmod(i, F.lit(3)) == 0, c["x"]).when(F.pmod(i, F.lit(3)) == 1, c["y"]).otherwise(c["z"]))
    return F.when(F.coalesce(F.size(col(verts)), F.lit(0)) <= 0, F.lit("")).otherwise(geometry_hash(rel, faces))


def distance(a: Column, b: Column) -> Column:
    """Between two centroid structs."""
    return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in ("y", "z")), (a["x"] - b["x"]) * (a["x"] - b["x"])))


def pair_key(uid: Column | str, base: Column | str, target: Column | str, plugin: Column | str, version: Column | str) -> Column:
    """Names one comparison; base and target are not interchangeable."""
    parts = [F.coalesce(col(x).cast("string"), F.lit("")) for x in (uid, base, target, plugin, version)]
    return digest(F.concat_ws("|", *parts))


def child_name(key: Column | str, kind: Column | str, index: Column | str, ext: Column | str) -> Column:
    return F.format_string(PREFIX + ".%s.%s.%03d.%s", col(key), col(kind), col(index), col(ext))


def manifest_name(key: Column | str) -> Column:
    return F.concat(F.lit(PREFIX + "."), col(key), F.lit(".manifest.json"))


def is_own(name: Column | str) -> Column:
    return F.coalesce(F.startswith(col(name), F.lit(PREFIX + ".")), F.lit(False))


def key_of(name: Column | str) -> Column:
    parts = F.split(col(name), r"\.")
    return F.when(is_own(name) & (F.size(parts) > 2), parts[1]).otherwise(F.lit(""))


def element_id(stable: Column | str, local: Column | str, index: Column | str) -> Column:
    return F.coalesce(F.nullif(col(stable), F.lit("")), F.nullif(col(local), F.lit("")), F.concat(F.lit("e"), col(index).cast("string")))


def number(value: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(value).try_cast("double"), F.lit(default))
