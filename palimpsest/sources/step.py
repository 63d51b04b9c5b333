"""STEP physical files (and so IFC) as rows: products, names and property sets.

Tessellation needs a CAD kernel, which is an adapter: ``tessellate`` maps a file's bytes to
{global id: (vertices, faces)}. Without it every product is reported as lacking geometry.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.mime import directory, stored
from ..schemas import ELEMENT
from .kernels import parsed

#: Types that group or annotate instead of being built.
NOT_BUILT = ("IfcSite", "IfcBuilding", "IfcBuildingStorey", "IfcSpace", "IfcAnnotation", "IfcGrid", "IfcOpeningElement", "IfcProject")
_TOKEN = re.compile(r"'(?:[^']|'')*'|#\d+|[(),]|[^\s(),']+")


def instances(text: str) -> dict[str, tuple[str, list]]:
    """{#id: (TYPE, arguments)}; strings without their quotes, lists nested."""
    out = {}
    body = re.sub(r"/\*.*?\*/", "", text, flags=re.S).partition("DATA;")[2]
    for m in re.finditer(r"(#\d+)\s*=\s*([A-Z0-9_]+)\s*(\((?:'(?:[^']|'')*'|[^';])*\))\s*;", body):
        stack: list[list] = [[]]
        for t in _TOKEN.findall(m[3]):
            if t == "(":
                stack.append([])
            elif t == ")":
                last = stack.pop()
                stack[-1].append(last)
            elif t != ",":
                stack[-1].append(t[1:-1].replace("''", "'") if t[0] == "'" else t)
        out[m[1]] = (m[2], stack[0][0])
    return out


def properties(found: dict[str, tuple[str, list]]) -> dict[str, dict[str, str]]:
    """{#product: {set.property: value}} from single-value property sets."""
    out: dict[str, dict[str, str]] = {}
    for kind, args in found.values():
        if kind != "IFCRELDEFINESBYPROPERTIES":
            continue
        of, ref = args[4], args[5]
        set_kind, set_args = found.get(ref, ("", []))
        if set_kind != "IFCPROPERTYSET":
            continue
        pairs = {}
        for p in set_args[4]:
            p_kind, p_args = found.get(p, ("", []))
            if p_kind == "IFCPROPERTYSINGLEVALUE":
                value = p_args[2]
                # IFCLABEL('x') parses to the type's name followed by its list
                if isinstance(value, str) and value.startswith("IFC") and len(p_args) > 3 and isinstance(p_args[3], list):
                    value = p_args[3][0] if p_args[3] else ""
                pairs[f"{set_args[2] if set_args[2] != '$' else 'Pset'}.{p_args[0]}"] = "" if value == "$" else str(value)
        for o in of:
            out.setdefault(o, {}).update(pairs)
    return out


def unzipped(data: bytes) -> bytes:
    """The first model of a container, the data itself if it is none."""
    held = directory(data) if data.startswith(b"PK\3\4") else {}
    models = [name for name in held if name.lower().endswith((".ifc", ".step", ".stp"))]
    return stored(data, held[models[0]]) if models else data


def parser(tessellate: Callable[[bytes], dict] | None) -> Callable[[bytes], list[dict]]:
    skipped = {x.upper() for x in NOT_BUILT}

    def parse(data: bytes) -> list[dict]:
        data = unzipped(data)
        if not data.lstrip().startswith(b"ISO-10303-21"):
            return [{"problem": "open-failed:NotStep"}]
        found = instances(data.decode("latin-1"))
        shapes, props, out = tessellate(data) if tessellate else {}, properties(found), []
        for ref, (kind, args) in found.items():
            # products: global id, owner, name, description, object type, placement, representation, ...
            if kind in skipped or not kind.startswith("IFC") or len(args) < 7 or not isinstance(args[0], str) or len(args[0]) != 22 or kind.startswith("IFCREL"):
                continue
            if args[6] == "$":
                continue
            verts, faces = shapes.get(args[0], ((), ()))
            if not verts:
                out.append({"problem": f"no-geometry:{args[0]}"})
                continue
            out.append({"stable_id": args[0], "local_id": args[0], "name": "" if args[2] == "$" else args[2], "type_name": kind, "verts": [*map(float, verts)], "faces": [*map(int, faces)], "properties": props.get(ref, {}), "idx": len(out)})
        return out

    return parse


def elements(files: DataFrame, keys: list[str], tessellate: Callable[[bytes], dict] | None = None, content: str = "content") -> DataFrame:
    return parsed(files, keys, content, parser(tessellate), ELEMENT)
