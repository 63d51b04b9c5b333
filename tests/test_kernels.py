"""Parsers and alignment kernels, without a session."""

import json
import random
import zlib

import pytest

from palimpsest.operators.sequence import lcs
from palimpsest.session import first_of, settings, stripped
from palimpsest.sources import gltf, pdf, step
from palimpsest.streaming.events import metrics_text


def length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_lcs_is_longest_ordered_and_equal():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 14)) for _ in range(2))
        pairs, refused = lcs(a, b)
        assert not refused and len(pairs) == length(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_lcs_ties_advance_the_old_side_and_caps_refuse():
    assert lcs(["a", "b"], ["b", "a"])[0] == [(1, 0)]
    assert lcs(["a"] * 3, ["a"] * 3, most_cells=8) == ([], True)


def triangle(dx=0.0, name="t"):
    v = [dx + 0, 0, 0, dx + 1, 0, 0, dx + 0, 1, 0]
    return gltf.write_glb({"g": [(name, v, [0, 1, 2])]})


def test_glb_round_trip():
    (e,) = gltf.parse(triangle(10.0))
    assert e["verts"] == [10, 0, 0, 11, 0, 0, 10, 1, 0] and e["faces"] == [0, 1, 2] and e["stable_id"] == ""


def test_z_up_turns_by_one_root_node_and_keeps_the_buffer():
    doc, binary = gltf.container(gltf.write_glb({"g": [("t", [0, 0, 0, 1, 0, 0, 0, 1, 0], [])]}, z_up=True))
    flat, same = gltf.container(gltf.write_glb({"g": [("t", [0, 0, 0, 1, 0, 0, 0, 1, 0], [])]}))
    assert binary == same and len(doc["nodes"]) == len(flat["nodes"]) + 1 and "rotation" in doc["nodes"][-1]


def test_gltf_bakes_nested_transforms():
    doc = json.loads(json.dumps({"asset": {"version": "2.0"}, "nodes": [{"translation": [1, 0, 0], "children": [1]}, {"mesh": 0, "scale": [2, 2, 2]}], "scenes": [{"nodes": [0]}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}}]}], "accessors": [{"componentType": 5126, "type": "VEC3", "count": 1}]}))
    (e,) = gltf.parse(json.dumps(doc).encode())
    assert e["verts"] == [1, 0, 0] and e["faces"] == [0]


@pytest.mark.parametrize("raw", [b"", b"{}", b"glTF", b"nonsense"])
def test_unreadable_gltf_is_a_problem(raw):
    assert gltf.parse(raw) == [{"problem": "unreadable-gltf"}]


IFC = b"""ISO-10303-21;HEADER;FILE_SCHEMA(('IFC4'));ENDSEC;DATA;
#1=IFCWALL('0123456789012345678901',#9,'Wall; A',$,$,#5,#6,$);
#2=IFCSPACE('0123456789012345678902',#9,'Room',$,$,#5,#6,$);
#3=IFCPROPERTYSINGLEVALUE('FireRating',$,IFCLABEL('REI 60'),$);
#4=IFCPROPERTYSET('x',#9,'Pset_WallCommon',$,(#3));
#7=IFCRELDEFINESBYPROPERTIES('y',#9,$,$,(#1),#4);
ENDSEC;END-ISO-10303-21;"""


def test_step_products_and_property_sets():
    shape = {"0123456789012345678901": ((0, 0, 0, 1, 0, 0, 0, 1, 0), (0, 1, 2))}
    (e,) = step.parser(lambda _: shape)(IFC)
    assert e["stable_id"] == "0123456789012345678901" and e["name"] == "Wall; A"
    assert e["properties"] == {"Pset_WallCommon.FireRating": "REI 60"}
    assert step.parser(None)(IFC) == [{"problem": "no-geometry:0123456789012345678901"}]


def page(stream: bytes, flate=False) -> bytes:
    body = zlib.compress(stream) if flate else stream
    head = b"<</Length %d%s>>" % (len(body), b"/Filter/FlateDecode" if flate else b"")
    return b"%PDF-1.4\n1 0 obj<</Type/Pages/Kids[2 0 R]>>endobj\n2 0 obj<</Type/Page/Parent 1 0 R/MediaBox[0 0 595 842]/Contents 3 0 R>>endobj\n3 0 obj" + head + b"stream\n" + body + b"\nendstream endobj"


@pytest.mark.parametrize("flate", [False, True])
def test_pdf_objects(flate):
    s = b"q 1 0 0 1 10 0 cm 72 600 100 50 re S Q BT /F1 12 Tf 72 700 Td (Hi \\(x\\)) Tj [(a) -20 (b)] TJ ET BI /W 2 /H 2 ID \x00\x01\x02\x03 EI zz"
    rows = pdf.parse(page(s, flate))
    assert [r["kind"] for r in rows] == ["path", "text", "text", "image"] and rows[0]["x"] == 82.0 and rows[0]["width"] == 595.0
    assert rows[1]["text"] == "Hi (x)" and rows[1]["signature"] == "T|/F1|12.0|Hi (x)" and rows[2]["text"] == "ab"
    assert rows[3]["signature"].startswith("I|2x2|") and rows[0]["unknown_ops"] == ["zz"] and rows[0]["has_raster"]


def test_moved_paths_keep_their_signature():
    a, b = (pdf.page_objects(b"%d 10 20 30 re f" % x)[0][0] for x in (5, 50))
    assert a["signature"] == b["signature"] and b["x"] - a["x"] == 45.0


def test_bad_pdf_is_a_problem():
    assert pdf.parse(b"nope") == [{"problem": "open-failed"}]


def test_settings(tmp_path):
    f = tmp_path / ".env"
    f.write_text("# c\nA='x # y'\nexport B=2 # two\nC=\n")
    s = settings(str(f), {"B": "3"})
    assert s == {"A": "x # y", "B": "3", "C": ""} and first_of(s, "C", "B", default="d") == "3" and first_of(s, "Z", default="d") == "d"
    assert stripped(' "q" ') == "q"


def test_metrics_text_escapes():
    t = metrics_text([("a", "h", "gauge", 2.0, {"l": 'x"\n'}), ("a", "h", "gauge", 0.5, {})])
    assert t == '# HELP a h\n# TYPE a gauge\na{l="x\\"\\n"} 2\na 0.5\n'


def objects_in_a_stream(body: bytes = b"72 600 100 50 re S", flate=True, extra=b"") -> bytes:
    """A file whose pages are in an object stream, as most since version 1.5 are."""
    inner = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 300 400]>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>")]
    heads, at = [], 0
    for n, x in inner:
        heads.append(b"%d %d" % (n, at))
        at += len(x) + 1
    head = b" ".join(heads) + b" "
    packed = zlib.compress(head + b" ".join(x for _, x in inner))
    out = b"%PDF-1.5\n5 0 obj<</Type/ObjStm/N 3/First " + b"%d/Length %d/Filter/FlateDecode>>stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    return out + b"4 0 obj<</Length %d>>stream\n" % len(body) + body + b"\nendstream endobj\n6 0 obj<</Type/XRef/Root 1 0 R" + extra + b"/Length 0>>stream\n\nendstream endobj"


def test_pdf_object_streams_and_inherited_boxes():
    (r,) = pdf.parse(objects_in_a_stream())
    assert (r["kind"], r["x"], r["width"], r["height"]) == ("path", 72.0, 300.0, 400.0)


@pytest.mark.parametrize("tail", [b"", b" ", b" % note", b"\n\n", b" ) > }"])
def test_what_ends_a_content_is_no_operator(tail):
    objects, unknown, _ = pdf.page_objects(b"% head\n1 2 3 4 re S" + tail)
    assert len(objects) == 1 and all(x in ")>}" for x in unknown)


def test_long_digits_that_are_no_number_are_read_once():
    import time

    from palimpsest.sources.pdf_file import Ref, Values

    began = time.perf_counter()
    assert [*Values(b"1" * 30000 + b"x 2")] == ["1" * 30000 + "x", 2.0]
    assert time.perf_counter() - began < 2  # 20,000 digits took 8.9 s where every shorter run of them was tried
    assert [*Values(b"[1 0 R 2 3 4 R 5 0 Rx] 6 0 R")] == [[Ref(1), 2.0, Ref(3), 5.0, 0.0], 6.0, 0.0, "R"]


def test_unreadable_pdfs_are_problems():
    assert pdf.parse(objects_in_a_stream(extra=b"/Encrypt 9 0 R")) == [{"problem": "open-failed:encrypted"}]
    assert pdf.parse(b"%PDF-1.5\n1 0 obj<</Type/Catalog>>endobj") == [{"problem": "no-pages"}]


def lzw_codes(codes):
    bits, width, held, out, known = 0, 9, 0, bytearray(), 258
    for c in codes:
        held, bits = held << width | c, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


@pytest.mark.parametrize("name, packed", [(b"/ASCIIHexDecode", b"6D 20>"), (b"/RunLengthDecode", b"\x01m \x80"), (b"/ASCII85Decode", b"D#Z~>"), (b"/LZWDecode", lzw_codes([256, 109, 32, 257]))])
def test_pdf_filters(name, packed):
    import base64

    from palimpsest.sources.pdf_file import File, Stream

    want = b"m "
    packed = base64.a85encode(want) + b"~>" if name == b"/ASCII85Decode" else packed
    f = File(b"%PDF-1.4\n1 0 obj<</Filter" + name + b"/Length %d>>stream\n" % len(packed) + packed + b"\nendstream endobj")
    assert isinstance(f.objects[1], Stream) and f.decoded(f.objects[1]) == want


def test_png_predictor():
    from palimpsest.sources.pdf_file import unpredicted

    rows = [[0, 5, 6, 7], [2, 1, 1, 1], [1, 1, 1, 1], [3, 2, 2, 2], [4, 1, 0, 0]]
    out = unpredicted(bytes(x for r in rows for x in r), {"/Predictor": 15.0, "/Columns": 3.0})
    assert [*out[:12]] == [5, 6, 7, 6, 7, 8, 1, 2, 3, 2, 4, 5] and len(out) == 15


def test_gltf_leaves_out_only_what_makes_no_sense():
    doc = {"asset": {"version": "2.0"}, "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 7}}, {"attributes": {"POSITION": 0}, "indices": 9}, {"attributes": {"POSITION": 0}}]}], "accessors": [{"componentType": 5126, "type": "VEC3", "count": 2}]}
    (e,) = gltf.parse(json.dumps(doc).encode())
    assert len(e["verts"]) == 12 and e["faces"] == [2, 3]


def test_gltf_nodes_come_last_child_first_and_once():
    point = {"primitives": [{"attributes": {"POSITION": 0}}]}
    doc = {"asset": {"version": "2.0"}, "nodes": [{"children": [1, 2]}, {"mesh": 0, "translation": [1, 0, 0]}, {"mesh": 0, "children": [1, 0]}, {"mesh": 0}], "scenes": [{"nodes": [0, 3]}], "meshes": [point], "accessors": [{"componentType": 5126, "type": "VEC3", "count": 1}]}
    assert [(e["local_id"], e["verts"]) for e in gltf.parse(json.dumps(doc).encode())] == [("node-3", [0, 0, 0]), ("node-2", [0, 0, 0]), ("node-1", [1, 0, 0])]


def test_deep_scenes_need_memory_in_proportion():
    import tracemalloc

    n = 3000
    chain = {"nodes": [{"translation": [1, 0, 0], "children": [i + 1]} for i in range(n - 1)] + [{}], "scenes": [{"nodes": [0]}]}
    tracemalloc.start()
    placed = gltf.world_matrices(chain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, m[0, 3]) for i, m in placed] == [(i, min(i + 1.0, n - 1)) for i in range(n)]
    assert peak < 10_000_000  # 38 MB where each node held its whole way from the root


def test_zip_containers():
    import io
    import zipfile

    from palimpsest.functions.mime import container_kind

    def made(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, x in files.items():
                z.writestr(n.replace("__", "/"), x)
        return out.getvalue()

    assert container_kind(made(mimetype="application/epub+zip ", word__document="")) == "application/epub+zip"
    assert container_kind(made(xl__workbook="", a="")).endswith("spreadsheetml.sheet") and container_kind(made(a="x")) == "application/zip"
    assert container_kind(b"PK\3\4 cut") == "application/zip" and container_kind(made(a="x")[:-8]) == "application/zip"
