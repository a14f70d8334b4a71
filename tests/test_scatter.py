import struct
import zlib
from xml.etree import ElementTree
from zipfile import ZipFile

import numpy as np

from reachforge.sources import resultbook
from reachforge.sources.scatter import HALF, MARGIN, SIZE, scatter_png


def pixels(png):
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data = 8, b""
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


def test_points_lie_where_their_values_say():
    p = pixels(scatter_png([0.0, 1.0, 0.5, None], [0.0, 1.0, 1.0, 0.3], diagonal=False))
    assert p.shape == SIZE
    at = {(SIZE[0] - MARGIN, MARGIN), (MARGIN, SIZE[1] - MARGIN), (MARGIN, SIZE[1] // 2)}
    assert all((p[r - HALF : r + HALF + 1, c - HALF : c + HALF + 1] == 20).all() for r, c in at) and (p == 20).sum() == 3 * (2 * HALF + 1) ** 2
    assert (pixels(scatter_png([], [])) == 20).sum() == 0 and (pixels(scatter_png([2.0], [2.0])) == 20).any()


def test_a_picture_stands_beside_its_table(tmp_path):
    book, rows = resultbook.ResultBook(), [{"cell": "a", "observed": 0.2, "predicted": 0.25}, {"cell": "b", "observed": 0.6, "predicted": 0.5}]
    book.put("plain", "none", ["a"], [(1,)])
    book.put_scatter("fit", "Observed and predicted", ["cell", "observed", "predicted"], rows, "observed", "predicted")
    book.save(str(tmp_path / "b.xlsx"))
    assert resultbook.read_sheet(str(tmp_path / "b.xlsx"), "fit")[2:] == [["a", 0.2, 0.25], ["b", 0.6, 0.5]]
    with ZipFile(tmp_path / "b.xlsx") as z:
        for name in z.namelist():
            if name.endswith((".xml", ".rels")):
                ElementTree.fromstring(z.read(name))
        assert z.read("xl/media/image2_1.png") == scatter_png([0.2, 0.6], [0.25, 0.5])
        assert b"drawing2.xml" in z.read("xl/worksheets/_rels/sheet2.xml.rels") and b"<drawing" in z.read("xl/worksheets/sheet2.xml") and b"<drawing" not in z.read("xl/worksheets/sheet1.xml")
    book.replace("fit")
    assert not book.pictures
