"""A workbook of titled tables, one sheet a topic, written as XLSX with the standard library; small collected tables only."""

from __future__ import annotations

import re
from pathlib import Path
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, ZipFile

from .scatter import SIZE, scatter_png

#: Rows of a table that is still a report.
MOST_ROWS = 10_000


class ResultBook:
    def __init__(self):
        self.sheets: dict[str, list[list]] = {}
        #: By sheet: pictures as PNG, with the row and column of their upper left corner and their size in pixels.
        self.pictures: dict[str, list[tuple[bytes, int, int, int, int]]] = {}

    def put(self, sheet: str, title: str, columns: list[str], rows: list) -> None:
        """Adds a titled table under those already on the sheet."""
        at = self.sheets.setdefault(sheet, [])
        if at:
            at.append([])
        at += [[title], list(columns), *[[r.get(c) for c in columns] if isinstance(r, dict) else list(r) for r in rows]]

    def put_frame(self, sheet: str, title: str, df) -> None:
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError("too many rows for a report")
        self.put(sheet, title, df.columns, [tuple(r) for r in rows])

    def replace(self, sheet: str) -> None:
        self.sheets.pop(sheet, None)
        self.pictures.pop(sheet, None)

    def put_scatter(self, sheet: str, title: str, columns: list[str], rows: list[dict], x: str, y: str) -> None:
        """Adds the plotted table, and its picture to the right of it."""
        at = len(self.sheets.get(sheet, []))
        self.put(sheet, title, columns, rows)
        png = scatter_png([r[x] for r in rows], [r[y] for r in rows])
        self.pictures.setdefault(sheet, []).append((png, at, len(columns) + 1, SIZE[1], SIZE[0]))

    def save(self, path: str) -> None:
        """Writes a temporary file, then renames it."""
        names = list(self.sheets)
        part = Path(f"{path}.part")
        with ZipFile(part, "w", ZIP_DEFLATED) as z:
            head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
            drawn = "".join(f'<Override PartName="/xl/drawings/drawing{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/>' for i, n in enumerate(names, 1) if n in self.pictures)
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/>{drawn}<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            sheets = "".join(f'<sheet name="{escape(re.sub(r"[][*?:/\\\\]", " ", n)[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
            z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
            links = "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
            for i, n in enumerate(names, 1):
                drawing = '<drawing xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="r1"/>' if n in self.pictures else ""
                z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(self._row(k, r) for k, r in enumerate(self.sheets[n], 1))}</sheetData>{drawing}</worksheet>')
                if n in self.pictures:
                    self._draw(z, head, i, self.pictures[n])
        part.rename(path)

    @staticmethod
    def _draw(z: ZipFile, head: str, i: int, pictures: list) -> None:
        """The drawing of sheet i, with its pictures."""
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        pixel = 9525  # in the unit of drawings
        relations = lambda links: f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
        z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", relations(f'<Relationship Id="r1" Type="{kind}/drawing" Target="../drawings/drawing{i}.xml"/>'))
        links, shapes = "", ""
        for k, (png, row, column, width, height) in enumerate(pictures, 1):
            z.writestr(f"xl/media/image{i}_{k}.png", png)
            links += f'<Relationship Id="r{k}" Type="{kind}/image" Target="../media/image{i}_{k}.png"/>'
            at, size = f"<xdr:from><xdr:col>{column}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>", f'cx="{width * pixel}" cy="{height * pixel}"'
            shapes += f'<xdr:oneCellAnchor>{at}<xdr:ext {size}/><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{k}" name="Picture {k}"/><xdr:cNvPicPr/></xdr:nvPicPr><xdr:blipFill><a:blip r:embed="r{k}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill><xdr:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr></xdr:pic><xdr:clientData/></xdr:oneCellAnchor>'
        z.writestr(f"xl/drawings/_rels/drawing{i}.xml.rels", relations(links))
        z.writestr(f"xl/drawings/drawing{i}.xml", f'{head}<xdr:wsDr xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="{kind}">{shapes}</xdr:wsDr>')

    @staticmethod
    def _row(k: int, values: list) -> str:
        cells = []
        for v in values:
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
                cells.append(f"<c><v>{v!r}</v></c>")
            else:
                cells.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>')
        return f'<row r="{k}">{"".join(cells)}</row>'


def read_sheet(path: str, sheet: str) -> list[list]:
    """The rows of a sheet of a book written here: numbers, and texts (blank for null)."""
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with ZipFile(path) as z:
        names = [x.get("name") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{space}sheet")]
        rows = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{names.index(sheet) + 1}.xml")).iter(f"{space}row")
        value = lambda c: "".join(c.itertext()) if c.get("t") == "inlineStr" else float(c.findtext(f"{space}v"))
        return [[value(c) for c in r.iter(f"{space}c")] for r in rows]


def text_report(title: str, metrics: list[tuple[str, object]]) -> str:
    """Aligned lines, thousands grouped."""
    show = lambda v: f"{v:,}" if isinstance(v, int) else f"{v:.4f}" if isinstance(v, float) else str(v)
    width = max((len(k) for k, _ in metrics), default=0)
    return "\n".join([title, "=" * len(title), *[f"{k.ljust(width)}  {show(v)}" for k, v in metrics]]) + "\n"
