"""Writes tiny workbooks for the tests."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

STYLES = """<?xml version="1.0"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">
<numFmts count="2"><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>
<cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>"""
BOOK = """<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr{flag}/>
<sheets><sheet name="Data" sheetId="7" r:id="rId3"/><sheet name="Other" sheetId="1" r:id="rId1"/></sheets></workbook>"""
LINKS = """<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId3" Target="worksheets/sheet9.xml"/></Relationships>"""
SHEET = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def letters(at: int) -> str:
    name, at = "", at + 1
    while at:
        at, rest = divmod(at - 1, 26)
        name = chr(65 + rest) + name
    return name


def write_book(path, rows: dict[int, list], epoch_1904: bool = False) -> None:
    """`rows` maps sheet row numbers to cells: None, text, number, bool, ("date", serial, style), ("error",), ("inline", text)."""
    strings, body = [], []
    for number, cells in rows.items():
        parts = []
        for at, value in enumerate(cells):
            spot = f'r="{letters(at)}{number}"'
            if value is None:
                continue
            if isinstance(value, tuple):
                kind = value[0]
                if kind == "date":
                    parts.append(f'<c {spot} s="{value[2]}"><v>{value[1]}</v></c>')
                elif kind == "inline":
                    parts.append(f'<c {spot} t="inlineStr"><is><r><t>{escape(value[1])}</t></r></is></c>')
                else:
                    parts.append(f'<c {spot} t="e"><v>#N/A</v></c>')
            elif isinstance(value, bool):
                parts.append(f'<c {spot} t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, str):
                strings.append(f"<si><t>{escape(value)}</t></si>")
                parts.append(f'<c {spot} t="s"><v>{len(strings) - 1}</v></c>')
            else:
                parts.append(f"<c {spot}><v>{value!r}</v></c>")
        body.append(f'<row r="{number}">{"".join(parts)}</row>')
    shared = '<?xml version="1.0"?><sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(strings) + "</sst>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", "<Types/>")
        book.writestr("xl/workbook.xml", BOOK.format(flag=' date1904="1"' if epoch_1904 else ""))
        book.writestr("xl/_rels/workbook.xml.rels", LINKS)
        book.writestr("xl/styles.xml", STYLES)
        book.writestr("xl/sharedStrings.xml", shared)
        book.writestr("xl/worksheets/sheet9.xml", SHEET.format("".join(body)))
        book.writestr("xl/worksheets/other.xml", SHEET.format(""))
