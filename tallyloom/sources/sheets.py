"""The first sheet of an .xlsx workbook, row by row, with the standard library."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REFERS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _column(reference: str) -> int:
    """A1 to 0, AB7 to 27."""
    n = 0
    for c in reference:
        if c.isdigit():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _shows_date(form: str) -> bool:
    """Whether a number format shows a date: y, m, d or h outside of quotes, brackets and escapes."""
    return bool(re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", form), re.IGNORECASE))


def _date(serial: str, epoch1904: bool) -> str:
    """yyyy-MM-dd, with the time if it isn't midnight, of a serial number; days before March 1900 are as the format counts them."""
    value = float(serial)
    base = datetime.datetime(1904, 1, 1) if epoch1904 else datetime.datetime(1899, 12, 30 if value >= 60 else 31)
    day = base + datetime.timedelta(days=int(value), seconds=round((value - int(value)) * 86400))
    return day.date().isoformat() if day.time() == datetime.time() else day.isoformat(sep=" ")


def _strings(book: zipfile.ZipFile) -> list[str]:
    """Shared strings, their runs joined, without the readings beside them."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == _MAIN + "rPh":
                item.clear()
            elif item.tag == _MAIN + "si":
                out.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
                item.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles whose format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(_MAIN + "numFmt")}
    cells = root.find(_MAIN + "cellXfs")
    formats = [int(x.get("numFmtId") or 0) for x in cells] if cells is not None else []
    return {k for k, f in enumerate(formats) if (_shows_date(own[f]) if f in own else f in DATE_FORMATS)}


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The first sheet's part, and whether dates count from 1904."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(root.iter(_MAIN + "sheet"))
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == sheet.get(_REFERS))
    options = root.find(_MAIN + "workbookPr")
    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    return path, options is not None and options.get("date1904") in ("1", "true")


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of the first sheet, streamed from its XML; dates as yyyy-MM-dd, empty cells null, empty rows left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        path, epoch1904 = _first_sheet(book)
        strings, dates = _strings(book), _date_styles(book)

        def value(cell: ElementTree.Element) -> str | None:
            kind = cell.get("t") or "n"
            if kind == "inlineStr":
                return "".join(t.text or "" for t in cell.iter(_MAIN + "t")) or None
            text = cell.findtext(_MAIN + "v")
            if text is None or kind == "e":
                return None
            if kind == "s":
                return strings[int(text)] or None
            if kind == "b":
                return "TRUE" if text == "1" else "FALSE"
            return _date(text, epoch1904) if kind == "n" and int(cell.get("s") or 0) in dates else text or None

        with book.open(path) as f:
            number = 0
            for event, row in ElementTree.iterparse(f, ("start", "end")):
                if event == "start" and row.tag == _MAIN + "sheetData":
                    data = row
                if event == "start" or row.tag != _MAIN + "row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for cell in row.iter(_MAIN + "c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = value(cell)
                if any(c is not None for c in cells):
                    yield number, cells
                data.clear()
