"""Sheets of one workbook, cell by cell; helpers of ``ranges.read_xlsx``."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets_of(file: BinaryIO) -> list[tuple[str, str]]:
    """(name, entry of the archive) of the sheets, in the workbook's order.

    The workbook's relations say which entry a sheet is; where they do not, the entries' numbers follow the order.
    """
    with zipfile.ZipFile(file) as book:
        entries = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        links: dict[str | None, str] = {}
        if "xl/_rels/workbook.xml.rels" in book.namelist():
            for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
                target = link.get("Target") or ""
                links[link.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"))
        linked = [links.get(s.get(_LINK)) for s in sheets]
        if all(e in book.namelist() for e in linked if e) and all(linked):
            return [(s.get("name"), e) for s, e in zip(sheets, linked) if e in entries]
        return [(s.get("name"), e) for s, e in zip(sheets, entries)]


def place(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as B7."""
    letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def cells_of(file: BinaryIO, entry: str) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of a sheet by row and column; merged ranges repeat their first cell, as far as the sheet has cells.

    The sheet is read twice as a stream, first for its extent and its merged ranges, which stand behind the cells; a
    row at a time and the workbook's shared texts are held.
    """
    with zipfile.ZipFile(file) as book:
        texts = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as data:
                texts = ["".join(t.text or "" for t in item.iter(f"{_SHEET}t")) for item in _ended(data, "si")]
        with book.open(entry) as data:
            height = width = -1
            merged = []
            for el in _ended(data, "row", "mergeCell"):
                if el.tag == f"{_SHEET}mergeCell":
                    merged.append([place(p) for p in el.get("ref").split(":")])
                    continue
                for c in el.iter(f"{_SHEET}c"):
                    at = place(c.get("r"))
                    height, width = max(height, at[0]), max(width, at[1])
        height = max([height, *(first[0] for first, *_ in merged)])
        width = max([width, *(first[1] for first, *_ in merged)])
        waiting = sorted(((m[0], m[-1], i) for i, m in enumerate(merged)), reverse=True)
        active: list[tuple[int, tuple, tuple, str]] = []
        done = -1

        def row(number: int, cells: dict[int, str]) -> Iterator[tuple[int, int, str]]:
            nonlocal active
            active = [m for m in active if m[2][0] >= number]
            while waiting and waiting[-1][0][0] <= number:
                first, last, i = waiting.pop()
                active.append((i, first, last, cells.get(first[1], "")))
            for _, first, last, text in sorted(active):
                for k in range(first[1], min(last[1], width) + 1):
                    cells[k] = text
            return ((number, k, cells[k]) for k in sorted(cells))

        def gap(until: int) -> Iterator[tuple[int, int, str]]:
            """Rows without cells of their own: only merged ranges fill them."""
            for number in range(done + 1, until):
                if active or (waiting and waiting[-1][0][0] <= number):
                    yield from row(number, {})

        with book.open(entry) as data:
            for el in _ended(data, "row"):
                cells = {place(c.get("r")): _text(c, texts) for c in el.iter(f"{_SHEET}c")}
                for number in sorted({r for r, _ in cells}):
                    yield from gap(number)
                    yield from row(number, {k: text for (r, k), text in cells.items() if r == number})
                    done = number
        yield from gap(height + 1)


def _text(cell: ElementTree.Element, texts: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
    value = cell.find(f"{_SHEET}v")
    text = value.text if value is not None else ""
    return texts[int(text)] if cell.get("t") == "s" and text else text or ""


def _ended(data: BinaryIO, *names: str) -> Iterator[ElementTree.Element]:
    """Elements of these names as they end, each forgotten once it is used."""
    wanted = {f"{_SHEET}{n}" for n in names}
    above: list[ElementTree.Element] = []
    for event, el in ElementTree.iterparse(data, ("start", "end")):
        if event == "start":
            above.append(el)
            continue
        above.pop()
        if el.tag in wanted:
            yield el
            if above:
                above[-1].remove(el)
