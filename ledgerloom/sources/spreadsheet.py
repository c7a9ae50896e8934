"""Workbooks (XLSX) as rows of cells; a file is opened in one task, within limits that its own index is held to first."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

MOST_ROWS, MOST_COLUMNS, MOST_BYTES = 50_000, 1_000, 50 * 1024 * 1024
SCHEMA = "path string, sheet string, sheets array<string>, pos int, cells array<string>, problem string"
#: Numbers of the built-in formats that show days or times.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Unreadable(ValueError):
    """A workbook that is refused; the text says why."""


def _tree(book: zipfile.ZipFile, name: str) -> ElementTree.Element:
    body = book.read(name)
    if b"<!DOCTYPE" in body[:4096]:
        raise Unreadable("unreadable")
    root = ElementTree.fromstring(body)
    for node in root.iter():
        node.tag = node.tag.rpartition("}")[2]
    return root


def _dated_styles(book: zipfile.ZipFile) -> list[bool]:
    """Of each style of cells, whether it shows a day or time."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = _tree(book, "xl/styles.xml")
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter("numFmt")}
    shown = lambda k: bool(re.search("[ymdhs]", own[k], re.IGNORECASE)) if k in own else k in DATE_FORMATS
    return [shown(int(x.get("numFmtId", 0))) for styles in root.iter("cellXfs") for x in styles]


def _stamp(days: float, since_1904: bool) -> str:
    """A day of a sheet as ISO, with its time where it has one."""
    begin = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
    moment = begin + timedelta(seconds=round(days * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def _cell(cell: ElementTree.Element, shared: list[str], dated: list[bool], since_1904: bool) -> str:
    kind, value = cell.get("t", "n"), cell.findtext("v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter("t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in ("str", "e", "d"):
        return value
    style = int(cell.get("s", 0))
    return _stamp(float(value), since_1904) if style < len(dated) and dated[style] else _number(value)


def _column(reference: str) -> int:
    out = 0
    for letter in re.match("[A-Z]*", reference).group():
        out = out * 26 + ord(letter) - 64
    return out


def _sheet(root: ElementTree.Element, shared: list[str], dated: list[bool], since_1904: bool) -> list[list[str]]:
    """All rows of a sheet, blank ones too, as wide as its widest."""
    rows: dict[int, dict[int, str]] = {}
    at = 0
    for row in root.iter("row"):
        at = int(row.get("r", at + 1))
        if at > MOST_ROWS:
            raise Unreadable("too many rows")
        column, held = 0, rows.setdefault(at, {})
        for cell in row.iter("c"):
            column = _column(cell.get("r", "")) or column + 1
            if column > MOST_COLUMNS:
                raise Unreadable("too many columns")
            held[column] = _cell(cell, shared, dated, since_1904)
    rows = {k: v for k, v in rows.items() if v}
    width = max((max(v) for v in rows.values()), default=0)
    return [[rows.get(k, {}).get(c, "") for c in range(1, width + 1)] for k in range(1, max(rows, default=0) + 1)]


def read_workbook(content: bytes, wanted: str | None = None) -> tuple[str, list[str], list[list[str]]]:
    """(sheet, names of all sheets that hold rows, its rows): the sheet that is asked for, else the first with any."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as book:
            if sum(i.file_size for i in book.infolist()) > MOST_BYTES:
                raise Unreadable("too large")
            root = _tree(book, "xl/workbook.xml")
            since_1904 = any(p.get("date1904") in ("1", "true") for p in root.iter("workbookPr"))
            files = {r.get("Id"): r.get("Target") for r in _tree(book, "xl/_rels/workbook.xml.rels")}
            place = lambda target: target[1:] if target.startswith("/") else f"xl/{target}"
            strings = _tree(book, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in book.namelist() else []
            shared = ["".join(t.text or "" for run in ([s] if s.find("t") is not None else s.findall("r")) for t in run.findall("t")) for s in strings]
            dated = _dated_styles(book)
            filled = {}
            for s in root.iter("sheet"):
                body = _tree(book, place(files[s.get(f"{OFFICE}id")]))
                if body.find(".//c") is not None:
                    filled[s.get("name")] = body
            if not filled:
                raise Unreadable("empty")
            name = wanted if wanted in filled else next(iter(filled))
            return name, list(filled), _sheet(filled[name], shared, dated, since_1904)
    except (zipfile.BadZipFile, KeyError, IndexError, AttributeError, TypeError, ElementTree.ParseError, RuntimeError, OverflowError) as error:
        raise Unreadable("unreadable") from error
    except ValueError as error:
        raise error if isinstance(error, Unreadable) else Unreadable("unreadable") from error


def read_spreadsheets(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(path, sheet, sheets, pos, cells, problem) of workbooks (path, content); one row with a problem for each that is refused.

    Rows have the columns of ``delimited.parse`` that records and mappings need.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    if content is None:
                        raise Unreadable("unreadable")
                    name, names, rows = read_workbook(bytes(content), sheet)
                    yield pd.DataFrame({"path": path, "sheet": name, "sheets": [names] * len(rows), "pos": range(len(rows)), "cells": rows, "problem": None})
                except Unreadable as error:
                    yield pd.DataFrame({"path": [path], "sheet": [None], "sheets": [None], "pos": [0], "cells": [None], "problem": [str(error)]})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
