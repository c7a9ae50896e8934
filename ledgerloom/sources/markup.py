"""Tag languages (SGML with open leaves, XML with namespaces) as rows of one tree.

A file's nodes come in the order in which their tags open.  Names are in upper case without their prefix; a text closes the
tag that it stands in, so an end tag for it, if one follows, has nothing left to close; declarations, comments and
tags that are empty by their own slash are passed over, and an end tag closes everything down to its tag, or nothing.
Files are read one after the other in time linear in their size; rows leave a task in chunks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import decode_references

NODES = "path string, ordinal int, line int, route string, ids array<int>, value string, attributes map<string,string>"
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.map_(pa.string(), pa.string())]
_PIECE = re.compile(r"<([^>]*)>|([^<]+)")
_ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
CHUNK = 20_000
ITEMS = "array<struct<record:int,first:int,nth:int,parts:int,leaves:array<struct<at:string,value:string,ccy:string,branch:int>>>>"
_LEAVES = pa.list_(pa.struct([("at", pa.string()), ("value", pa.string()), ("ccy", pa.string()), ("branch", pa.int32())]))
_ITEMS = pa.list_(pa.struct([("record", pa.int32()), ("first", pa.int32()), ("nth", pa.int32()), ("parts", pa.int32()), ("leaves", _LEAVES)]))


def plain_name(name: str) -> str:
    return name.strip().rpartition(":")[2].upper()


def walk(text: str) -> Iterator[list]:
    """[line, route, ids, value, attributes] of each node, the root, which has no route, first; a value is complete when the next node comes."""
    root = [1, "", (0,), "", {}]
    yield root
    held, opened, ordinal, line = [root], Counter(), 0, 1
    at = text.find("<")
    if at < 0:
        return
    line += text.count("\n", 0, at)
    for found in _PIECE.finditer(text, at):
        body, words = found[1], found[2]
        here, line = line, line + found[0].count("\n")
        if body is None:
            if words := words.strip():
                top = held[-1]
                top[3] = f"{top[3]} {decode_references(words)}".strip()
                if len(held) > 1:
                    held.pop()
                    opened[top[1].rpartition("/")[2]] -= 1
            continue
        body = body.strip()
        if body[:1] in ("?", "!") or body[-1:] == "/" and body[:1] != "/":
            continue
        if body[:1] == "/":
            name = plain_name(body[1:])
            while opened[name] > 0:
                last = held.pop()[1].rpartition("/")[2]
                opened[last] -= 1
                if last == name:
                    break
            continue
        head, rest = (body.split(maxsplit=1) + ["", ""])[:2]
        name, parent = plain_name(head), held[-1]
        ordinal += 1
        marks = {plain_name(k): decode_references(a or b) for k, a, b in _ATTRIBUTE.findall(rest) if k != "xmlns" and not k.startswith("xmlns:")} if rest else {}
        node = [here, f"{parent[1]}/{name}" if parent[1] else name, (*parent[2], ordinal), "", marks]
        held.append(node)
        opened[name] += 1
        yield node


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, ordinals, nodes = [], [], []
    for batch in batches:
        for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
            path = path.as_py()
            for ordinal, node in enumerate(walk(text.as_py() or "")):
                if len(nodes) == CHUNK:  # all of them have their values by now, as a text closes its tag
                    yield _batch(paths, ordinals, nodes)
                    paths, ordinals, nodes = [], [], []
                paths.append(path)
                ordinals.append(ordinal)
                nodes.append(node)
    if nodes:
        yield _batch(paths, ordinals, nodes)


def _batch(paths: list[str], ordinals: list[int], nodes: list[list]) -> pa.RecordBatch:
    line, route, ids, value, marks = zip(*nodes, strict=True)
    columns = [paths, ordinals, line, route, ids, value, [list(m.items()) for m in marks]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in NODES.split(", ")])


def tree(files: DataFrame) -> DataFrame:
    """From (path, text): a row for each node, with its route (tags from the outermost on) and the ordinals of all nodes on it, the root's first.

    Every file has its root, of an empty route, even an empty one; a null text is empty.
    """
    return files.select("path", "text").mapInArrow(_nodes, NODES)


def cut(files: DataFrame, by: Callable[[str], Iterator[dict]], fields: str, nested: pa.DataType | None = None) -> DataFrame:
    """Rows (path, and ``fields``) that ``by`` gives for each file's text, in chunks; ``nested`` is the type of arrays."""
    names, kinds = zip(*((n, pa.int32() if k == "int" else nested if k.startswith("array") else pa.string()) for n, k in (f.split(" ", 1) for f in f"path string, {fields}".split(", "))), strict=True)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], k) for n, k in zip(names, kinds, strict=True)], list(names))
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text"), strict=True):
                for row in by(text.as_py() or ""):
                    held.append(row | {"path": path})
                    if len(held) == CHUNK:
                        yield pack()
                        held = []
        if held:
            yield pack()

    return files.select("path", "text").mapInArrow(each, f"path string, {fields}")


def _grouped(text: str, statements: tuple[str, ...], record: str, parts: str | None) -> Iterator[dict]:
    """The rows of ``records`` of one file."""
    place = lambda tags, *names: max((tags.index(n) + 1 for n in names if n in tags), default=0)

    @cache
    def told(route: str) -> tuple[int, int, int, str]:
        tags = route.split("/")
        s, r = place(tags, *statements), place(tags, record)
        return s, r, place(tags, parts) if parts else 0, "/".join(tags[max(s, r):])

    groups: dict[int, dict[int | None, dict]] = {}
    within: dict[int, set[int]] = {}
    for ordinal, (_, route, ids, value, marks) in enumerate(list(walk(text))):  # values are complete at the end
        s, r, p, at = told(route)
        base = max(s, r)
        item = groups.setdefault(ids[s] if s else 0, {}).setdefault(ids[r] if r else None, {"record": ids[r] if r else None, "first": ordinal, "leaves": []})
        if p:
            within.setdefault(item["first"], set()).add(ids[p])
        if value:
            item["leaves"].append({"at": at, "value": value, "ccy": marks.get("CCY"), "branch": ids[base + 1] if base + 1 < len(ids) else None})
    items = sorted((i for held in groups.values() for i in held.values()), key=lambda i: i["first"])
    nth = 0
    for i in items:
        nth += i["record"] is not None
        i.update(nth=nth, parts=len(within.get(i["first"], ())))
    known = {"records": nth, "booked": sum(k is not None for s, held in groups.items() if s for k in held), "statements": sum(None in held for s, held in groups.items() if s), "inside": max(i["parts"] for i in items)}
    for s, held in groups.items():
        yield known | {"statement": s, "items": list(held.values())}


def records(files: DataFrame, statements: tuple[str, ...], record: str, parts: str | None = None) -> DataFrame:
    """(path, statement, items, and what a file's rows know together) of each file and each statement; items are a struct for what stands in no record, and one for each record.

    ``statement`` and ``record`` are ordinals, 0 for what stands in no statement, null for what stands in no record; ``first`` is that of an item's
    first node, ``nth`` a record's number in document order.  ``leaves`` are those below the item that stand in none below it: a leaf has its
    route below the item's node (``at``), its value, its attribute CCY, the ordinal of the child that it stands in (``branch``), in document order.
    ``parts`` counts the nodes of that tag, ``inside`` is the most of a file's items; ``records`` are all of a file, ``booked`` those in statements.
    A file is read in the task that holds it, without a shuffle.
    """
    return cut(files, partial(_grouped, statements=statements, record=record, parts=parts), f"statement int, records int, booked int, statements int, inside int, items {ITEMS}", _ITEMS)


def leaf(*routes: str) -> Column:
    """The value of the first leaf at the first of these routes that has one; else an empty text."""
    of = lambda route: F.get(F.filter("leaves", lambda x: x["at"] == route), F.lit(0))["value"]
    each = [of(r) for r in routes]
    return F.coalesce(*each, F.lit(""))
