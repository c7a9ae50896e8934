"""Delimited files: what separates their fields, where their header is, what their columns mean, and the movements in them.

Files are rows (path, text), bounded by the upload limit.  They are cut into rows and fields by one regular
expression each, JVM-side; what holds for a whole file (its delimiter, header, order of dates) is told of the
array of its rows, without a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import bound, date_order_of, day_part, from_debit_credit, parse_amount, read_currency, read_date, trimmed, unaccented
from ledgerloom.sources.shapes import header_of, header_rows
from ledgerloom.sources.statements import read_camt, read_mt940, read_ofx, read_qif, sniff_format

#: In the order in which they win a tie.
DELIMITERS = (",", ";", "\t", "|")
HEAD = 8192
UNIT = "\x1f"
ORDERS = ("dmy", "mdy", "ymd")


def _field(delimiter: str) -> str:
    """One field and what ends it: quoted where it begins with a quote, in which quotes are doubled, else up to a delimiter or line's end."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return rf'(?:"((?:[^"]++|"")*+)"?+([^{d}\r\n]*+)|([^{d}\r\n]*+))({d}|\r\n|\r|\n|\z)'


def _cells(text: Column, delimiter: str) -> Column:
    """Fields of a text with their ends: array of (value, ends), ends true for a row's last."""
    pattern = F.lit(_field(delimiter))
    group = lambda k: F.regexp_extract_all(text, pattern, F.lit(k))
    ends = group(4)
    value = lambda q, rest, plain: F.concat(F.replace(q, F.lit('""'), F.lit('"')), rest, plain)
    quoted = F.zip_with(group(1), group(2), lambda q, rest: F.named_struct(F.lit("q"), q, F.lit("rest"), rest))
    values = F.zip_with(quoted, group(3), lambda x, plain: value(x["q"], x["rest"], plain))
    return F.zip_with(values, ends, lambda v, e: F.named_struct(F.lit("value"), v, F.lit("ends"), e != delimiter))


def sniff_delimiter(text: Column) -> Column:
    """The delimiter that gives the first row most fields, by the head of the text; ties go to the earlier."""
    head = F.substring(F.regexp_replace(text, "^\ufeff", ""), 1, HEAD)

    def width(d: str) -> Column:
        ends = F.transform(_cells(head, d), lambda c: c["ends"])
        return F.coalesce(F.array_position(ends, True), F.lit(0))

    ranked = F.array(*[F.struct(width(d).alias("n"), F.lit(-k).alias("early"), F.lit(d).alias("delimiter")) for k, d in enumerate(DELIMITERS)])
    return F.array_max(ranked)["delimiter"]


def _row(delimiter: str) -> str:
    """Fields up to a line's end, as ``_field`` takes them."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    field = rf'(?:"(?:[^"]++|"")*+"?+[^{d}\r\n]*+|(?!")[^{d}\r\n]*+)'
    return rf"(?:{field}{d})*+{field}(?:\r\n|\r|\n|\z)"


def _table(text: Column, delimiter: str) -> Column:
    """A text's rows, each an array of cells."""
    one = lambda row: bound(_cells(row, delimiter), lambda cells: F.transform(F.slice(cells, 1, F.array_position(F.transform(cells, lambda c: c["ends"]), True).cast("int")), lambda c: c["value"]))
    # the match at the end of a text that ends with its last row is no row
    return bound(F.regexp_extract_all(text, F.lit(_row(delimiter)), F.lit(0)), lambda rows: F.transform(F.slice(rows, 1, F.size(rows) - 1), one))


def tables(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(path, delimiter, table) of every file, RFC 4180: a quote counts at a field's start only."""
    text = F.regexp_replace("text", "^\ufeff", "")
    told = files.select("path", text.alias("text"), (F.lit(delimiter) if delimiter else sniff_delimiter(F.col("text"))).alias("delimiter"))
    cut = reduce(lambda a, d: a.when(F.col("delimiter") == d, _table(F.col("text"), d)), DELIMITERS if delimiter is None else (delimiter,), F)
    return told.select("path", "delimiter", cut.alias("table"))


def parse(files: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(path, delimiter, pos, cells) of every row of every file."""
    return tables(files, delimiter).select("path", "delimiter", F.posexplode("table").alias("pos", "cells")).withColumn("pos", F.col("pos").cast("long"))


def records(rows: DataFrame, header_row: int | None = None) -> DataFrame:
    """(path, line, header, record) of rows below the header that are not blank: values by column name, short rows filled up.

    Lines count rows that are not blank, from the header on.
    """
    told = rows.withColumn("head", F.lit(header_row)) if header_row is not None else rows.join(header_rows(rows).withColumnRenamed("header", "head"), "path")
    header = F.first(F.when(F.col("pos") == F.col("head"), F.col("cells")), ignorenulls=True).over(Window.partitionBy("path"))
    some = F.exists("cells", lambda c: trimmed(c) != "")
    body = told.withColumn("header", header).filter(F.col("header").isNotNull() & (F.col("pos") > F.col("head")) & some)
    nth = F.row_number().over(Window.partitionBy("path").orderBy("pos"))
    pairs = F.transform("header", lambda name, i: F.struct(name.alias("key"), F.coalesce(F.get("cells", i), F.lit("")).alias("value")))
    # of columns with one name the last one's value counts
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return body.select("path", (F.col("head") + nth + 1).cast("int").alias("line"), "header", F.map_from_entries(unique).alias("record"))


@dataclass(frozen=True)
class Mapping:
    """What the columns of a delimited file mean; names are those of its header."""

    booked_on: str
    amount: str | None = None
    debit: str | None = None
    credit: str | None = None
    currency: str | None = None
    fixed_currency: str | None = None
    description: str | None = None
    counterparty: str | None = None
    external_id: str | None = None
    balance: str | None = None
    status: str | None = None
    skipped: tuple[str, ...] = ()
    delimiter: str | None = None
    header_row: int | None = None
    date_order: str | None = None
    year: int | None = None
    account: str = "account"

    def __post_init__(self) -> None:
        two = self.debit is not None and self.credit is not None
        if (self.amount is None) != two or (self.amount is not None and (self.debit or self.credit)):
            raise ValueError("state one amount column, or both a debit and a credit column")
        if not self.booked_on.strip():
            raise ValueError("state the column of the day")
        if self.date_order not in (None, *ORDERS):
            raise ValueError(f"the order of dates is one of {', '.join(ORDERS)}")
        if self.year is not None and not 1900 <= self.year <= 2200:
            raise ValueError("the year lies between 1900 and 2200")

    @property
    def required(self) -> list[str]:
        return [c for c in (self.booked_on, self.amount, self.debit, self.credit) if c]


def parse_mapping(text: str) -> Mapping | None:
    """A mapping from JSON, or None where it is none: unknown keys, wrong types and contradictions are refused."""
    try:
        raw = json.loads(text)
        known = {f.name for f in fields(Mapping)}
        if not isinstance(raw, dict) or set(raw) - known:
            return None
        for k, v in raw.items():
            if not isinstance(v, list if k == "skipped" else int if k in ("header_row", "year") else str) or isinstance(v, bool):
                return None
        return Mapping(**{k: tuple(v) if k == "skipped" else v for k, v in raw.items()})
    except (ValueError, TypeError):
        return None


def fits(rows: DataFrame, mapping: Mapping) -> DataFrame:
    """(path, missing): the required columns that a file's header lacks."""
    found = rows.select("path").distinct().withColumn("header", F.lit(mapping.header_row)) if mapping.header_row is not None else header_rows(rows)
    heads = rows.join(found.select("path", F.col("header").alias("pos")), ["path", "pos"])
    return heads.select("path", "pos", F.array_except(F.array(*[F.lit(c) for c in mapping.required]), "cells").alias("missing"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(path, fingerprint): the delimiter and the trimmed names of the header, by which a remembered mapping is found again."""
    heads = rows.join(header_rows(rows).select("path", F.col("header").alias("pos")), ["path", "pos"])
    return heads.select("path", F.concat_ws(UNIT, F.array("delimiter"), F.transform("cells", lambda c: trimmed(c))).alias("fingerprint"))


def _years(rows: DataFrame, ending: int | None) -> DataFrame:
    """Add ``year`` for days written without one: each time the months go back a year has turned, and the last row's is ``ending``."""
    order = Window.partitionBy("path").orderBy("line")
    parts = r"^(\d{1,2})[/.-](\d{1,2})$"
    month = F.when(F.col("order") == "dmy", F.regexp_extract(day_part(F.col("day")), parts, 2)).otherwise(F.regexp_extract(day_part(F.col("day")), parts, 1))
    told = rows.withColumn("month", month.try_cast("int"))
    before = F.last("month", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turned = told.withColumn("turn", F.coalesce((before > F.col("month")).cast("int"), F.lit(0))).withColumn("turns", F.sum("turn").over(order))
    return turned.withColumn("year", F.lit(ending) - F.max("turns").over(Window.partitionBy("path")) + F.col("turns")).drop("month", "turn", "turns")


def ending_year(last_day: Column, today: Column) -> Column:
    """The year in which a statement's last day without one lies: today's, or the one before where that were still to come."""
    return F.when(last_day > today, F.year(today) - 1).otherwise(F.year(today))


def read(files: DataFrame, mapping: Mapping, this_year: int | None = None) -> DataFrame:
    """Movements, problems and skipped rows of delimited files, as ``mapping`` says: the candidate schema with ``balance`` and ``skipped``.

    One outcome a row, by the first that holds: a skipped status, an unreadable day, an unreadable amount, no
    currency, an unreadable currency, a movement.  A file without a required column gives one problem and no rows.
    """
    some_cell = lambda cells: F.exists(cells, lambda c: trimmed(c) != "")
    # of columns with one name the last one's value counts
    nth = lambda c: F.array_position(F.reverse("heading"), c).cast("int")
    of = lambda cells, c: trimmed(F.coalesce(F.when(nth(c) > 0, F.get(cells, F.size("heading") - nth(c))), F.lit("")))
    held = tables(files, mapping.delimiter)
    held = held.withColumn("head", F.lit(mapping.header_row) if mapping.header_row is not None else header_of(F.col("table"))).withColumn("heading", F.get("table", F.col("head")))
    held = held.withColumn("missing", F.array_except(F.array(*[F.lit(c) for c in mapping.required]), "heading"))
    body = F.filter(F.slice("table", F.col("head") + 2, F.size("table")), some_cell)
    # a file without a required column has one row, of no cells
    held = held.withColumn("body", F.when(F.size("missing") > 0, F.array(F.lit(None).cast("array<string>"))).when(F.col("heading").isNotNull(), body))
    order = F.lit(mapping.date_order) if mapping.date_order else date_order_of(F.transform("body", lambda cells: of(cells, mapping.booked_on)))["order"]
    good = held.select("path", "head", "heading", "missing", order.alias("order"), F.posexplode("body").alias("at", "cells"))
    cell = lambda c: of(F.col("cells"), c) if c else F.lit("")
    read_, line = F.col("cells").isNotNull(), F.when(F.col("cells").isNull(), F.col("head") + 1).otherwise(F.col("head") + F.col("at") + 2)
    dated = good.withColumns({"line": line.cast("int"), "day": cell(mapping.booked_on)})
    ending = mapping.year or this_year
    told = _years(dated, ending) if ending else dated.withColumn("year", F.lit(None).cast("int"))
    amount = parse_amount(cell(mapping.amount)) if mapping.amount else from_debit_credit(cell(mapping.debit), cell(mapping.credit))
    fold = lambda c: F.lower(unaccented(c))
    status = cell(mapping.status)
    skip = (status != "") & (F.exists(F.array(*[F.lit(x) for x in mapping.skipped]), lambda x: fold(x) == fold(status)) if mapping.skipped else F.lit(False))
    currency = cell(mapping.currency) if mapping.currency else F.lit(mapping.fixed_currency or "")
    some = lambda c: F.when(cell(c) != "", cell(c))
    out = told.select(
        "path", "line", some(mapping.external_id).alias("external_id"), read_date(F.col("day"), F.col("order"), F.col("year")).alias("booked_on"), amount.alias("amount"), currency.alias("said"), read_.alias("read"), "missing",
        some(mapping.description).alias("description"), some(mapping.counterparty).alias("counterparty"), F.lit(mapping.account).alias("account"),
        (parse_amount(cell(mapping.balance)) if mapping.balance else F.lit(None).cast("decimal(28,10)")).alias("balance"), F.when(skip, status).alias("skipped"))
    problem = (
        F.when(~F.col("read"), F.concat(F.lit("no column "), F.array_join("missing", ", "))).when(F.col("skipped").isNotNull(), F.lit(None).cast("string")).when(F.col("booked_on").isNull(), "unreadable date").when(F.col("amount").isNull(), "unreadable amount")
        .when(F.col("said") == "", "no currency").when(read_currency(F.col("said")).isNull(), "unreadable currency"))
    stated = lambda c: F.when(F.col("read"), c)
    return out.select(
        "path", "line", "external_id", "booked_on", stated(F.when(F.col("amount") < 0, "withdrawal").otherwise("deposit")).alias("kind"), "description", "counterparty", stated(F.col("account")).alias("account"),
        F.col("amount").cast("decimal(28,10)").alias("amount"), stated(read_currency(F.col("said"))).alias("currency"), problem.alias("problem"), "balance", "skipped")


@dataclass(frozen=True)
class Preset:
    """A bank's export: a reader of its own format, or the mapping of its columns; never both."""

    id: str
    label: str
    format: str | None = None  # mt940, qif, ofx, camt
    mapping: Mapping | None = None
    currency: str = "EUR"  # of formats that name none

    def __post_init__(self) -> None:
        if (self.format is None) == (self.mapping is None):
            raise ValueError("a preset has a format or a mapping")
        if self.format not in (None, "mt940", "qif", "ofx", "camt"):
            raise ValueError(f"no reader of {self.format}")

    def read(self, files: DataFrame, this_year: int | None = None) -> DataFrame:
        if self.mapping:
            return read(files, self.mapping, this_year)
        if self.format == "qif":
            return read_qif(files, self.currency)
        return {"mt940": read_mt940, "ofx": read_ofx, "camt": read_camt}[self.format](files)

    def matches(self, files: DataFrame) -> DataFrame:
        """(path) of the files that it reads."""
        if self.mapping:
            return fits(parse(files, self.mapping.delimiter), self.mapping).filter(F.size("missing") == 0).select("path")
        return files.filter(sniff_format(F.col("text")) == self.format).select("path")

    def ending_in(self, year: int) -> Preset:
        """The same export, of which days without a year end in ``year``."""
        return Preset(self.id, self.label, self.format, self.mapping and Mapping(**{f.name: getattr(self.mapping, f.name) for f in fields(Mapping)} | {"year": year}), self.currency)


def format_preset(format_: str, currency: str = "EUR") -> Preset:
    """The preset of a format that describes itself."""
    return Preset(f"format:{format_}", format_.upper(), format=format_, currency=currency)


def custom_preset(mapping: Mapping) -> Preset:
    return Preset("custom", "described columns", mapping=mapping)


class Presets:
    """A registry of presets by id."""

    def __init__(self, *presets: Preset) -> None:
        self.by_id: dict[str, Preset] = {}
        for p in presets:
            if p.id in self.by_id:
                raise ValueError(f"two presets {p.id}")
            self.by_id[p.id] = p

    def __getitem__(self, id_: str) -> Preset:
        return self.by_id[id_]

    @staticmethod
    def definition(text: str) -> Preset | None:
        """A preset from JSON, with keys id, label, and format or mapping; None where it is none."""
        try:
            raw = json.loads(text)
            if not isinstance(raw, dict) or set(raw) - {"id", "label", "format", "mapping", "currency"}:
                return None
            mapping = parse_mapping(json.dumps(raw["mapping"])) if "mapping" in raw else None
            return None if "mapping" in raw and mapping is None else Preset(**raw | ({"mapping": mapping} if mapping else {}))
        except (ValueError, TypeError):
            return None


def write(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    """Rows as RFC 4180 text: quotes only where needed, doubled inside."""
    rows.write.csv(path, sep=delimiter, quote='"', escape='"', header=True, emptyValue="")
