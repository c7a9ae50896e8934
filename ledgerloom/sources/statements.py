"""Bank statements as DataFrames.

Every reader takes whole files as rows (path, text) and gives movements in one candidate schema, with a
``problem`` for each row that cannot be read.  Files are cut into records in the task that holds them, one after the
other and without a shuffle; what a record's fields mean is told by Spark's own functions.  A file is bounded by the
upload limit below.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.text import date_order_of, parse_amount, read_currency, read_date, trimmed
from ledgerloom.sources.markup import cut, leaf, records

MOST_BYTES = 5 * 1024 * 1024
MOST_LINES = 50_000
COLUMNS = ("path", "line", "external_id", "booked_on", "kind", "description", "counterparty", "account", "amount", "currency", "problem")
EXTERNAL = "EXTERNAL"
#: The label of an account that a file does not name.
STATEMENT = "ACCOUNT"
#: References that stand for none, and the sections of QIF that hold a movement a record.
PLACEHOLDERS = ("NONREF", "NOTPROVIDED", "NOTPROVIDED.", "NA", "N/A", "NONE", "UNKNOWN", "0")
QIF_TYPES = ("bank", "cash", "ccard", "oth a", "oth l", "card", "credit card")
SILENT = "no movement in this statement"
RECORDS = "array<struct<pos:int,d:string,t:string,u:string,p:string,m:string,refused:string>>"
_RECORDS = pa.list_(pa.struct([("pos", pa.int32()), *((n, pa.string()) for n in ("d", "t", "u", "p", "m", "refused"))]))
_END = re.compile("\r\n|\r|\n")
_TAG, _OPENING = re.compile(r":([0-9]{2}[A-Z]?):"), re.compile(r"[CD][0-9]{6}([A-Z]{3})")
#: As ``functions.text.BLANK``.
_BLANKS = " \t\n\v\f\r\u00a0\u202f\u2009"


@F.pandas_udf(StringType())
def _cp1252(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace"))


def decode(files: DataFrame) -> DataFrame:
    """(path, content) as (path, text, encoding): UTF-8 where the bytes are that, else Windows-1252; no byte-order mark."""
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.col("content").cast("string")).otherwise(_cp1252("content"))
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("text"), F.when(utf8, "utf-8").otherwise("cp1252").alias("encoding"))


def sniff_format(text: Column) -> Column:
    head = F.substring(text, 1, 4096)
    return (
        F.when(head.rlike(r"(?i)OFXHEADER|<OFX>"), "ofx").when(head.rlike(r"camt\.053|<(?:\w+:)?BkToCstmrStmt"), "camt")
        .when(head.rlike(r"(?m)^:20:") & head.rlike(r"(?m)^:(?:25|60F):"), "mt940").when(head.rlike(r"(?im)^!(?:Type|Account)"), "qif").otherwise("delimited"))


def sniff_bytes(content: Column) -> Column:
    start = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(start, F.lit("25504446")), "pdf").when(F.startswith(start, F.lit("504B0304")), "xlsx").when(F.startswith(start, F.lit("D0CF11E0A1B11AE1")), "legacy-excel")


def refused(files: DataFrame) -> DataFrame:
    """(path, reason) of files over the limits."""
    lines = F.size(F.split("text", "\r\n|\r|\n"))
    per_line = sniff_format(F.col("text")).isin("delimited", "mt940", "qif")
    reason = F.when(F.octet_length("text") > MOST_BYTES, "too large").when(per_line & (lines > MOST_LINES), "too many lines")
    return files.select("path", reason.alias("reason")).filter("reason is not null")


def _shaped(rows: DataFrame) -> DataFrame:
    """Bring a reader's columns into the candidate schema; a movement's kind is by its sign unless the format says."""
    sign = F.when(F.col("amount") < 0, "withdrawal").otherwise("deposit")
    have = dict.fromkeys(rows.columns)
    blank = lambda c: F.when(trimmed(F.col(c)) != "", trimmed(F.col(c))) if c in have else F.lit(None).cast("string")
    problem = F.col("problem") if "problem" in have else F.lit(None).cast("string")
    found = F.coalesce(problem, F.when(F.col("booked_on").isNull(), "unreadable date"), F.when(F.col("amount").isNull(), "unreadable amount"), F.when(F.col("currency").isNull(), "no currency"))
    return rows.select(
        "path", F.col("line").cast("int").alias("line"), blank("external_id").alias("external_id"), "booked_on", F.coalesce(F.col("kind") if "kind" in have else F.lit(None).cast("string"), sign).alias("kind"),
        blank("description").alias("description"), blank("counterparty").alias("counterparty"), blank("account").alias("account"), F.col("amount").cast("decimal(28,10)").alias("amount"), "currency", found.alias("problem"))


def _subfields(narrative: Column) -> tuple[Column, Column]:
    """(description, counterparty) of a narrative: of numbered sub-fields ?20 to ?29 and ?60 to ?63, else ?00, and of ?32 with ?33; one without any is the description."""
    flat = F.regexp_replace(narrative, r"\n", "")
    joined = lambda codes: trimmed(F.regexp_replace(F.array_join(F.transform(F.regexp_extract_all(flat, F.lit(rf"\?(?:{codes})([^?]*)"), F.lit(1)), lambda x: x), ""), r"\s+", " "))
    told = joined("2[0-9]|6[0-3]")
    numbered = F.contains(flat, F.lit("?"))
    return F.when(~numbered, flat).when(told != "", told).otherwise(joined("00")), F.when(numbered, joined("3[23]"))


def _booked(text: str) -> Iterator[dict]:
    """The fields 61 of a file, each with what its statement names and the narrative that follows it; one row without any where there are none."""
    fields: list[tuple[int, str, list[str]]] = []
    for pos, value in enumerate(_END.split(text)):
        if found := _TAG.match(value):
            fields.append((pos, found[1], [value[found.end():]]))
        elif fields and value != "-":
            fields[-1][2].append(value)
    accounts, currencies, booked, nth = {}, {}, [], 0
    for k, (pos, tag, lines) in enumerate(fields):
        body, nth = "\n".join(lines), nth + (tag == "20")
        if tag == "25":
            accounts[nth] = max(accounts.get(nth, ""), body.strip(" "))
        elif tag in ("60F", "60M"):
            named = _OPENING.match(body)
            currencies[nth] = max(currencies.get(nth, ""), named[1] if named else "")
        elif tag == "61":
            follows = fields[k + 1] if k + 1 < len(fields) else (0, "", [])
            booked.append((nth, {"pos": pos, "body": body, "narrative": "\n".join(follows[2]) if follows[1] == "86" else None}))
    for nth, row in booked:
        yield row | {"account": accounts.get(nth), "currency": currencies.get(nth)}
    if not booked:
        yield {"pos": 0}


def read_mt940(files: DataFrame) -> DataFrame:
    """SWIFT statements: tags with continuation lines, several statements a file, years borrowed across December."""
    known = cut(files, _booked, "pos int, account string, currency string, body string, narrative string")
    line = r"^(\d{6})(\d{4})?(RC|RD|C|D)([A-Z])?([\d.,]+)([A-Z][A-Z0-9]{3})?(.*)"
    g = lambda k: F.regexp_extract(F.split("body", "\n")[0], line, k)
    year, month = (F.lit(2000) + g(1).substr(1, 2).try_cast("int")), g(1).substr(3, 2).try_cast("int")
    entry_month = g(2).substr(1, 2).try_cast("int")
    shift = F.when(entry_month - month > 6, -1).when(month - entry_month > 6, 1).otherwise(0)
    day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), d), "yyyy-MM-dd")
    value_on = day(year, month, g(1).substr(5, 2))
    booked = F.when(g(2) == "", value_on).otherwise(F.coalesce(day(year + shift, entry_month, g(2).substr(3, 2)), value_on))
    size = F.abs(parse_amount(g(5)))
    reference = F.trim(F.when(F.instr(g(7), "//") > 0, F.substring_index(g(7), "//", -1)).otherwise(F.lit("")))
    moves = known.select(
        "path", (F.col("pos") + 1).alias("line"), F.when(~F.upper(reference).isin(*PLACEHOLDERS), reference).alias("external_id"), booked.alias("booked_on"),
        F.when(g(6) == "NINT", "interest").when(g(6) == "NDIV", "dividend").when(g(6).isin("NCHG", "NCOM"), "fee").alias("kind"),
        _subfields(F.col("narrative"))[0].alias("description"), _subfields(F.col("narrative"))[1].alias("counterparty"), "account", F.when(g(3).isin("D", "RC"), -size).otherwise(size).alias("amount"), F.when(F.col("currency") != "", F.col("currency")).alias("currency"), F.when(F.col("body").isNull(), SILENT).alias("problem"))
    return _shaped(moves).withColumn("kind", F.when(~F.col("problem").eqNullSafe(SILENT), F.col("kind")))


def _lettered(text: str) -> Iterator[dict]:
    """A file's account and its records, or the types of sections that hold none to be read; a letter's first line counts."""
    section, kind, account, records, fresh = "", "bank", None, [], True
    for pos, raw in enumerate(_END.split(text)):
        value = raw.strip(_BLANKS)
        letter, told = value[:1].upper(), value[1:].strip(_BLANKS)
        if letter == "!":
            section, fresh = told.lower(), True
            if section.startswith("type:"):
                kind = section[5:].strip(_BLANKS)
                if kind not in QIF_TYPES:
                    records.append({"pos": pos, "refused": kind})
        elif value == "^":
            fresh = True
        elif section.startswith("account"):
            account = account or (told if letter == "N" and told else None)
        elif value and kind in QIF_TYPES:
            if fresh:
                records.append({"pos": pos})
                fresh = False
            if letter in "DTUPM":
                records[-1].setdefault(letter.lower(), told)
    yield {"account": account, "records": records}


def read_qif(files: DataFrame, currency: str) -> DataFrame:
    """Letter-per-line records that ``^`` or a directive ends; the order of dates is the whole file's, the account the first that it names.

    Letters may be indented or small, and the first line of a letter counts.  The payee is the description, else the memo; ``U`` stands in for ``T``.
    A section of another type, as of investments, is one problem.
    """
    day = lambda r: F.regexp_replace(r["d"], "['’]", "/")
    held = cut(files, _lettered, f"account string, records {RECORDS}", _RECORDS).withColumn("order", date_order_of(F.transform("records", day))["order"])
    rows = held.select("path", "account", "order", F.explode("records").alias("r"))
    text = lambda c: F.nullif(F.col(f"r.{c}"), F.lit(""))
    readable = F.col("r.refused").isNull()
    return _shaped(rows.select(
        "path", (F.col("r.pos") + 1).alias("line"), read_date(day(F.col("r")), F.col("order")).alias("booked_on"), parse_amount(F.coalesce(text("t"), text("u"))).alias("amount"), F.when(readable, F.lit(currency)).alias("currency"),
        F.coalesce(text("p"), text("m")).alias("description"), F.when(readable, F.coalesce("account", F.lit(STATEMENT))).alias("account"), F.concat(F.lit("only bank and card records are read, and this section is "), F.col("r.refused")).alias("problem")))


def _told(value: Column) -> Column:
    return F.nullif(trimmed(value), F.lit(""))


def _each(statements: DataFrame, own: Column) -> DataFrame:
    """Rows of statements as rows of their records and one of what stands in none, each with ``own``, told of the latter's leaves."""
    outer = F.get(F.filter("items", lambda x: x["record"].isNull()), F.lit(0))
    told = statements.withColumn("leaves", outer["leaves"]).withColumn("own", F.when(F.col("leaves").isNotNull(), own)).drop("leaves")
    return told.select(*(c for c in told.columns if c != "items"), F.explode("items").alias("x")).select(*(c for c in told.columns if c != "items"), "x.*")


def _ofx(files: DataFrame) -> DataFrame:
    """Rows of bank and card statements, each with the account and currency that it names itself; a file with neither tag but with records is one statement."""
    named = lambda tag: F.get(F.filter("leaves", lambda x: F.element_at(F.split(x["at"], "/"), -1) == tag), F.lit(0))["value"]
    own = F.struct(_told(F.coalesce(F.nullif(leaf("BANKACCTFROM/ACCTID", "CCACCTFROM/ACCTID"), F.lit("")), named("ACCTID"))).alias("account"), _told(F.coalesce(F.nullif(leaf("CURDEF"), F.lit("")), named("CURDEF"))).alias("currency"))
    rows = _each(records(files, ("STMTRS", "CCSTMTRS"), "STMTTRN", parts="INVSTMTRS"), own)
    whole = (F.col("statements") == 0) & (F.col("inside") == 0)
    # what stands in no statement counts as one where the file has none
    return rows.withColumns({"investments": F.col("inside") > 0, "counts": (F.col("statement") > 0) | whole, "counted": F.when(whole, F.col("records")).otherwise(F.col("booked"))})


def read_ofx(files: DataFrame) -> DataFrame:
    """OFX 1 (tags not closed) and 2: all bank and card statements of a file; files of investments alone are refused with a problem.

    The name is the description, else the memo; only a structured payee is a counterparty.
    """
    kind = F.upper(leaf("TRNTYPE"))
    told = F.col("record").isNotNull() & F.col("counts")
    # the outermost row tells of a file without records
    silent = F.col("record").isNull() & (F.col("statement") == 0) & (F.col("counted") == 0)
    raw = _ofx(files).withColumn("silent", silent).filter(told | F.col("silent")).select(
        "path", F.when(F.col("silent"), 1).otherwise(F.col("nth")).alias("line"), leaf("FITID").alias("external_id"), F.substring(leaf("DTPOSTED"), 1, 8).alias("stamp"), leaf("TRNAMT").alias("size"),
        F.coalesce(_told(leaf("CURRENCY/CURSYM", "CURSYM")), F.col("own.currency")).alias("code"),
        F.when(kind == "INT", "interest").when(kind == "DIV", "dividend").when(kind.isin("FEE", "SRVCHG"), "fee").when(kind == "XFER", "transfer").alias("kind"),
        F.coalesce(_told(leaf("NAME")), _told(leaf("MEMO"))).alias("description"), _told(leaf("PAYEE/NAME")).alias("counterparty"), F.coalesce("own.account", F.lit(STATEMENT)).alias("account"),
        F.when(F.col("silent"), F.when(F.col("investments") & (F.col("statements") == 0), "investment statements are not read").when(F.col("statements") > 0, "no movement in this statement").otherwise("no bank or card statement in this file")).alias("problem"))
    return _shaped(raw.select("path", "line", "external_id", F.try_to_date("stamp", "yyyyMMdd").alias("booked_on"), parse_amount(F.col("size")).alias("amount"), read_currency(F.col("code")).alias("currency"), "kind", "description", "counterparty", "account", "problem"))


def _camt(files: DataFrame) -> DataFrame:
    """Rows of statements, each with its own account (its first identifier outside its entries) and currency."""
    own = F.struct(_told(leaf("ACCT/ID/IBAN", "ACCT/ID/OTHR/ID", "ACCT/ID", "IBAN")).alias("account"), _told(leaf("ACCT/CCY", "CCY")).alias("currency"))
    return _each(records(files, ("STMT",), "NTRY", parts="TXDTLS"), own)


def read_camt(files: DataFrame) -> DataFrame:
    """ISO 20022 camt.053, each statement on its own account: unsigned amounts with a mark of their side; entries that are not booked are left out.

    Remittance and party are read where an entry holds details of exactly one transaction.  A file whose entries are all pending has
    been read, only nothing in it counts yet; one without entries is a problem.
    """
    below = lambda route: F.filter("leaves", lambda x: F.regexp_replace(x["at"], "^(.*/)?TXDTLS/", "") == route)
    single, out = F.col("parts") == 1, F.upper(trimmed(leaf("CDTDBTIND"))) == "DBIT"
    party = lambda side: F.coalesce(_told(F.get(below(f"RLTDPTIES/{side}/PTY/NM"), F.lit(0))["value"]), _told(F.get(below(f"RLTDPTIES/{side}/NM"), F.lit(0))["value"]))
    remitted = _told(F.array_join(F.transform(below("RMTINF/USTRD"), lambda x: x["value"]), " "))
    named = lambda tag: F.when(~F.upper(trimmed(leaf(tag))).isin("", *PLACEHOLDERS), leaf(tag))
    day = lambda tag: F.try_to_date(F.nullif(F.regexp_extract(leaf(f"{tag}/DT", f"{tag}/DTTM", tag), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    amount = F.get(F.filter("leaves", lambda x: x["at"] == "AMT"), F.lit(0))
    family = F.upper(leaf("BKTXCD/DOMN/FMLY/SUBFMLYCD"))
    booked = F.upper(trimmed(leaf("STS", "STS/CD"))).isin("", "BOOK")
    silent = F.col("record").isNull() & (F.col("statement") == 0) & (F.col("records") == 0)
    raw = _camt(files).filter(F.when(F.col("record").isNotNull(), booked).otherwise(silent)).select(
        "path", F.when(silent, 1).otherwise(F.col("nth")).alias("line"), F.coalesce(named("ACCTSVCRREF"), named("NTRYREF")).alias("external_id"), F.coalesce(day("BOOKGDT"), day("VALDT")).alias("booked_on"),
        F.when(family == "INTR", "interest").when(family == "DIVD", "dividend").when(family.isin("FEES", "CHRG"), "fee").when(family == "TAXE", "tax").alias("kind"),
        amount["value"].alias("size"), F.coalesce(amount["ccy"], F.col("own.currency")).alias("code"), F.upper(trimmed(leaf("CDTDBTIND"))).alias("side"),
        F.coalesce(F.when(single, remitted), _told(leaf("ADDTLNTRYINF"))).alias("description"), F.when(single, F.when(out, party("CDTR")).otherwise(party("DBTR"))).alias("counterparty"), F.coalesce("own.account", F.lit(STATEMENT)).alias("account"),
        F.when(silent, F.when(F.col("statements") > 0, "no entry in this statement").otherwise("no CAMT.053 statement in this file")).alias("problem"))
    sized = raw.withColumn("amount", F.abs(parse_amount(F.col("size"))))
    return _shaped(sized.select(
        "path", "line", "external_id", "booked_on", F.when(F.col("side") == "DBIT", -F.col("amount")).when(F.col("side") == "CRDT", F.col("amount")).alias("amount"), read_currency(F.col("code")).alias("currency"), "kind", "description", "counterparty", "account", "problem"))


def closing_balances(files: DataFrame, format_: str) -> DataFrame:
    """(path, account, closing) that a file states; only files of exactly one statement state one."""
    if format_ == "camt":
        codes = ("BAL/TP/CDORPRTRY/CD", "BAL/TP/CDORPRTRY/PRTRY", "BAL/TP/CD", "BAL/TP/PRTRY")
        last = F.element_at(F.filter("leaves", lambda x: x["at"].isin(*codes) & (F.upper(x["value"]) == "CLBD")), -1)["branch"]
        rows = _camt(files).filter("statement > 0 and record is null and statements = 1").withColumn("branch", last)
        of = lambda tag: F.get(F.filter("leaves", lambda x: (x["branch"] == F.col("branch")) & (x["at"] == f"BAL/{tag}")), F.lit(0))["value"]
        stated = rows.select("path", F.coalesce("own.account", F.lit(STATEMENT)).alias("account"), of("AMT").alias("size"), of("CDTDBTIND").alias("side")).withColumn("size", F.abs(parse_amount(F.col("size"))))
        return stated.select("path", "account", F.when(F.upper("side") == "DBIT", -F.col("size")).otherwise(F.col("size")).alias("closing")).filter("closing is not null")
    if format_ == "ofx":
        rows = _ofx(files).filter("counts and record is null").select("path", F.coalesce("own.account", F.lit(STATEMENT)).alias("account"), leaf("LEDGERBAL/BALAMT").alias("size"))
        told = rows.select("path", "account", parse_amount(F.col("size")).alias("closing"))
    elif format_ == "mt940":
        each = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^:20:.*?(?=^:20:|\z)"), F.lit(0))).alias("body"))
        final = lambda k: F.regexp_extract("body", r"(?m)^:62F:([CD])\d{6}[A-Z]{3}([\d.,]+)", k)
        size = parse_amount(final(2))
        told = each.select("path", F.trim(F.regexp_extract("body", r"(?m)^:25:(.*)$", 1)).alias("account"), F.when(final(1) == "D", -size).otherwise(size).alias("closing"))
    else:
        raise ValueError(f"{format_} states no closing balance")
    single = told.groupBy("path").agg(F.count("*").alias("n"), F.first("account").alias("account"), F.first("closing").alias("closing"))
    return single.filter("n = 1 and closing is not null").select("path", "account", "closing")


def balance_breaks(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Rows whose stated balance is not the one before plus their amount."""
    before = F.lag("balance").over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("expected", (before + F.col("amount")).cast("decimal(38,10)")).filter("expected is not null and expected <> balance")


def entries_of(candidates: DataFrame) -> DataFrame:
    """The two entries of each readable movement: its own account's and the outside's."""
    sides = F.array(F.struct(F.col("account").alias("account"), F.col("amount").alias("amount")), F.struct(F.lit(EXTERNAL).alias("account"), (-F.col("amount")).cast("decimal(28,10)").alias("amount")))
    return candidates.filter("problem is null").select("path", "line", "currency", F.explode(sides).alias("e")).select("path", "line", "e.account", "e.amount", "currency")
