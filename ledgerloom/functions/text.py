"""Labels, trigrams, amounts, dates and currencies as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def _plain(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))


#: Letters that canonical decomposition takes to one plain letter, of the Latin, Greek and Cyrillic blocks.
_LETTERS = [c for c in map(chr, [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]) if len(_plain(c)) == 1 and _plain(c) != c]
ACCENTED, PLAIN = "".join(_LETTERS), "".join(map(_plain, _LETTERS))
COMBINING = r"[\u0300-\u036f]"
DATES = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.-]\d{1,2}(?:[/.-]\d{2,4})?\b|\b\d{1,2}:\d{2}(?::\d{2})?\b"
#: Blanks that trimming removes: plain ones, and the no-break, narrow no-break and thin space.
BLANK = r"[\s   ]"
#: Words of a label that name the kind of payment, or nothing.
BOILERPLATE = ("CARTE", "CB", "PAIEMENT", "PAYMENT", "ACHAT", "VIR", "VIREMENT", "TRANSFER", "PRLV", "PRELEVEMENT", "SEPA", "RETRAIT", "DAB", "FACTURE", "ABONNEMENT",
               "DU", "DE", "DES", "LA", "LE", "LES", "ET", "AU", "AUX", "PAR", "POUR", "SUR", "THE", "FROM", "TO")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def unaccented(text: Column) -> Column:
    """Letters without their marks, whether these are part of the letter or follow it."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), COMBINING, "")


def normalise_label(text: Column) -> Column:
    """Upper case without accents, dates and long numbers; one blank between what is left."""
    bare = F.regexp_replace(F.upper(unaccented(text)), DATES, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\d{4,}", "#"), "[^A-Z0-9#]+", " "))


def trigrams(label: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(label, " "), lambda w: w != "")
    cut = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared over all trigrams of two labels that are already normalised; 0 if either has none.

    Equal labels, which most pairs have, are not cut at all, others once.
    """
    def shared(both: Column) -> Column:
        a, b = both["a"], both["b"]
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))

    same = F.when(F.trim(left) != "", F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(left == right, same).otherwise(bound(F.struct(trigrams(left).alias("a"), trigrams(right).alias("b")), shared))


def suggest_pattern(text: Column) -> Column:
    """The first two telling words of a description."""
    words = F.filter(F.split(normalise_label(text), " "), lambda w: (w != "") & (w != "#") & ~w.isin(*BOILERPLATE) & ~w.rlike("^[0-9]+$"))
    return F.array_join(F.slice(words, 1, 2), " ")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, where an expression that named it many times would repeat it."""
    return F.transform(F.array(value), body)[0]


def parse_amount(raw: Column) -> Column:
    """An amount in any of the ways statements write one, as decimal(28,10); null if it is none.

    The last separator is the decimal one, but a lone separator before exactly three digits marks thousands.
    Brackets negate, and so does a sign before or after.
    """
    def unsigned(body: Column) -> Column:
        whole = F.regexp_extract(body, r"^(.*?)[.,]?([0-9]*)$", 1)
        cents = F.regexp_extract(body, r"[.,]([0-9]*)$", 1)
        thousands = (F.regexp_count(body, F.lit("[.,]")) == 1) & body.rlike(r"[.,][0-9]{3}$")
        number = F.when(~body.rlike("[.,]") | thousands, F.regexp_replace(body, "[.,]", "")).otherwise(F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), cents))
        return F.when(body.rlike(r"^[0-9.,]+$") & body.rlike("[0-9]"), F.concat(F.lit("0"), number).try_cast("decimal(28,10)"))

    def signed(inner: Column) -> Column:
        leading = inner.rlike("^[+-]")
        minus = F.when(leading, F.startswith(inner, F.lit("-"))).otherwise(F.endswith(inner, F.lit("-")))
        body = F.when(leading, F.substr(inner, F.lit(2))).otherwise(F.regexp_replace(inner, "[+-]$", ""))
        return F.struct(minus.alias("minus"), bound(body, unsigned).alias("size"))

    def read(text: Column) -> Column:
        bracketed = text.rlike(r"^\(.*\)$")
        inner = F.when(bracketed, F.regexp_extract(text, r"^\((.*)\)$", 1)).otherwise(text)
        return bound(bound(inner, signed), lambda n: F.when(n["minus"] != bracketed, -n["size"]).otherwise(n["size"]))

    text = F.regexp_replace(F.regexp_replace(raw, BLANK, ""), "(?i)[€$£¥]|EUR|USD|GBP|CHF", "")
    return bound(text, read).cast("decimal(28,10)")


def from_debit_credit(debit: Column, credit: Column) -> Column:
    """One signed amount from two columns; null when both are stated and not zero, or neither is."""
    out, into = parse_amount(debit), parse_amount(credit)
    has_out, has_in = F.coalesce(out != 0, F.lit(False)), F.coalesce(into != 0, F.lit(False))
    return F.when(has_out & has_in, F.lit(None)).when(has_out, -F.abs(out)).when(has_in, F.abs(into)).otherwise(F.coalesce(into, out)).cast("decimal(28,10)")


def read_currency(raw: Column) -> Column:
    """A currency code of 3 to 10 letters, or the sign of one that is not ambiguous."""
    signs = F.create_map(*(F.lit(x) for x in ("€", "EUR", "£", "GBP", "¥", "JPY")))
    return bound(F.upper(trimmed(raw)), lambda t: bound(F.coalesce(F.element_at(signs, t), t), lambda named: F.when(named.rlike("^[A-Z]{3,10}$"), named)))


def day_part(raw: Column) -> Column:
    return F.regexp_extract(trimmed(raw), r"^[^\sT]*", 0)


def _built(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def read_date(raw: Column, order: Column, year: Column | None = None) -> Column:
    """A day written as ISO, or with slashes, dots or dashes in the column's order (ymd, dmy, mdy); impossible days are null."""
    text = day_part(raw)
    iso = r"^(\d{4})-(\d{2})-(\d{2})$"
    full = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$"
    bare = r"^(\d{1,2})[/.-](\d{1,2})$"
    g = lambda pattern, k: F.regexp_extract(text, pattern, k)
    century = F.when(F.length(g(full, 3)) == 2, F.concat(F.lit("20"), g(full, 3))).otherwise(g(full, 3))
    day_first = order == "dmy"
    dated = F.when(day_first, _built(century, g(full, 2), g(full, 1))).otherwise(_built(century, g(full, 1), g(full, 2)))
    yearless = F.lit(None).cast("date") if year is None else F.when(day_first, _built(year.cast("string"), g(bare, 2), g(bare, 1))).otherwise(_built(year.cast("string"), g(bare, 1), g(bare, 2)))
    return F.when(text.rlike(iso), _built(g(iso, 1), g(iso, 2), g(iso, 3))).when(text.rlike(full), dated).when(text.rlike(bare), yearless)


def date_order(raw: Column) -> Column:
    """Aggregate: the order of a date column, as struct (order, ambiguous)."""
    text = day_part(raw)
    some = text != ""
    parts = r"^(\d{1,2})[/.-](\d{1,2})(?:[/.-](?:\d{4}|\d{2}))?$"
    first = F.regexp_extract(text, parts, 1).try_cast("int") > 12
    second = F.regexp_extract(text, parts, 2).try_cast("int") > 12
    any_first, any_second = F.coalesce(F.bool_or(F.when(some, first)), F.lit(False)), F.coalesce(F.bool_or(F.when(some, second)), F.lit(False))
    iso = F.coalesce(F.bool_and(F.when(some, text.rlike(r"^\d{4}-\d{2}-\d{2}$"))), F.lit(False))
    return F.struct(
        F.when(iso, "ymd").when(any_second & ~any_first, "mdy").otherwise("dmy").alias("order"),
        F.when(iso, F.lit(False)).otherwise(any_first == any_second).alias("ambiguous"),
    )


def date_order_of(days: Column) -> Column:
    """The order of an array of days, as ``date_order`` gives that of a column."""
    parts = r"^(\d{1,2})[/.-](\d{1,2})(?:[/.-](?:\d{4}|\d{2}))?$"
    over = lambda k: lambda d: F.coalesce(F.regexp_extract(d, parts, k).try_cast("int") > 12, F.lit(False))
    some = lambda texts: bound(F.named_struct(F.lit("first"), F.exists(texts, over(1)), F.lit("second"), F.exists(texts, over(2)), F.lit("iso"), (F.size(texts) > 0) & F.forall(texts, lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$"))), told)

    def told(x: Column) -> Column:
        order = F.when(x["iso"], "ymd").when(x["second"] & ~x["first"], "mdy").otherwise("dmy")
        return F.named_struct(F.lit("order"), order, F.lit("ambiguous"), F.when(x["iso"], F.lit(False)).otherwise(x["first"] == x["second"]))

    return bound(F.filter(F.transform(days, day_part), lambda d: d != ""), some)


def plain_decimal(amount: Column) -> Column:
    """A decimal as text without an exponent or trailing zeros."""
    return F.regexp_replace(amount.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")


def rounded(amount: Column, places: int) -> Column:
    """Money to so many places, halves to the even digit."""
    return F.bround(amount, places)


def dedupe_hash(day: Column, shape: Column, label: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", day.cast("string"), shape, label), 256)


def classification(kind: Column) -> Column:
    return F.when(kind.isin("loan", "credit_card"), "liability").when(kind == "opening_balance", "equity").otherwise("asset")


#: The entities that statements use.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
_REFERENCE = re.compile(r"&(?:#(\d{1,7})|#x([0-9a-f]{1,6})|([a-z]+));", re.IGNORECASE)


def _entity(found: re.Match) -> str:
    number, code, name = found.groups()
    if name:
        return ENTITIES.get(name.lower(), found[0])
    point = int(number) if number else int(code, 16)
    return found[0] if point > 0x10FFFF or 0xD800 <= point < 0xE000 else chr(point)


def decode_references(text: str) -> str:
    """Named and numeric character references, decoded once; what is no character stays as written."""
    return _REFERENCE.sub(_entity, text) if "&" in text else text


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else decode_references(t))
