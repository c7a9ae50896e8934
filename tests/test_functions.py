from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text as fx


def values(spark, column, cells):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string")
    return [r["v"] for r in rows.select("k", column(F.col("c")).alias("v")).orderBy("k").collect()]


def test_amounts(spark):
    cells = ["1,234.56", "1.234,56", "1 234,56", "1,234", "12,34", "(5)", "(-5)", "45,00-", "-7", "€ 3.5", "abc", "", None, "1.2.3", "--5", ".5", "5."]
    want = ["1234.56", "1234.56", "1234.56", "1234", "12.34", "-5", "5", "-45", "-7", "3.5", None, None, None, "12.3", None, "0.5", "5"]
    assert values(spark, fx.parse_amount, cells) == [None if w is None else Decimal(w).quantize(Decimal("1.0000000000")) for w in want]


def test_debit_and_credit(spark):
    rows = spark.createDataFrame([("5", ""), ("", "7"), ("5", "7"), ("0", "0"), ("", "")], "d string, c string")
    got = [r[0] for r in rows.select(fx.from_debit_credit(F.col("d"), F.col("c"))).collect()]
    assert got == [Decimal(-5), Decimal(7), None, Decimal(0), None]


def test_labels(spark):
    assert values(spark, fx.normalise_label, ["Carte 12/03 Marché  Nord 12345", "2026-01-15 é", "œuvre", "", None]) == ["CARTE MARCHE NORD #", "E", "UVRE", "", None]
    assert values(spark, fx.suggest_pattern, ["CARTE 12/03 Marché Nord Sud 12345", "VIR SEPA"]) == ["MARCHE NORD", ""]


def test_similarity(spark):
    rows = spark.createDataFrame([("ABC", "ABC"), ("ABC", ""), ("ABC", "XYZ"), ("MARCHE NORD", "MARCHE NORT")], "a string, b string")
    got = [r[0] for r in rows.select(fx.trigram_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and 0.6 < got[3] < 0.8


def test_dates(spark):
    dmy = lambda c: fx.read_date(c, F.lit("dmy"))
    assert values(spark, dmy, ["31/01/2026", "2026-02-03", "31/02/2026", "1.2.26", "x", "", None]) == [date(2026, 1, 31), date(2026, 2, 3), None, date(2026, 2, 1), None, None, None]
    assert values(spark, lambda c: fx.read_date(c, F.lit("mdy")), ["01/31/2026"]) == [date(2026, 1, 31)]
    assert values(spark, lambda c: fx.read_date(c, F.lit("dmy"), F.lit(2025)), ["31/12"]) == [date(2025, 12, 31)]


@pytest.mark.parametrize(("cells", "want"), [
    (["2026-01-02"], ("ymd", False)), (["31/01/2026"], ("dmy", False)), (["01/31/2026"], ("mdy", False)), (["01/02/2026"], ("dmy", True)), ([""], ("dmy", True))])
def test_date_order(spark, cells, want):
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    assert tuple(rows.agg(fx.date_order(F.col("c")).alias("o")).first()["o"]) == want


def test_currency_and_entities(spark):
    assert values(spark, fx.read_currency, ["€", "usd", "$", "", "ABCDEFGHIJK"]) == ["EUR", "USD", None, None, None]
    assert values(spark, fx.decode_entities, ["a &amp;lt; b", "&#65;&#x42;", "&secret;", "&#99999999;", None]) == ["a &lt; b", "AB", "&secret;", "&#99999999;", None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=2), min_size=1, max_size=30))
def test_amounts_come_back(spark, amounts):
    cells = [f"{a:,.2f}" for a in amounts]
    assert values(spark, fx.parse_amount, cells) == amounts
