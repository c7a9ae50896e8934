"""What can be known of delimited files without being told: header row, date orders, columns of few values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import bound, date_order, day_part, trimmed

CONFIRMATIONS = 3
DATED_SHARE = 0.7


def header_rows(rows: DataFrame) -> DataFrame:
    """(path, header) from (path, pos, cells): the first row with three filled cells or more whose whole width the next rows have; else 0."""
    order = Window.partitionBy("path").orderBy("pos")
    wide = rows.select("path", "pos", F.size("cells").alias("width"), F.size(F.filter("cells", lambda c: trimmed(c) != "")).alias("filled"))
    nexts = [F.lead("width", k).over(order) for k in range(1, CONFIRMATIONS + 1)]
    same = nexts[0].isNotNull()
    for n in nexts:
        same = same & (n.isNull() | (n == F.col("width")))
    return wide.withColumn("good", same & (F.col("filled") >= 3)).groupBy("path").agg(F.coalesce(F.min(F.when(F.col("good"), F.col("pos"))), F.lit(0)).alias("header"))


def header_of(table: Column) -> Column:
    """The header's place in an array of rows of cells, as ``header_rows`` finds it."""
    sizes = F.transform(table, lambda cells: F.named_struct(F.lit("width"), F.size(cells), F.lit("filled"), F.size(F.filter(cells, lambda c: trimmed(c) != ""))))

    def first(sizes: Column) -> Column:
        def good(own: Column, i: Column) -> Column:
            nexts = [F.get(sizes, i + k)["width"] for k in range(1, CONFIRMATIONS + 1)]
            return reduce(lambda a, n: a & (n.isNull() | (n == own["width"])), nexts, nexts[0].isNotNull() & (own["filled"] >= 3))
        return F.greatest(F.array_position(F.transform(sizes, good), True).cast("int") - 1, F.lit(0))

    return bound(sizes, first)


def column_shapes(cells: DataFrame) -> DataFrame:
    """From (path, name, value): each column's order of dates, where most of it is dates, and its values, where they are few (2 to 8, no numbers)."""
    some = trimmed(F.col("value")) != ""
    dated = day_part(F.col("value")).rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/.-]\d{1,2}([/.-](\d{4}|\d{2}))?)$")
    number = F.col("value").rlike(r"^[\s\d.,+()€$£-]+$")
    few = F.collect_set(F.when(some, trimmed(F.col("value"))))
    return cells.groupBy("path", "name").agg(
        F.when(F.avg(F.when(some, dated.cast("double"))) >= DATED_SHARE, date_order(F.col("value"))).alias("dates"), F.approx_count_distinct(F.when(some, F.col("value"))).alias("about"),
        F.bool_or(some & number).alias("numeric"), F.slice(F.array_sort(few), 1, 9).alias("seen"),
    ).select("path", "name", F.col("dates.order").alias("date_order"), F.col("dates.ambiguous").alias("ambiguous"),
             F.when(F.col("dates").isNull() & ~F.col("numeric") & F.size("seen").between(2, 8), F.array_join("seen", "|")).alias("values"))


BROKER_KINDS = {"BUY": "buy", "SELL": "sell", "DIVIDEND": "dividend", "INTEREST_PAYMENT": "interest", "TRANSFER_IN": "transfer", "TRANSFER_OUT": "transfer", "TRANSFER_INSTANT_INBOUND": "deposit", "TRANSFER_INSTANT_OUTBOUND": "withdrawal"}


def broker_transfers(rows: DataFrame) -> DataFrame:
    """Pairs of transfer rows of a broker's export: the n-th going out with the n-th coming in of one day, currency and size.

    ``rows``: path, line, type, date (text), currency, amount (decimal), account_type.
    """
    nth = F.row_number().over(Window.partitionBy("path", "date", "currency", "size").orderBy("line"))
    out = rows.filter("type = 'TRANSFER_OUT'").withColumn("size", -F.col("amount")).withColumn("nth", nth).select("path", "date", "currency", "size", "nth", F.col("line").alias("out_line"), F.col("account_type").alias("from_account"))
    into = rows.filter("type = 'TRANSFER_IN'").withColumn("size", F.col("amount")).withColumn("nth", nth).select("path", "date", "currency", "size", "nth", F.col("line").alias("in_line"), F.col("account_type").alias("to_account"))
    return out.join(into, ["path", "date", "currency", "size", "nth"]).drop("nth")


def broker_entries(rows: DataFrame) -> DataFrame:
    """Entries of single rows: trades move cash against the holding, taxed interest shows gross, tax and net; else account against outside.

    ``rows``: path, line, type, account_type, currency, amount, tax, shares (decimals).
    """
    side = lambda account, amount, quantity=None: F.struct(account.alias("account"), amount.cast("decimal(28,10)").alias("amount"), (F.lit(None) if quantity is None else quantity).cast("decimal(38,18)").alias("quantity"))
    own, out, holding = F.col("account_type"), F.lit("EXTERNAL"), F.concat(F.col("account_type"), F.lit(":SECURITIES"))
    amount, tax = F.col("amount"), F.coalesce(F.col("tax"), F.lit(0).cast("decimal(28,10)"))
    trade = F.array(side(own, amount), side(holding, -amount, F.when(F.col("type") == "SELL", -F.col("shares")).otherwise(F.col("shares"))))
    taxed = F.array(side(own, amount), side(own, tax), side(out, -(amount + tax)))
    plain = F.array(side(own, amount), side(out, -amount))
    parts = F.when(F.col("type").isin("BUY", "SELL"), trade).when(tax != 0, taxed).otherwise(plain)
    kinds = F.create_map(*[F.lit(x) for pair in BROKER_KINDS.items() for x in pair])
    return rows.select("path", "line", F.coalesce(kinds[F.col("type")], F.lit("adjustment")).alias("kind"), "currency", F.explode(parts).alias("e")).select("path", "line", "kind", "e.account", "e.amount", "e.quantity", "currency")
