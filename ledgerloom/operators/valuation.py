"""Lots, costs, prices as of a day, returns, daily balances kept up to date, and exposure through funds.

Trades are rows (key, trade_id, day, quantity, amount) with buys positive and sales negative; trades of one key are in the order of (day,
trade_id).  Work on one key runs in that order by windows, or by one pass over sorted rows that holds no more than a key's
running state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ledger import LedgerError
from ledgerloom.plans.bridge import Ledger
from ledgerloom.plans.folders import written

QUANTITY = "decimal(28,6)"
#: A price older than so many days is an estimate.
STALE_DAYS = 7


def fifo_lots(trades: DataFrame) -> DataFrame:
    """(key, sale_id, lot_id, quantity, problem): what each sale takes from which earlier buys, first in first out.

    Buys and sales of a key lie one after another on two lines of the same length unit; where both lines are cut at the ends of both, each
    piece has one buy and one sale.  A key that has sold more than it held at any time is refused: its sales come without lots.
    """
    order = Window.partitionBy("key").orderBy("day", "trade_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    size = F.abs("quantity").cast(QUANTITY)
    side = F.when(F.col("quantity") > 0, "buy").otherwise("sale")
    rows = trades.filter("quantity <> 0").withColumns({"side": side, "size": size, "held": F.sum(F.col("quantity").cast(QUANTITY)).over(upto)})
    rows = rows.withColumn("short", F.min("held").over(Window.partitionBy("key")) < 0)
    line = Window.partitionBy("key", "side").orderBy("day", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    cuts = rows.filter("not short").withColumn("until", F.sum("size").over(line).cast(QUANTITY)).groupBy("key", "until").agg(
        F.max(F.when(F.col("side") == "buy", F.struct("day", "trade_id")))["trade_id"].alias("buy"), F.max(F.when(F.col("side") == "sale", F.struct("day", "trade_id")))["trade_id"].alias("sale"))
    along = Window.partitionBy("key").orderBy("until")
    after = along.rowsBetween(0, Window.unboundedFollowing)
    pieces = cuts.select("key", F.first("buy", ignorenulls=True).over(after).alias("lot_id"), F.first("sale", ignorenulls=True).over(after).alias("sale_id"),
                         (F.col("until") - F.coalesce(F.lag("until").over(along), F.lit(0))).cast(QUANTITY).alias("quantity"))
    refused = rows.filter("short and side = 'sale'").select("key", F.col("trade_id").alias("sale_id"), F.lit(None).cast(rows.schema["trade_id"].dataType).alias("lot_id"), F.col("size").alias("quantity"), F.lit("sold more than was held").alias("problem"))
    return pieces.filter("sale_id is not null and lot_id is not null").select("key", "sale_id", "lot_id", "quantity", F.lit(None).cast("string").alias("problem")).unionByName(refused)


def average_costs(trades: DataFrame) -> DataFrame:
    """(key, trade_id, held, cost, average) after each trade: a buy adds its amount to the cost, a sale takes the average of what it sells.

    What is sold beyond what is held costs nothing and leaves a position of 0.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, cost = None, 0.0, 0.0
        for batch in batches:
            out = []
            for key, quantity, amount in zip(batch["key"], batch["quantity"], batch["amount"], strict=True):
                if key != now:
                    now, held, cost = key, 0.0, 0.0
                if quantity > 0:
                    held, cost = held + quantity, cost + amount
                elif held + quantity <= 0:
                    held, cost = 0.0, 0.0
                else:
                    held, cost = held + quantity, cost * ((held + quantity) / held)
                out.append((held, cost))
            yield pd.DataFrame({"key": batch["key"], "trade_id": batch["trade_id"], "held": [h for h, _ in out], "cost": [c for _, c in out]})

    rows = trades.select("key", "trade_id", "day", F.col("quantity").cast("double").alias("quantity"), F.col("amount").cast("double").alias("amount"))
    spread = rows.repartition("key").sortWithinPartitions("key", "day", "trade_id").select("key", "trade_id", "quantity", "amount")
    kinds = dict(rows.dtypes)
    folded = spread.mapInPandas(run, f"key {kinds['key']}, trade_id {kinds['trade_id']}, held double, cost double")
    return folded.withColumn("average", F.coalesce(F.try_divide("cost", "held"), F.lit(0.0)))


def as_of(asked: DataFrame, known: DataFrame, stale_days: int = STALE_DAYS) -> DataFrame:
    """Add ``value``, ``value_on`` and ``estimated`` to rows (key, day): the newest value of ``known`` (key, day, value) on the day or before.

    Of several values of a day the greatest counts.  Rows meet by key and month, with what a month begins with
    worked out from one row a month, so that a key with many days is no task of its own.
    """
    month = F.trunc("day", "month").alias("month")
    values = known.groupBy("key", "day").agg(F.max("value").alias("value")).select("key", "day", month, F.struct(F.col("day").alias("on"), "value").alias("told"))
    wanted = asked.withColumn("month", F.trunc("day", "month"))
    months = values.groupBy("key", "month").agg(F.max("told").alias("last")).unionByName(wanted.select("key", "month").distinct().withColumn("last", F.lit(None).cast(values.schema["told"].dataType)))
    one = months.groupBy("key", "month").agg(F.max("last").alias("last"))
    before = Window.partitionBy("key").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    begun = one.select("key", "month", F.last("last", ignorenulls=True).over(before).alias("begun"))
    both = wanted.select("*", F.lit(None).cast(values.schema["told"].dataType).alias("told"), F.lit(True).alias("asks")).unionByName(values.withColumn("asks", F.lit(False)), allowMissingColumns=True)
    inside = Window.partitionBy("key", "month").orderBy("day", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("told", F.last("told", ignorenulls=True).over(inside)).filter("asks").join(begun, ["key", "month"], "left").withColumn("told", F.coalesce("told", "begun"))
    return found.select(*asked.columns, F.col("told.value").alias("value"), F.col("told.on").alias("value_on"), (F.date_diff("day", F.col("told.on")) > stale_days).alias("estimated"))


def daily_balances(movements: DataFrame) -> DataFrame:
    """(account_id, day, movement, balance) from (account_id, day, amount)."""
    days = movements.groupBy("account_id", "day").agg(F.sum("amount").cast("decimal(38,10)").alias("movement"))
    return days.withColumn("balance", F.sum("movement").over(Window.partitionBy("account_id").orderBy("day")).cast("decimal(38,10)"))


def refreshed_cells(daily: DataFrame, late: DataFrame) -> DataFrame:
    """The cells of ``daily`` that movements ``late`` touch, as they are afterwards: those of an account from its first late day on, and new days.

    Accounts without late movements are not read beyond the join.  The store keeps a key's newest cell, so the result is a delta.
    """
    new = late.groupBy("account_id", "day").agg(F.sum("amount").cast("decimal(38,10)").alias("movement"))
    since = new.groupBy("account_id").agg(F.min("day").alias("since"))
    touched = daily.join(since, "account_id")
    carried = touched.filter("day < since").groupBy("account_id").agg(F.max_by("balance", "day").alias("carried"))
    again = touched.filter("day >= since").select("account_id", "day", "movement").unionByName(new).groupBy("account_id", "day").agg(F.sum("movement").cast("decimal(38,10)").alias("movement"))
    running = F.sum("movement").over(Window.partitionBy("account_id").orderBy("day"))
    return again.join(carried, "account_id", "left").select("account_id", "day", "movement", (running + F.coalesce("carried", F.lit(0))).cast("decimal(38,10)").alias("balance"))


def with_cells(daily: DataFrame, cells: DataFrame) -> DataFrame:
    """``daily`` with ``cells`` in place of those of the same account and day."""
    return daily.join(cells, ["account_id", "day"], "left_anti").unionByName(cells)


def time_weighted(values: DataFrame) -> DataFrame:
    """(key, twr) from (key, day, before, flow): the value before a day's flow, over that after the flow before it, chained.

    Days that follow no positive value begin a new chain; a key without two valued days has a return of 0.
    """
    last = F.lag(F.col("before") + F.col("flow")).over(Window.partitionBy("key").orderBy("day"))
    chained = values.withColumn("growth", F.when((last > 0) & (F.col("before") > 0), F.ln(F.col("before") / last)))
    return chained.groupBy("key").agg((F.exp(F.coalesce(F.sum("growth"), F.lit(0.0))) - 1).alias("twr"))


def modified_dietz(flows: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, dietz) from flows (key, day, flow) and (key, from_day, to_day, from_value, to_value): gain over the value at the start and each flow by the share of the period it was there for; null where that is 0."""
    whole = F.date_diff("to_day", "from_day")
    weight = F.when(whole > 0, F.date_diff("to_day", "day") / whole).otherwise(F.lit(1.0))
    inside = flows.join(ends, "key").filter("day > from_day and day <= to_day").groupBy("key").agg(F.sum("flow").alias("net"), F.sum(F.col("flow") * weight).alias("weighted"))
    all_ = ends.join(inside, "key", "left").select("key", F.col("to_value") - F.col("from_value") - F.coalesce("net", F.lit(0.0)), F.col("from_value") + F.coalesce("weighted", F.lit(0.0))).toDF("key", "gain", "base")
    return all_.select("key", F.try_divide("gain", F.nullif("base", F.lit(0.0))).alias("dietz"))


def internal_rate(flows: DataFrame, low: float = -0.9999, high: float = 1e6, steps: int = 200) -> DataFrame:
    """(key, rate, residual) from (key, day, flow), what is paid in negative: the yearly rate at which all flows are worth 0.

    Flows of a day are summed first.  The rate is bracketed by ``low`` and ``high`` and halved on a scale of growth; a key whose worth has one sign at both ends has none.
    """
    days = flows.groupBy("key", "day").agg(F.sum(F.col("flow").cast("double")).alias("flow"))
    begun = days.withColumn("years", F.date_diff("day", F.min("day").over(Window.partitionBy("key"))) / 365.0)
    held = begun.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("years", "flow"))).alias("flows"), F.sum(F.abs("flow")).alias("size"))  # a row a day at most

    def worth(growth: Column) -> Column:
        """All flows, discounted by the logarithm of growth a year."""
        return F.aggregate("flows", F.lit(0.0), lambda a, x: a + x["flow"] * F.exp(-growth * x["years"]))

    least, most = F.lit(math.log1p(low)), F.lit(math.log1p(high))
    found = held.withColumns({"at_low": worth(least), "at_high": worth(most)})

    def halve(a: Column, _: Column) -> Column:
        middle = (a["low"] + a["high"]) / 2
        same = F.signum(worth(middle)) == F.signum(F.col("at_low"))
        return F.struct(F.when(same, middle).otherwise(a["low"]).alias("low"), F.when(same, a["high"]).otherwise(middle).alias("high"))

    bracket = F.when(F.signum("at_low") * F.signum("at_high") < 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(least.alias("low"), most.alias("high")), halve))
    solved = found.withColumn("growth", bracket["low"])
    return solved.select("key", (F.exp("growth") - 1).alias("rate"), (worth(F.col("growth")) / F.col("size")).alias("residual"))


def exposure(holdings: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, held, weight): what each root holds in the end, through funds that hold funds, from (fund, held, weight).

    Weights of one pair are summed on each round, so rows grow with pairs and not with paths.  Refuses circles: a fund that holds itself,
    however far.
    """
    holds = written(holdings.groupBy("fund", "held").agg(F.sum("weight").alias("share")), "holdings")
    funds = holds.select(F.col("fund").alias("node")).distinct()
    now = roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("weight")).distinct()
    most, done = funds.count(), []
    for round_ in range(most + 1):
        step = now.join(holds.withColumnRenamed("fund", "node"), "node").select("root", F.col("held").alias("node"), (F.col("weight") * F.col("share")).alias("weight"))
        step = written(step.groupBy("root", "node").agg(F.sum("weight").alias("weight")), "exposure")
        if step.isEmpty():
            break
        # a path longer than there are funds holds one twice
        if round_ == most or not step.filter("root = node").isEmpty():
            raise LedgerError("holdings go round in a circle")
        done.append(step.join(funds, "node", "left_anti"))
        now = step.join(funds, "node", "left_semi")
    if not done:
        return roots.select("root", F.col("root").alias("held"), F.lit(1.0).alias("weight")).limit(0)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.groupBy("root", F.col("node").alias("held")).agg(F.sum("weight").alias("weight"))


def _trades(ledger: Ledger) -> DataFrame:
    """Lines as trades of their part: returned ones sell a quarter of what they say, all others buy."""
    sale = F.col("l_returnflag") == "R"
    return ledger.lineitem.select(
        F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), F.col("l_shipdate").cast("date").alias("day"),
        F.when(sale, -F.col("l_quantity").cast(QUANTITY) / 4).otherwise(F.col("l_quantity").cast(QUANTITY)).cast(QUANTITY).alias("quantity"), F.when(~sale, F.col("l_extendedprice").cast("double")).otherwise(F.lit(0.0)).alias("amount"))


def _prices(ledger: Ledger) -> DataFrame:
    return ledger.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("value"))


def lots_taken(ledger: Ledger) -> DataFrame:
    return fifo_lots(_trades(ledger))


def costs_averaged(ledger: Ledger) -> DataFrame:
    return average_costs(_trades(ledger))


def prices_as_of(ledger: Ledger) -> DataFrame:
    """For each line, the price of its part on its order's day."""
    asked = ledger.lineitem.join(ledger.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("key"), F.col("o_orderdate").cast("date").alias("day"), "l_orderkey", "l_linenumber")
    return as_of(asked, _prices(ledger))


def _by_account(ledger: Ledger) -> DataFrame:
    lines = ledger.entries.filter("account_id like 'C%'").select("transaction_id", "account_id", "amount")
    return ledger.transactions.select("transaction_id", F.col("booked_on").alias("day")).join(lines, "transaction_id")


def daily_balances_refreshed(ledger: Ledger) -> DataFrame:
    """Daily balances of all but every tenth transaction, brought up to date with these."""
    moves = _by_account(ledger)
    first, late = moves.filter("transaction_id % 10 <> 0"), moves.filter("transaction_id % 10 = 0")
    daily = daily_balances(first)
    return with_cells(daily, refreshed_cells(daily, late))


def _held_values(ledger: Ledger) -> DataFrame:
    """(key, day, before, flow) of each part: what was held before the day and what came, at the day's highest price."""
    trades = _trades(ledger).groupBy("key", "day").agg(F.sum(F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(F.lit(0))).cast("double").alias("bought"))
    held = trades.withColumn("held", F.coalesce(F.sum("bought").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    price = _prices(ledger).groupBy("key", "day").agg(F.max("value").alias("price"))
    return held.join(price, ["key", "day"]).select("key", "day", (F.col("held") * F.col("price")).alias("before"), (F.col("bought") * F.col("price")).alias("flow"))


def returns_of_parts(ledger: Ledger) -> DataFrame:
    """Time-weighted return and Modified Dietz of each part from its first day to its last."""
    values = _held_values(ledger)
    ends = values.groupBy("key").agg(F.min("day").alias("from_day"), F.max("day").alias("to_day"), F.min_by(F.col("before") + F.col("flow"), "day").alias("from_value"), F.max_by(F.col("before") + F.col("flow"), "day").alias("to_value"))
    dietz = modified_dietz(values.select("key", "day", "flow"), ends)
    return time_weighted(values).join(dietz, "key").select("key", F.round("twr", 6).alias("twr"), F.round("dietz", 6).alias("dietz"))


def exposure_of_parts(ledger: Ledger) -> DataFrame:
    """Each part as a fund of parts of larger keys, up to five deep: two of them by weight, but every third part holds nothing."""
    part = ledger.table("part").select("p_partkey", "p_size")
    next_ = lambda times, add: F.col("p_partkey") * times + add
    share = F.col("p_size") / 100.0
    both = F.array(F.struct(next_(2, 1).alias("held"), share.alias("weight")), F.struct(next_(3, 2).alias("held"), (1 - share).alias("weight")))
    each = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("fund"), F.explode(both).alias("h")).select("fund", "h.held", "h.weight")
    known = each.join(part.select(F.col("p_partkey").alias("held")), "held")
    return exposure(known, part.select(F.col("p_partkey").alias("root"))).withColumn("weight", F.round("weight", 9))


_TRADES = "SELECT l_partkey AS key, l_orderkey * 10 + l_linenumber AS trade_id, cast(l_shipdate AS date) AS day, l_returnflag = 'R' AS sale, cast(CASE WHEN l_returnflag = 'R' THEN l_quantity::decimal(28,6) / 4 ELSE l_quantity END AS decimal(28,6)) AS size, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice::double ELSE 0 END AS amount FROM lineitem"
_VALUES = """trades AS (SELECT l_partkey AS key, cast(l_shipdate AS date) AS day, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::double ELSE 0 END) AS bought, max(l_extendedprice::double / l_quantity::double) AS price FROM lineitem GROUP BY 1, 2),
        vals AS (SELECT key, day, coalesce(sum(bought) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * price AS before, bought * price AS flow FROM trades)"""
ORACLES = {
    "lots_taken": f"""
        WITH t AS ({_TRADES}), run AS (SELECT *, sum(CASE WHEN sale THEN -size ELSE size END) OVER (PARTITION BY key ORDER BY day, trade_id) AS held, sum(size) OVER (PARTITION BY key, sale ORDER BY day, trade_id) AS until FROM t WHERE size <> 0),
        flagged AS (SELECT *, min(held) OVER (PARTITION BY key) < 0 AS short FROM run)
        SELECT s.key, s.trade_id AS sale_id, b.trade_id AS lot_id, cast(least(s.until, b.until) - greatest(s.until - s.size, b.until - b.size) AS decimal(28,6)) AS quantity, cast(NULL AS varchar) AS problem
        FROM flagged s JOIN flagged b ON s.key = b.key AND s.sale AND NOT b.sale AND NOT s.short AND least(s.until, b.until) > greatest(s.until - s.size, b.until - b.size)
        UNION ALL SELECT key, trade_id, NULL, cast(size AS decimal(28,6)), 'sold more than was held' FROM flagged WHERE short AND sale""",
    "costs_averaged": f"""
        WITH RECURSIVE t AS ({_TRADES}), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day, trade_id) AS nth FROM t),
        r AS (SELECT key, trade_id, nth, CASE WHEN sale THEN 0.0::double ELSE size::double END AS held, CASE WHEN sale THEN 0.0::double ELSE amount END AS cost FROM n WHERE nth = 1
            UNION ALL SELECT n.key, n.trade_id, n.nth, CASE WHEN NOT sale THEN held + size::double WHEN held - size::double <= 0 THEN 0 ELSE held - size::double END,
                CASE WHEN NOT sale THEN cost + amount WHEN held - size::double <= 0 THEN 0 ELSE cost * ((held - size::double) / held) END FROM r JOIN n ON n.key = r.key AND n.nth = r.nth + 1)
        SELECT key, trade_id, held, cost, CASE WHEN held <> 0 THEN cost / held ELSE 0 END AS average FROM r""",
    "prices_as_of": """
        WITH prices AS (SELECT l_partkey AS key, cast(l_shipdate AS date) AS on_day, max(l_extendedprice::double / l_quantity::double) AS price FROM lineitem GROUP BY 1, 2),
        asked AS (SELECT l_partkey AS key, cast(o_orderdate AS date) AS day, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT a.key, a.day, l_orderkey, l_linenumber, price AS "value", on_day AS value_on, date_diff('day', on_day, day) > 7 AS estimated FROM asked a ASOF LEFT JOIN prices p ON a.key = p.key AND a.day >= p.on_day""",
    "daily_balances_refreshed": """
        SELECT account_id, day, movement, cast(sum(movement) OVER (PARTITION BY account_id ORDER BY day) AS decimal(38,10)) AS balance
        FROM (SELECT account_id, booked_on AS day, cast(sum(amount) AS decimal(38,10)) AS movement FROM {transactions} t JOIN {entries} e ON e.transaction_id = t.transaction_id WHERE account_id LIKE 'C%' GROUP BY 1, 2) d""",
    "returns_of_parts": f"""
        WITH {_VALUES}, lagged AS (SELECT *, lag(before + flow) OVER (PARTITION BY key ORDER BY day) AS last FROM vals),
        twr AS (SELECT key, exp(coalesce(sum(CASE WHEN last > 0 AND before > 0 THEN ln(before / last) END), 0)) - 1 AS twr FROM lagged GROUP BY key),
        ends AS (SELECT key, min(day) AS a, max(day) AS z, arg_min(before + flow, day) AS v0, arg_max(before + flow, day) AS v1 FROM vals GROUP BY key),
        sums AS (SELECT key, any_value(v1) - any_value(v0) - coalesce(sum(flow) FILTER (day > a), 0) AS gain, any_value(v0) + coalesce(sum(flow * date_diff('day', day, z) / date_diff('day', a, z)::double) FILTER (day > a), 0) AS base FROM vals JOIN ends USING (key) GROUP BY key)
        SELECT key, round(twr, 6) AS twr, round(CASE WHEN base <> 0 THEN gain / base END, 6) AS dietz FROM twr JOIN sums USING (key)""",
    "exposure_of_parts": """
        WITH RECURSIVE both_ AS (SELECT p_partkey AS fund, p_partkey * 2 + 1 AS held, p_size / 100.0::double AS weight FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_partkey * 3 + 2, 1 - p_size / 100.0::double FROM part WHERE p_partkey % 3 <> 0),
        holds AS (SELECT b.* FROM both_ b JOIN part ON p_partkey = held),
        walk AS (SELECT p_partkey AS root, p_partkey AS node, 1.0::double AS weight, 0 AS depth FROM part UNION ALL SELECT root, held, walk.weight * h.weight, depth + 1 FROM walk JOIN holds h ON h.fund = node)
        SELECT root, node AS held, round(sum(weight), 9) AS weight FROM walk WHERE depth > 0 AND node NOT IN (SELECT fund FROM holds) GROUP BY 1, 2""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
