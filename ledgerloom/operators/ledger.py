"""Reading, checking and reversing a ledger: filters, pages, lines, invariants and deltas."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.bridge import Ledger


class LedgerError(ValueError):
    """A refusal; ``rows`` of a check say why."""


class Unbalanced(LedgerError):
    pass


class TooFewEntries(LedgerError):
    pass


class InconsistentHolding(LedgerError):
    pass


class CurrencyMismatch(LedgerError):
    pass


class DateRange(LedgerError):
    pass


@dataclass(frozen=True)
class Filters:
    """What to list; all that is stated must hold.  Built once and used by both count and page."""

    account: str | None = None
    since: date | None = None
    until: date | None = None
    kind: str | None = None
    counterparty: str | None = None
    status: str = "all"  # all, reversal, reversed
    household: int | None = None
    category: str | None = None  # of any of its lines
    tag: str | None = None

    def column(self) -> Column:
        parts = [F.lit(True)]
        if self.household is not None:
            parts.append(F.col("household_id") == self.household)
        if self.since is not None:
            parts.append(F.col("booked_on") >= F.lit(self.since))
        if self.until is not None:
            parts.append(F.col("booked_on") <= F.lit(self.until))
        if self.kind is not None:
            parts.append(F.col("kind") == self.kind)
        if self.counterparty is not None:
            parts.append(F.col("counterparty") == self.counterparty[:200])
        if self.status == "reversal":
            parts.append(F.col("reverses_id").isNotNull())
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def filtered(ledger: Ledger, filters: Filters, decided: DataFrame | None = None) -> DataFrame:
    """Transactions that pass; ``decided`` (transaction_id, category, tags) says the categories and tags of lines."""
    rows = ledger.transactions.filter(filters.column())
    if filters.category is not None or filters.tag is not None:
        if decided is None:
            raise ValueError("categories and tags are filtered by the lines' decisions")
        if filters.category is not None:
            rows = rows.join(decided.filter(F.col("category") == filters.category).select("transaction_id"), "transaction_id", "left_semi")
        if filters.tag is not None:
            rows = rows.join(decided.filter(F.array_contains("tags", filters.tag)).select("transaction_id"), "transaction_id", "left_semi")
    if filters.account is not None:
        rows = rows.join(ledger.entries.filter(F.col("account_id") == filters.account).select("transaction_id"), "transaction_id", "left_semi")
    if filters.status == "reversed":
        rows = rows.join(ledger.transactions.filter("reverses_id is not null").select(F.col("reverses_id").alias("transaction_id")), "transaction_id", "left_semi")
    return rows


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    count: int
    page: int
    pages: int


def page_of(ledger: Ledger, filters: Filters = Filters(), page: int = 1, per_page: int = 25) -> Page:
    """One page in ledger order; the ids are cut first and only then joined to their lines."""
    per_page = min(max(per_page, 1), 200)
    rows = filtered(ledger, filters)
    count = rows.count()
    pages = max(-(-count // per_page), 1)
    page = min(max(page, 1), pages)
    cut = rows.orderBy(F.desc_nulls_last("booked_on"), F.desc_nulls_last("transaction_id")).offset((page - 1) * per_page).limit(per_page)
    return Page(cut, count, page, pages)


def ledger_page(ledger: Ledger) -> DataFrame:
    """The third page of 25 of all households."""
    return page_of(ledger, Filters(), page=3).rows.select("transaction_id", "household_id", "booked_on", "kind", "description")


def ledger_count(ledger: Ledger) -> DataFrame:
    return filtered(ledger, Filters(kind="deposit")).groupBy("household_id").agg(F.count("*").alias("n"))


def filter_by_account(ledger: Ledger) -> DataFrame:
    """Transactions that touch an account of the kind savings."""
    chosen = ledger.entries.join(ledger.accounts.filter("kind = 'savings'").select("account_id"), "account_id", "left_semi")
    return ledger.transactions.join(chosen.select("transaction_id"), "transaction_id", "left_semi").select("transaction_id", "household_id", "booked_on")


def filter_by_kind_period(ledger: Ledger) -> DataFrame:
    return filtered(ledger, Filters(kind="withdrawal", since=date(1996, 1, 1), until=date(1996, 12, 31))).select("transaction_id", "booked_on", "description")


def filter_by_counterparty(ledger: Ledger) -> DataFrame:
    return ledger.transactions.filter("counterparty is not null").groupBy("household_id", "counterparty").agg(F.count("*").alias("n"), F.max("booked_on").alias("last_on"))


def status_reversal(ledger: Ledger) -> DataFrame:
    return filtered(ledger, Filters(status="reversal")).select("transaction_id", "reverses_id", "booked_on")


def status_reversed(ledger: Ledger) -> DataFrame:
    return filtered(ledger, Filters(status="reversed")).select("transaction_id", "booked_on")


def reversed_by(ledger: Ledger) -> DataFrame:
    """Every transaction with the least id that reverses it, or null."""
    by = ledger.transactions.filter("reverses_id is not null").groupBy(F.col("reverses_id").alias("transaction_id")).agg(F.min("transaction_id").alias("reversed_by"))
    return ledger.transactions.select("transaction_id").join(by, "transaction_id", "left")


def counterparties_top500(ledger: Ledger) -> DataFrame:
    """The list of names that a form offers: the first 500."""
    return ledger.transactions.filter("counterparty is not null").select("counterparty").distinct().orderBy("counterparty").limit(500)


def ledger_lines(ledger: Ledger) -> DataFrame:
    """Each transaction's lines as one ordered text: amount descending, then account name."""
    lines = ledger.entries.join(ledger.accounts.select("account_id", "name"), "account_id")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("back"), F.col("name"), F.col("amount"))))
    return lines.groupBy("transaction_id").agg(F.transform(ordered, lambda x: F.concat(x["name"], F.lit(":"), x["amount"].cast("decimal(20,2)").cast("string"))).alias("ls")).select(
        "transaction_id", F.array_join("ls", "|").alias("lines"), F.size("ls").cast("long").alias("n"))


def first_seen_counterparties(ledger: Ledger) -> DataFrame:
    """Each household's counterparties in the order in which they first came up."""
    first = ledger.transactions.filter("counterparty is not null").groupBy("household_id", "counterparty").agg(F.min("transaction_id").alias("first_id"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("household_id").orderBy("first_id")).cast("long"))


def account_suggestions(ledger: Ledger) -> DataFrame:
    """For each name that a file may give, in whatever case: the first open account of the household of that name."""
    open_ = ledger.accounts.filter("closed_on is null")
    return open_.groupBy("household_id", F.lower("name").alias("folded")).agg(F.min("account_id").alias("account_id"))


def two_line_movements(ledger: Ledger) -> DataFrame:
    """Transactions of two lines of one currency and opposite signs, as from, to and amount."""
    sides = ledger.entries.groupBy("transaction_id").agg(
        F.count("*").alias("n"), F.min("currency").alias("c0"), F.max("currency").alias("c1"),
        F.min(F.struct("amount", "account_id")).alias("low"), F.max(F.struct("amount", "account_id")).alias("high"))
    two = sides.filter("n = 2 and c0 = c1 and low.amount < 0 and high.amount > 0")
    return two.select("transaction_id", F.col("low.account_id").alias("from_account"), F.col("high.account_id").alias("to_account"), F.col("high.amount").alias("amount"))


def unbalanced(entries: DataFrame) -> DataFrame:
    """(transaction, currency) whose entries do not sum to 0."""
    return entries.groupBy("transaction_id", "currency").agg(F.sum("amount").cast("decimal(38,10)").alias("residual")).filter("residual <> 0")


def unbalanced_transactions(ledger: Ledger) -> DataFrame:
    """The check on a perturbed ledger: every third transaction lacks its household line."""
    return unbalanced(ledger.entries.filter("not (transaction_id % 3 = 0 and account_id like 'C%')"))


def underfilled_transactions(ledger: Ledger) -> DataFrame:
    n = ledger.entries.groupBy("transaction_id").agg(F.count("*").alias("n"))
    return ledger.transactions.select("transaction_id").join(n, "transaction_id", "left").select("transaction_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")).filter("n < 2")


def currency_mismatch(ledger: Ledger) -> DataFrame:
    own = ledger.accounts.select("account_id", F.col("currency").alias("account_currency"))
    return ledger.entries.join(own, "account_id").filter("currency <> account_currency").select("transaction_id", "account_id", "currency", "account_currency")


def inconsistent_holdings(entries: DataFrame) -> DataFrame:
    return entries.filter("(instrument_id is null) <> (quantity is null)")


def external_id_conflicts(ledger: Ledger) -> DataFrame:
    """External ids that stand more than once in a household, when statements are taken in unseen; a reversed row has freed its own."""
    gone = ledger.transactions.filter("reverses_id is not null").select(F.col("reverses_id").alias("transaction_id"))
    standing = ledger.transactions.filter("external_id is not null").join(gone, "transaction_id", "left_anti").select("household_id", "external_id").unionAll(ledger.statement_lines.filter("external_id is not null").select("household_id", "external_id"))
    return standing.groupBy("household_id", "external_id").agg(F.count("*").alias("n")).filter("n > 1")


def ownership_overlap(ledger: Ledger) -> DataFrame:
    """Closed order intervals of one customer's clerk that overlap an earlier one, as ownership ranges may not."""
    ranges = ledger.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("begins"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("ends"))
    before = Window.partitionBy("o_custkey").orderBy("begins", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reach", F.max("ends").over(before)).filter("reach >= begins").select("o_custkey", "o_orderkey", "begins")


def reversal_mirror(ledger: Ledger) -> DataFrame:
    """The entries that a reversal of each import-7 transaction books: amounts and quantities negated."""
    chosen = ledger.transactions.filter("import_id = 7 and reverses_id is null").select("transaction_id")
    return ledger.base_entries.join(chosen, "transaction_id", "left_semi").select(
        "transaction_id", "account_id", (-F.col("amount")).cast("decimal(28,10)").alias("amount"), "currency", "instrument_id", (-F.col("quantity")).cast("decimal(38,18)").alias("quantity"))


def rollback_delta(ledger: Ledger) -> DataFrame:
    """What rolling back import 11 appends: one reversal for each of its transactions that still stands."""
    reversed_ids = ledger.transactions.filter("reverses_id is not null").select(F.col("reverses_id").alias("transaction_id"))
    standing = ledger.transactions.filter("import_id = 11 and reverses_id is null").join(reversed_ids, "transaction_id", "left_anti")
    return standing.select((F.col("transaction_id") + 2000000000).alias("transaction_id"), "household_id", "kind", F.col("transaction_id").alias("reverses_id"), F.concat(F.lit("Reversal of "), F.col("transaction_id").cast("string")).alias("description"))


def import_runs(ledger: Ledger) -> DataFrame:
    return ledger.transactions.groupBy("household_id", "import_id").agg(F.count("*").alias("n"), F.min("booked_on").alias("first_on"), F.max("booked_on").alias("last_on"))


def validate(transactions: DataFrame, entries: DataFrame, accounts: DataFrame) -> None:
    """Refuse a batch that breaks an invariant, naming the first one broken; ``value_on`` and ``unit_price`` are checked where stated."""
    if "value_on" in transactions.columns and not transactions.filter("value_on < booked_on").isEmpty():
        raise DateRange("a transaction's value date is before its booking")
    if "unit_price" in entries.columns and not entries.filter("unit_price is not null and quantity is null").isEmpty():
        raise InconsistentHolding("a unit price needs a quantity")
    if not unbalanced(entries).isEmpty():
        raise Unbalanced("entries of a transaction do not sum to 0 in each currency")
    n = entries.groupBy("transaction_id").agg(F.count("*").alias("n"))
    if not transactions.select("transaction_id").join(n, "transaction_id", "left").filter("coalesce(n, 0) < 2").isEmpty():
        raise TooFewEntries("a transaction needs two entries at least")
    if not inconsistent_holdings(entries).isEmpty():
        raise InconsistentHolding("quantity and instrument are stated together or not at all")
    own = accounts.select("account_id", F.col("currency").alias("account_currency"))
    if not entries.join(own, "account_id").filter("currency <> account_currency").isEmpty():
        raise CurrencyMismatch("an entry's currency is its account's")


ORACLES = {
    "first_seen_counterparties": "SELECT household_id, counterparty, first_id, row_number() OVER (PARTITION BY household_id ORDER BY first_id) AS place FROM (SELECT household_id, counterparty, min(transaction_id) AS first_id FROM {transactions} WHERE counterparty IS NOT NULL GROUP BY 1, 2) x",
    "account_suggestions": "SELECT household_id, lower(name) AS folded, min(account_id) AS account_id FROM {accounts} WHERE closed_on IS NULL GROUP BY 1, 2",
    "ledger_page": "SELECT transaction_id, household_id, booked_on, kind, description FROM {transactions} ORDER BY booked_on DESC NULLS LAST, transaction_id DESC NULLS LAST LIMIT 25 OFFSET 50",
    "ledger_count": "SELECT household_id, count(*) AS n FROM {transactions} WHERE kind = 'deposit' GROUP BY 1",
    "filter_by_account": "SELECT transaction_id, household_id, booked_on FROM {transactions} t WHERE EXISTS (SELECT 1 FROM {entries} e JOIN {accounts} a ON a.account_id = e.account_id WHERE a.kind = 'savings' AND e.transaction_id = t.transaction_id)",
    "filter_by_kind_period": "SELECT transaction_id, booked_on, description FROM {transactions} WHERE kind = 'withdrawal' AND booked_on BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
    "filter_by_counterparty": "SELECT household_id, counterparty, count(*) AS n, max(booked_on) AS last_on FROM {transactions} WHERE counterparty IS NOT NULL GROUP BY 1, 2",
    "status_reversal": "SELECT transaction_id, reverses_id, booked_on FROM {transactions} WHERE reverses_id IS NOT NULL",
    "status_reversed": "SELECT transaction_id, booked_on FROM {transactions} t WHERE EXISTS (SELECT 1 FROM {transactions} r WHERE r.reverses_id = t.transaction_id)",
    "reversed_by": "SELECT t.transaction_id, min(r.transaction_id) AS reversed_by FROM {transactions} t LEFT JOIN {transactions} r ON r.reverses_id = t.transaction_id GROUP BY 1",
    "counterparties_top500": "SELECT DISTINCT counterparty FROM {transactions} WHERE counterparty IS NOT NULL ORDER BY 1 LIMIT 500",
    "ledger_lines": "SELECT transaction_id, string_agg(concat(name, ':', cast(cast(amount AS decimal(20,2)) AS varchar)), '|' ORDER BY amount DESC, name) AS lines, count(*) AS n FROM {entries} e JOIN {accounts} a ON a.account_id = e.account_id GROUP BY 1",
    "two_line_movements": """SELECT transaction_id, min(account_id) FILTER (amount < 0) AS from_account, min(account_id) FILTER (amount > 0) AS to_account, max(amount) AS amount FROM {entries} GROUP BY 1
        HAVING count(*) = 2 AND min(currency) = max(currency) AND min(amount) < 0 AND max(amount) > 0""",
    "unbalanced_transactions": "SELECT transaction_id, currency, cast(sum(amount) AS decimal(38,10)) AS residual FROM {entries} WHERE NOT (transaction_id % 3 = 0 AND account_id LIKE 'C%') GROUP BY 1, 2 HAVING sum(amount) <> 0",
    "underfilled_transactions": "SELECT t.transaction_id, count(e.transaction_id) AS n FROM {transactions} t LEFT JOIN {entries} e ON e.transaction_id = t.transaction_id GROUP BY 1 HAVING count(e.transaction_id) < 2",
    "currency_mismatch": "SELECT e.transaction_id, e.account_id, e.currency, a.currency AS account_currency FROM {entries} e JOIN {accounts} a ON a.account_id = e.account_id WHERE e.currency <> a.currency",
    "external_id_conflicts": "SELECT household_id, external_id, count(*) AS n FROM (SELECT household_id, external_id FROM {transactions} t WHERE NOT EXISTS (SELECT 1 FROM {transactions} r WHERE r.reverses_id = t.transaction_id) UNION ALL SELECT household_id, external_id FROM {statement_lines}) x WHERE external_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "ownership_overlap": """SELECT o_custkey, o_orderkey, begins FROM (SELECT o_custkey, o_orderkey, cast(o_orderdate AS date) AS begins, max(cast(o_orderdate AS date) + 30) OVER (PARTITION BY o_custkey ORDER BY cast(o_orderdate AS date), o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {orders}) x WHERE reach >= begins""",
    "reversal_mirror": "SELECT transaction_id, account_id, cast(-amount AS decimal(28,10)) AS amount, currency, instrument_id, cast(-quantity AS decimal(38,18)) AS quantity FROM {base_entries} WHERE transaction_id IN (SELECT transaction_id FROM {transactions} WHERE import_id = 7 AND reverses_id IS NULL)",
    "rollback_delta": """SELECT transaction_id + 2000000000 AS transaction_id, household_id, kind, transaction_id AS reverses_id, concat('Reversal of ', cast(transaction_id AS varchar)) AS description FROM {transactions} t
        WHERE import_id = 11 AND reverses_id IS NULL AND NOT EXISTS (SELECT 1 FROM {transactions} r WHERE r.reverses_id = t.transaction_id)""",
    "import_runs": "SELECT household_id, import_id, count(*) AS n, min(booked_on) AS first_on, max(booked_on) AS last_on FROM {transactions} GROUP BY 1, 2",
}
QUERIES = {n: globals()[n] for n in ORACLES}
