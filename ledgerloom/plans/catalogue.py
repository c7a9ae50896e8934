"""All registered queries over the ledger, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import access, balances, cascades, ingestion, instruments, ledger, matching, posting, rules, valuation
from ledgerloom.plans.bridge import Ledger, oracle

MODULES = (balances, ledger, matching, rules, ingestion, access, cascades, posting, valuation, instruments)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, f=f: f(Ledger(s, d))) for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(text) for m in MODULES for name, text in m.ORACLES.items()}
