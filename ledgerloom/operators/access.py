"""Tenants and roles: views that show one household only, and who may do what."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.bridge import Ledger

SECURED = ("accounts", "transactions", "entries")


def bind(ledger: Ledger, household: int | None) -> SparkSession:
    """A session of its own in which the secured views, and no other, are registered; they hold the household's rows, and none without one.

    The household is part of each view's plan: no setting of the session widens it, and no view of all rows exists there.
    """
    session = ledger.spark.newSession()
    inner = Ledger(session, ledger.sf_dir)
    own = F.lit(False) if household is None else F.col("household_id") == int(household)
    for name in SECURED:
        getattr(inner, name).filter(own).createOrReplaceTempView(name)
    return session


def assert_scoped(session: SparkSession) -> None:
    """Refuse a session that shows anything but the secured views."""
    if extra := {t.name for t in session.catalog.listTables()} ^ set(SECURED):
        raise PermissionError(f"not a tenant's session: {', '.join(sorted(extra))}")


def tenant_isolation(ledger: Ledger) -> DataFrame:
    """What the first household of each of the regions, a handful, sees in a session of its own: counts of its own rows only."""
    firsts = ledger.households.groupBy(F.split("path", "[.]")[1].alias("region")).agg(F.min("household_id").alias("household_id"))
    seen = []
    for r in firsts.collect():
        session = bind(ledger, r["household_id"])
        assert_scoped(session)
        seen.append(visible(session, "transactions").groupBy(F.lit(r["region"]).alias("region"), "household_id").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionAll, seen)


#: Roles from the strongest, and all actions.
ROLES = ("owner", "admin", "contributor", "viewer", "child")
ACTIONS = (
    "household:read", "household:update", "household:delete", "member:invite", "member:remove", "owner:read", "owner:write", "portfolio:read", "portfolio:write", "account:read", "account:write",
    "transaction:read", "transaction:create", "transaction:update", "transaction:delete", "category:read", "category:write", "import:run", "import:rollback", "connector:link", "connector:sync",
    "share:create", "export:run", "settings:update",
)
_READS = frozenset({"portfolio:read", "account:read", "transaction:read", "category:read"})
_VIEWER = _READS | {"household:read", "owner:read", "export:run"}
_WORK = {"portfolio:write", "account:write", "transaction:create", "transaction:update", "transaction:delete", "category:write", "import:run", "import:rollback"}
GRANTS = {"owner": frozenset(ACTIONS), "admin": frozenset(ACTIONS) - {"household:delete"}, "contributor": _VIEWER | _WORK, "viewer": _VIEWER, "child": _READS}


@dataclass(frozen=True)
class Actor:
    household: int
    role: str
    portfolios: frozenset[str] | None = None  # None: not limited


def at_least(role: str, needed: str) -> bool:
    return ROLES.index(role) <= ROLES.index(needed)


def refusal(actor: Actor, action: str, household: int, portfolio: str | None = None) -> str | None:
    """Why an actor may not do something, or None if they may."""
    if actor.household != household:
        return "another household"
    if action not in GRANTS[actor.role]:
        return f"a {actor.role} may not {action}"
    if actor.role not in ("owner", "admin") and actor.portfolios is not None and portfolio not in actor.portfolios:
        return "outside the portfolios"
    return None


def grants_table(spark: SparkSession) -> DataFrame:
    """(role, action) of everything that is granted, to join with requests in bulk."""
    return spark.createDataFrame([(r, a) for r in ROLES for a in ACTIONS if a in GRANTS[r]], "role string, action string")


def visible(session: SparkSession, name: str) -> DataFrame:
    if name not in SECURED:
        raise PermissionError(f"{name} is not a secured view")
    return session.table(name)


ORACLES = {
    "tenant_isolation": "SELECT region, t.household_id, count(*) AS n FROM {transactions} t JOIN (SELECT split_part(path, '.', 2) AS region, min(household_id) AS household_id FROM {households} GROUP BY 1) s ON s.household_id = t.household_id GROUP BY 1, 2",
}
QUERIES = {n: globals()[n] for n in ORACLES}
