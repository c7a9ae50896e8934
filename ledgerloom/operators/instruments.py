"""Instruments that imported lines name: found by ISIN, else one of each name in the import, the missing ones made."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.bridge import Ledger


class Resolved(NamedTuple):
    by_key: DataFrame  # key, instrument_id, created
    missing: DataFrame  # rows to add to the instruments


def instrument_key(isin: Column, name: Column) -> Column:
    """The ISIN where there is one, else the lower-cased name; no name counts as an empty one."""
    return F.coalesce(F.concat(F.lit("isin:"), isin), F.concat(F.lit("name:"), F.lower(F.coalesce(name, F.lit("")))))


def resolve(import_id: int, wanted: DataFrame, known: DataFrame) -> Resolved:
    """``wanted`` (ordinal, isin, symbol, name, currency, kind), a row a line, against ``known`` (instrument_id string, isin).

    Of the lines of one key the last one describes the instrument.  Only an ISIN finds a known one: a name alone is one
    instrument inside an import and a new one in the next.  Of known ones that share an ISIN the greatest id is taken.  New
    ids follow from import and key, so a repeated import makes the same ones.
    """
    described = F.struct("isin", "symbol", "name", "currency", "kind")
    lines = wanted.select(instrument_key(F.col("isin"), F.col("name")).alias("key"), "ordinal", described.alias("last"))
    keys = lines.groupBy("key").agg(F.max_by("last", F.struct("ordinal", "last")).alias("last"))
    held = known.filter("isin is not null").groupBy(F.concat(F.lit("isin:"), F.col("isin")).alias("key")).agg(F.max("instrument_id").alias("known_id"))
    own_id = F.sha2(F.concat_ws("\x1f", F.lit(str(import_id)), "key"), 256)
    met = keys.join(held, "key", "left").select("key", F.coalesce("known_id", own_id).alias("instrument_id"), F.col("known_id").isNull().alias("created"), "last")
    return Resolved(met.select("key", "instrument_id", "created"), met.filter("created").select("instrument_id", "last.*"))


def _part_isin(key: Column) -> Column:
    """Parts stand for holdings: two of three have an ISIN of their own."""
    return F.when(key % 3 != 0, F.concat(F.lit("XS"), F.lpad(key.cast("string"), 10, "0")))


def _resolved(ledger: Ledger) -> tuple[DataFrame, Resolved]:
    parts = ledger.table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", _part_isin(F.col("p_partkey")).alias("isin"))
    known = parts.filter("p_size <= 25").select(F.concat(F.lit("part-"), F.col("p_partkey")).alias("instrument_id"), "isin")
    # lines of one part name one instrument, so only the last of them and their number meet the parts
    lines = ledger.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.count("*").alias("n"))
    wanted = lines.join(parts, "p_partkey").select("ordinal", "n", "isin", F.col("p_brand").alias("symbol"), F.col("p_name").alias("name"), F.lit("EUR").alias("currency"), F.lower("p_type").alias("kind"))
    return wanted, resolve(1, wanted, known)


def instruments_of_lines(ledger: Ledger) -> DataFrame:
    """Each instrument that lines name, whether it is new, and on how many lines it stands."""
    wanted, found = _resolved(ledger)
    counts = wanted.groupBy(instrument_key(F.col("isin"), F.col("name")).alias("key")).agg(F.sum("n").alias("n"))
    return counts.join(found.by_key, "key").select("key", "instrument_id", "created", "n")


def instruments_added(ledger: Ledger) -> DataFrame:
    """The instruments that an import of all lines adds, as their last lines describe them."""
    return _resolved(ledger)[1].missing


_PARTS = "SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN 'XS' || lpad(cast(p_partkey AS varchar), 10, '0') END AS isin FROM part"
_KEYS = f"""SELECT key, n, w.p_name, w.p_brand, w.p_type, w.isin, 'part-' || k.p_partkey AS known_id FROM
    (SELECT *, count(*) OVER (PARTITION BY key) AS n, row_number() OVER (PARTITION BY key ORDER BY l_orderkey DESC, l_linenumber DESC, p_brand DESC, p_name DESC, lower(p_type) DESC) AS nth FROM
    (SELECT coalesce('isin:' || isin, 'name:' || lower(p_name)) AS key, * FROM lineitem JOIN ({_PARTS}) p ON p_partkey = l_partkey) l) w
    LEFT JOIN ({_PARTS}) k ON k.isin = w.isin AND k.p_size <= 25 WHERE nth = 1"""
_ID = "sha256(concat_ws(chr(31), '1', key))"
ORACLES = {
    "instruments_of_lines": f"SELECT key, coalesce(known_id, {_ID}) AS instrument_id, known_id IS NULL AS created, n FROM ({_KEYS}) k",
    "instruments_added": f"SELECT {_ID} AS instrument_id, isin, p_brand AS symbol, p_name AS name, 'EUR' AS currency, lower(p_type) AS kind FROM ({_KEYS}) k WHERE known_id IS NULL",
}
QUERIES = {n: globals()[n] for n in ORACLES}
