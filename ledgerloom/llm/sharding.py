"""Sharding by proportional stratified interleaving, in DataFrame operations alone.

Rows of each source are shuffled by a seeded hash and ranked; ordering all rows by their fractional rank
``(rank - 1/2) / rows of the source`` spreads every source evenly, so that equal cuts of that order hold the
corpus mixture each.  Ranks come from two levels, so neither a source nor the whole order is ever one task:
the hash's leading bits name about sqrt(n) cells, counts by cell give offsets, and rows are numbered inside
cells only.

Defined results: null sources form one source of their own; null texts and ids are ordinary values; rows
that repeat are all kept, each in a slot of its own; an empty table gives an empty result; extra columns
pass through, but columns named ``shard`` or ``slot`` (in any case) give way to the results of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, *, payload: list[Column] | None = None,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``payload`` (by default every column), then ``shard`` int and ``slot`` long.

    Shard sizes differ by one row at most; slots count from 0 without gaps in each shard.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    total = docs.count()
    bits = max(1, math.ceil(math.log2(max(total, 2)) / 2))
    if payload is None:
        payload = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(
        F.struct(*payload).alias("row"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    ).withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
    kind = ["no_source", "source"]
    before = Window.partitionBy(*kind).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy(*kind, "cell").agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("of_source", F.sum("n").over(Window.partitionBy(*kind)))
        .drop("n")
    )
    ranked = (
        rows.withColumn("k", F.row_number().over(Window.partitionBy(*kind, "cell").orderBy("h")))
        .join(cells, [*kind, "cell"])
        .withColumn("fraction", (F.col("offset") + F.col("k") - 0.5) / F.col("of_source"))
        .withColumn("slice", F.floor(F.col("fraction") * (1 << bits)))
    )
    slices = (
        ranked.groupBy("slice").agg(F.count("*").alias("n"))
        .select("slice", F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("slice_offset"))
    )
    inside = Window.partitionBy("slice").orderBy("fraction", *kind, "h")
    return (
        ranked.withColumn("nth", F.row_number().over(inside))
        .join(slices, "slice")
        .withColumn("place", (F.col("slice_offset") + F.col("nth") - 1).cast("long"))
        .withColumn("to_shard", F.expr(f"(place * {shards}L) div {max(total, 1)}L"))
        .withColumn("first", F.expr(f"(to_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L"))
        .select("row.*", F.col("to_shard").cast("int").alias("shard"), (F.col("place") - F.col("first")).alias("slot"))
    )


def op7_sharding(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """The sharding as rows of ids and digests, for the law ``rows``."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = interleave(docs.select("doc_id", "text", "source"), shards, seed, payload=[
        F.col("doc_id"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.col("source"),
    ])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
