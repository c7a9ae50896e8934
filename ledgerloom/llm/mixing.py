"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

For each source the document rates r minimise the relative entropy to rate 1 under one token constraint
``sum(r * size) = target`` and ``0 <= r <= 3``.  The convex dual has one multiplier per source and gives
exponentially tilted rates ``r = min(3, exp(multiplier * size / scale))``.  Newton steps on the logarithm
of the dual's gradient equation, guarded by a bracket, find the multipliers; each step is one aggregate over
the histogram of (source, size), never over the documents.  Rates become whole copies by cumulative
rounding along sizes: the error of a source telescopes to less than one document, and of sixteen starting
phases the one that comes nearest to the target is taken.

Defined results: null sources are one source, the last; null and blank texts have size 0, take no words and
are kept once; a source whose words are all 0 has target 0; repeated rows are mixed one by one; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, durable

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
UNIT = 1 << 20
SALTS = 32
PHASES = 16
KIND = ["no_source", "source"]


def words(text: Column) -> Column:
    """Words between blanks; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``target``: the shares by weight, where what exceeds thrice a source is shared again by weight.

    With sources in the order of (3 * size / weight), the level of the first source that is not stopped holds
    for all after it.  Sources are named groups, one row each: their few rows may meet in one task.
    """
    order = Window.orderBy(*KIND)
    everything = Window.partitionBy()
    weighed = sources.withColumn("nth", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("nth") - 1) % len(cycle) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * float(MOST)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", *KIND)
    levels = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("rest"))
        .withColumn("fits", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(everything))
    )
    free = F.col("place") >= F.col("fits.place")
    return levels.select(*KIND, "source_size", "scale", "least", F.when(free, F.col("weight") * F.col("fits.level")).otherwise(F.col("cap")).alias("target"))


def multipliers(histogram: DataFrame, sources: DataFrame, tolerance: float = 1e-7, steps: int = 200) -> DataFrame:
    """Solve the dual; one row a source with its ``tilt``."""
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST * (1 - 1e-12))
    top = F.lit(math.log(MOST) * 1.0001) * F.col("scale") / F.col("least")
    state = durable(
        sources.withColumn("low", -F.lit(60.0) * F.col("scale") / F.col("least")).withColumn("high", top)
        .withColumn("tilt", F.when(open_, F.least(F.log(F.col("target") / F.col("source_size")), top * 0.5)).when(F.col("target") > 0, top).otherwise(F.lit(0.0)))
        .withColumn("gap", F.when(open_, F.lit(1.0)).otherwise(F.lit(0.0))),
        "mix-state",
    )
    for _ in range(steps):
        x = F.col("size") / F.col("scale")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        sums = (
            histogram.join(state.select(*KIND, "tilt", "scale"), KIND)
            .groupBy(*KIND)
            .agg(F.sum(F.col("n") * F.col("size") * F.least(raw, F.lit(float(MOST)))).alias("got"),
                 F.sum(F.when(raw < MOST, F.col("n") * F.col("size") * x * raw).otherwise(0.0)).alias("slope"))
        )
        off = F.log(F.col("got") / F.col("target"))
        newton = F.col("tilt") - off * F.col("got") / F.col("slope")
        stepped = state.join(sums, KIND).withColumn("gap", F.when(F.col("gap") > 0, F.abs(F.col("got") / F.col("target") - 1)).otherwise(0.0))
        more = F.col("gap") > tolerance
        stepped = (
            stepped.withColumn("high", F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high")))
            .withColumn("low", F.when(F.col("got") <= F.col("target"), F.col("tilt")).otherwise(F.col("low")))
            .withColumn("newton", F.when((F.col("slope") > 0) & (F.col("got") > 0), newton))
            .withColumn("tilt", F.when(~more, F.col("tilt")).when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2))
        )
        before, state = state, durable(stepped.select(*state.columns), "mix-state")
        discard(before)
        if not state.filter(F.col("gap") > tolerance).limit(1).count():
            return state
    raise RuntimeError(f"the dual of {state.filter(F.col('gap') > tolerance).count()} sources is not solved after {steps} steps")


def mix(docs: DataFrame, *, payload: list[Column] | None = None, seed: int = 11, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", names: tuple[str, ...] = ("row", "size", "source_size", "target", "copies")) -> DataFrame:
    """One row a document: struct ``row`` (``payload`` or every column), size, source_size, target and copies."""
    rows = docs.select(
        (F.struct(*payload) if payload else F.struct("*")).alias("row"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    ).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    cell = [*KIND, "size", "salt"]
    histogram = durable(rows.groupBy(*cell).agg(F.count("*").alias("n")), "mix-histogram")
    tokens = F.col("n") * F.col("size")
    sources = histogram.groupBy(*KIND).agg(
        F.sum(tokens).alias("source_size"),
        F.coalesce(F.try_divide(F.sum(tokens.cast("double") * F.col("size")), F.sum(tokens)), F.lit(1.0)).alias("scale"),
        F.coalesce(F.min(F.when(F.col("size") > 0, F.col("size"))), F.lit(1)).cast("double").alias("least"),
    )
    solved = multipliers(histogram, targets(sources))
    rate = F.round(F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(MOST))) * UNIT).cast("long")
    before = Window.partitionBy(*KIND).orderBy("size", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        histogram.join(solved.select(*KIND, "source_size", "target", "scale", "tilt"), KIND)
        .withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(UNIT)))
        .withColumn("begin", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0)))
    )
    taken = [F.abs(F.sum(F.expr(f"size * ((begin + n * rate + {p * UNIT // PHASES}L) div {UNIT}L - (begin + {p * UNIT // PHASES}L) div {UNIT}L)")) - F.first("target")).alias(f"p{p}") for p in range(PHASES)]
    phases = cells.groupBy(*KIND).agg(*taken).select(*KIND, F.element_at(F.array_sort(F.array(*[F.struct(F.col(f"p{p}").alias("off"), F.lit(p * UNIT // PHASES).cast("long").alias("phase")) for p in range(PHASES)])), 1)["phase"].alias("phase"))
    cells = cells.join(phases, KIND).select(*cell, "source_size", "target", "rate", "begin", "phase")
    return (
        rows.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy("h")))
        .join(cells, cell)
        .withColumn("copies", F.expr(f"(begin + k * rate + phase) div {UNIT}L - (begin + (k - 1) * rate + phase) div {UNIT}L"))
        .select("row", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"))
    )


def op3_mixing(docs: DataFrame) -> DataFrame:
    """Digest of the mix: the words that it takes from each document."""
    mixed = mix(docs.select("doc_id", "text", "source"), payload=[F.col("doc_id"), F.col("source")])
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "row.source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    mixed = mix(docs)
    return mixed.filter("copies > 0").select(F.explode(F.expr("sequence(1, copies)")).alias("copy"), "row").select("row.*")
