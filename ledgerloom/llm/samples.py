"""Bounded samples of labelled texts, the only rows that are brought to the driver, to fit classifiers there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int, longest: int, extra: tuple[str, ...] = ()) -> tuple[list, float]:
    """Up to ``most`` rows of each class in the order of a hash of the id, and the share of class 1 among all labels.

    Texts of over ``longest`` bytes are not learnt from, so the sample holds 2 * most * longest bytes at most.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    docs = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") <= longest)).select("doc_id", "text", *extra)
    shuffled = F.xxhash64(F.lit(17), "doc_id")
    rows = []
    for value in (0, 1):
        # labels without a document, or with a long one, leave the class that much smaller
        ids = known.filter(F.col("label") == value).orderBy(shuffled, "doc_id").limit(most).select("doc_id", "label")
        # ids has ``most`` rows at most, so it may be broadcast
        rows += docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).orderBy(shuffled, "doc_id").limit(most).collect()
    return rows, 0.5 if share is None else float(share)
