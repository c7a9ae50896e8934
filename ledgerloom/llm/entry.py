"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import ann, decontaminate, dedup, licenses, mixing, neardup, negatives, phrases, quality, secrets, sharding, toxicity, urls
from ledgerloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": lambda s, d: decontaminate.op1_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_license_scan": lambda s, d: licenses.op2_license_scan(table(s, d, "documents")),
        "op3_mixing": lambda s, d: mixing.op3_mixing(table(s, d, "documents")),
        "op4_secret_scan": lambda s, d: secrets.op4_secret_scan(table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.op5_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op6_nearest": lambda s, d: ann.op6_nearest(table(s, d, "embeddings")),
        "op7_sharding": lambda s, d: sharding.op7_sharding(table(s, d, "documents")),
        "op8_quality": lambda s, d: quality.op8_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op9_ngram_jaccard": lambda s, d: neardup.op9_ngram_jaccard(table(s, d, "documents")),
        "op10_url_filter": lambda s, d: urls.op10_url_filter(table(s, d, "pages"), table(s, d, "labels")),
        "op11_exact_dedup": lambda s, d: dedup.op11_exact_dedup(table(s, d, "documents")),
        "op12_hard_negatives": lambda s, d: negatives.op12_hard_negatives(table(s, d, "embeddings")),
        "op13_collocations": lambda s, d: phrases.op13_collocations(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_exact_dedup": dedup.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL, "op13_collocations": phrases.ORACLE_SQL}
