"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``y(x) = w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]``: the pairwise interactions of all
features cost time linear in their number.  The machine is fitted by Adam in numpy on a bounded sample of
labelled rows; executors score whole texts with a table of fixed size.

Features: words hashed to buckets, weighted log(1 + count) and scaled to length 1; statistics of the text's
structure (below) and its recorded length, scaled by mean and deviation of the sample.

Defined results: null and empty texts have no words and zero statistics and are scored like any other; a null
record of length counts as the text's own; repeated rows are scored each; without labels of both classes every score is the
share of class 1; an empty table gives an empty result; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.llm import textvec
from ledgerloom.llm.common import bounded_batches, crc_bucket
from ledgerloom.llm.samples import labelled_sample

BITS = 15
BUCKETS = 1 << BITS
RANK = 8
#: Names of the dense features, in order.
STATISTICS = ("log_bytes", "log_words", "log_lines", "symbol_share", "upper_share", "digit_share", "space_share", "other_share",
              "mean_word", "word_variety", "repeat_share", "log_recorded")
_KIND = np.zeros(256, np.int64)  # 0 other, 1 blank, 2 digit, 3 upper, 4 lower, 5 symbol
_KIND[[9, 10, 13, 32]] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = 3
_KIND[0x61:0x7B] = 4
_KIND[[*range(0x21, 0x2C), 0x2F, *range(0x3B, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 5


def features(texts: list[str | None], recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of the hashed words, sorted by text, and the dense statistics."""
    words = textvec.read(texts)
    n = len(texts)
    counts = words.counts.astype(float)
    key, times = np.unique(words.doc * BUCKETS + (words.hash >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc, bucket = key // BUCKETS, key % BUCKETS
    weight = np.log1p(times)
    weight /= np.sqrt(np.bincount(doc, weights=weight * weight, minlength=n))[doc]
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    size = np.array([len(r) for r in raw], float)
    kinds = _KIND[np.frombuffer(b"".join(raw), np.uint8)]
    tally = np.bincount(np.repeat(np.arange(n), size.astype(int)) * 6 + kinds, minlength=6 * n).reshape(n, 6) / np.maximum(size, 1)[:, None]
    lines = np.array([r.count(b"\n") for r in raw], float)
    same = np.zeros(len(words.hash))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    per = np.maximum(counts, 1)
    own = np.where(np.isfinite(recorded), recorded, size)
    dense = np.stack([
        np.log1p(size), np.log1p(counts), np.log1p(lines), tally[:, 5], tally[:, 3], tally[:, 2], tally[:, 1], tally[:, 0],
        np.bincount(words.doc, weights=words.end - words.start, minlength=n) / per,
        np.bincount(doc, minlength=n) / per, np.bincount(words.doc, weights=same, minlength=n) / per, np.log1p(np.maximum(own, 0)),
    ], axis=1)
    return doc, bucket, weight, dense


def _forward(n: int, doc: np.ndarray, bucket: np.ndarray, weight: np.ndarray, dense: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear and pairwise part, and the sums of v x; rows of w and v: buckets, then statistics."""
    linear = np.bincount(doc, weights=weight * w[bucket], minlength=n) + dense @ w[BUCKETS:]
    sums, squares = dense @ v[BUCKETS:], (dense**2) @ (v[BUCKETS:] ** 2).sum(1)
    for f in range(v.shape[1]):
        sums[:, f] += np.bincount(doc, weights=weight * v[bucket, f], minlength=n)
    squares = squares + np.bincount(doc, weights=weight**2 * (v**2).sum(1)[bucket], minlength=n)
    return linear + 0.5 * ((sums**2).sum(1) - squares), sums


def train(texts: list[str], recorded: np.ndarray, labels: np.ndarray, *, epochs: int = 60, rate: float = 0.03, decay: float = 1e-4, seed: int = 5) -> dict:
    parts = []
    for s in textvec.slices(texts):  # in slices, so that only features are held for all texts
        doc, bucket, weight, dense = features(texts[s], recorded[s])
        parts.append(((doc + s.start).astype(np.int32), bucket.astype(np.int32), weight.astype(np.float32), dense))
    doc, bucket, weight, dense = (np.concatenate(x) for x in zip(*parts, strict=True))
    mean, scale = dense.mean(0), dense.std(0) + 1e-6
    dense = np.clip((dense - mean) / scale, -5, 5)
    n, rng = len(texts), np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(BUCKETS + len(STATISTICS)), rng.normal(0, 0.05, (BUCKETS + len(STATISTICS), RANK))
    slots = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(v), np.zeros_like(v)], [np.zeros(1), np.zeros(1)]]
    y = labels.astype(float)
    for step in range(1, epochs + 1):
        z, sums = _forward(n, doc, bucket, weight, dense, w, v)
        g = (1 / (1 + np.exp(-np.clip(z + w0, -40, 40))) - y) / n
        gw = np.concatenate([np.bincount(bucket, weights=g[doc] * weight, minlength=BUCKETS), dense.T @ g])
        own = np.concatenate([np.bincount(bucket, weights=g[doc] * weight**2, minlength=BUCKETS), (dense**2).T @ g])
        gv = np.empty_like(v)
        for f in range(RANK):
            gv[:BUCKETS, f] = np.bincount(bucket, weights=g[doc] * weight * sums[doc, f], minlength=BUCKETS)
        gv[BUCKETS:] = dense.T @ (g[:, None] * sums)
        gv -= v * own[:, None]
        w0_ = np.array([w0])
        for (m, s), value, grad in zip(slots, (w, v, w0_), (gw + decay * w, gv + decay * v, np.array([g.sum()])), strict=True):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        w0 = float(w0_[0])
    return {"w0": w0, "w": w, "v": v, "mean": mean, "scale": scale}


def logits(texts: list[str | None], recorded: np.ndarray, model: dict) -> np.ndarray:
    doc, bucket, weight, dense = features(texts, recorded)
    dense = np.clip((dense - model["mean"]) / model["scale"], -5, 5)
    return _forward(len(texts), doc, bucket, weight, dense, model["w"], model["v"])[0] + model["w0"]


def scorer(docs: DataFrame, labels: DataFrame, *, label: str = "quality", fold: int = 3, held: int = 1, sample: int = 1200, longest: int = 20_000) -> Callable[[Column, Column], Column]:
    """Train, and give the function from texts and recorded lengths to scores.  Only labels whose crc bucket is not ``held`` are learnt."""
    bounded_batches(docs.sparkSession)
    rows, share = labelled_sample(docs, labels, label, crc_bucket(F.col("doc_id"), fold) != held, sample, longest, ("n_chars",))
    y = np.array([r["label"] for r in rows], int)
    model = None
    if len(set(y)) == 2:
        model = train([r["text"] for r in rows], np.array([np.nan if r["n_chars"] is None else r["n_chars"] for r in rows], float), y)
        seen, share = np.clip(y.mean(), 1e-3, 1 - 1e-3), np.clip(share, 1e-3, 1 - 1e-3)
        model["w0"] += float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    prior = float(np.clip(share, 0, 1))
    held_model = docs.sparkSession.sparkContext.broadcast(model)  # 2.4 MB whatever the corpus

    @F.pandas_udf(DoubleType())
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, chars in batches:
            column, recorded = texts.tolist(), chars.to_numpy(float)
            if held_model.value is None:
                yield pd.Series(np.full(len(column), prior))
            else:
                z = np.concatenate([logits(column[s], recorded[s], held_model.value) for s in textvec.slices(column)]) if column else np.empty(0)
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scores


def op8_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Scores of all documents; ``predicted`` is 1 from ``threshold`` on."""
    good = scorer(docs, labels)
    scored = docs.select("doc_id", good(F.col("text"), F.col("n_chars").cast("double")).alias("quality_score"))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
