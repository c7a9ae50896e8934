"""Toxicity by subword bags: embeddings of character n-grams, averaged into a linear softmax.

A word's vector is the mean of the vectors of its hashed n-grams (and of the word itself), a text's vector the
mean of its words'; both the embeddings and the softmax are trained jointly in numpy, on the driver, from a
bounded sample of labelled rows.  Misspellings and inflections that were never seen share n-grams with words
that were.  As the softmax of two classes is linear in the text's vector, the trained model folds into one
number a bucket, and executors score whole texts with a table of fixed size.  Serving departs from the plain
mean, which drowns the few words that matter among thousands of plain ones (README has both figures): a word
takes part in the mean only by what it exceeds a threshold by, which is chosen, like the final logistic layer in
place of the softmax's own, on a fifth of the sample that was not trained on.

Defined results: null and empty texts, and texts of plain words alone, get the final layer's score of a mean of
zero; null ids are held out or not by the crc of the empty text; repeated rows are scored each, alike; without
labels of both classes every score is the share of class 1 (0.5 without any label); an empty table gives an empty
result; extra columns, whatever their names, pass by.
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

SIZES = (3, 4)
BUCKETS = 1 << 17
RANK = 4
#: Texts of this score or more are toxic.
REJECT = 0.3


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 17)).astype(np.int64)


def _ragged_mean(values: np.ndarray, bounds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.add.reduceat(values, bounds, axis=0)
    return out / np.maximum(sizes, 1)[:, None].astype(values.dtype)


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 70, rate: float = 0.05, decay: float = 2e-4, fewest: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Fit by full-batch Adam; returns the folded weight of every bucket and the bias."""
    n_docs, parts = len(texts), []
    for s in textvec.slices(texts):  # in slices, so that only words and their buckets are held for all texts
        words = textvec.read(texts[s])
        unique, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
        starts = np.zeros(len(words.data) + 1, np.int32)
        starts[words.start] = 1
        nth = np.cumsum(starts, dtype=np.int32) - 1
        # n-grams of the first occurrence of each different word; the blank before a word belongs to it
        is_first = np.zeros(len(words.hash), bool)
        is_first[first] = True
        owners, buckets = [np.arange(len(unique))], [_bucket(unique)]
        for at, h in textvec.grams(words, SIZES):
            of = np.where(words.word_byte[at], nth[at], nth[at + 1])
            mine = is_first[of]
            owners.append(word[of[mine]])
            buckets.append(_bucket(h[mine]))
        pair, times = np.unique(words.doc * len(unique) + word, return_counts=True)
        parts.append((unique, np.concatenate(owners).astype(np.int32), np.concatenate(buckets).astype(np.int32),
                      (pair // max(len(unique), 1) + s.start).astype(np.int32), (pair % max(len(unique), 1)).astype(np.int32), times.astype(np.int32)))
    origin = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    every, seen_at, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n_words, offset = len(every), np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    owners, buckets, docs_of, words_of = [], [], [], []
    for k, (_, o, g, d, w, _t) in enumerate(parts):
        to = back[offset[k]:offset[k + 1]]
        new = origin[seen_at[to]] == k
        owners.append(to[o[new[o]]])
        buckets.append(g[new[o]])
        docs_of.append(d)
        words_of.append(to[w])
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    times = np.concatenate([p[5] for p in parts])
    pd_, pw = np.concatenate(docs_of), np.concatenate(words_of)
    del parts, owners, buckets
    size_w = np.bincount(owner, minlength=n_words)
    # buckets of few texts could only be learnt by heart: they stay at zero
    spread = np.bincount(bucket, weights=np.bincount(pw, minlength=n_words)[owner], minlength=BUCKETS)
    common = spread[bucket] >= fewest
    bare = ~np.bincount(owner[common], minlength=n_words).astype(bool)
    lone = np.flatnonzero(bare[owner])
    common[lone[np.unique(owner[lone], return_index=True)[1]]] = True  # each word keeps one
    owner, bucket = owner[common], bucket[common]
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    used, compact = np.unique(bucket, return_inverse=True)
    bound_w = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_words))[:-1]])
    back_g = np.argsort(compact, kind="stable")
    bound_g = np.concatenate([[0], np.cumsum(np.bincount(compact))[:-1]])
    docs_in, compact_doc = np.unique(pd_, return_inverse=True)
    y = labels[docs_in].astype(np.float32)
    size_d = np.bincount(compact_doc, weights=times)
    bound_d = np.concatenate([[0], np.cumsum(np.bincount(compact_doc))[:-1]])
    back_w = np.argsort(pw, kind="stable")
    bound_pw = np.concatenate([[0], np.cumsum(np.bincount(pw, minlength=n_words))[:-1]])
    times = times.astype(np.float32)[:, None]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(used), RANK)).astype(np.float32), rng.normal(0, 0.5, (RANK, 2)).astype(np.float32), np.zeros(2, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    scale = np.float32(20.0)  # texts are long: one word in fifty must still move the mean
    for step in range(1, epochs + 1):
        e, w, b = params
        wv = _ragged_mean(e[compact], bound_w, size_w)
        dv = np.add.reduceat(wv[pw] * times, bound_d, axis=0) / size_d[:, None].astype(np.float32) * scale
        z = dv @ w + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = p.copy()
        g[np.arange(len(y)), y.astype(int)] -= 1
        g /= len(y)
        gd = (g @ w.T) * scale / size_d[:, None].astype(np.float32)
        gw = np.add.reduceat((gd[compact_doc] * times)[back_w], bound_pw, axis=0)
        ge = np.add.reduceat((gw / size_w[:, None].astype(np.float32))[owner[back_g]], bound_g, axis=0)
        for k, (grad, value) in enumerate(zip((ge + decay * e, dv.T @ g + decay * w, g.sum(0)), params, strict=True)):
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    e, w, b = params
    folded = np.zeros(BUCKETS, np.float32)
    folded[used] = (e @ (w[:, 1] - w[:, 0])) * scale
    folded[spread < fewest] = 0
    return folded, float(b[1] - b[0])


def shrunk_means(texts: list[str | None], folded: np.ndarray, threshold: float) -> np.ndarray:
    """Mean over a text's words of what a word's weight exceeds ``threshold`` by; 0 for no words."""
    words = textvec.read(texts)
    if not len(words.hash):
        return np.zeros(len(texts))
    weights = np.maximum(word_weights(words, folded) - threshold, 0)
    return np.bincount(words.doc, weights=weights, minlength=len(texts)) / np.maximum(words.counts, 1)


def word_weights(words: textvec.Words, folded: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(words.data) + 1, np.float32), np.zeros(len(words.data) + 1, np.float32)
    for at, h in textvec.grams(words, SIZES):
        total[at] += folded[_bucket(h)]
        count[at] += 1
    bounds = words.start - 1
    return (np.add.reduceat(total, bounds) + folded[_bucket(words.hash)]) / (np.add.reduceat(count, bounds) + 1)


def calibrate(texts: list[str], labels: np.ndarray, folded: np.ndarray, share: float) -> dict:
    """On texts that were not trained on: the shrinkage that ranks best, and a logistic curve from means to scores.

    The random weights of common words add up over long texts; the few words that matter stand far above them.
    """
    words = textvec.read(texts)
    weights = word_weights(words, folded)
    best = (-1.0, 0.0)
    for q in (0.5, 0.8, 0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.993, 0.995, 0.997):
        t = max(float(np.quantile(weights, q)), 1e-6)
        means = np.bincount(words.doc, weights=np.maximum(weights - t, 0), minlength=len(texts)) / np.maximum(words.counts, 1)
        order = np.sort(means[labels == 0])
        rank = (np.searchsorted(order, means[labels == 1], "left") + np.searchsorted(order, means[labels == 1], "right")).mean() / (2 * max(len(order), 1))
        best = max(best, (round(rank, 3), t))
    threshold = best[1]
    means = shrunk_means(texts, folded, threshold)
    floor = max(float(np.median(means[labels == 1])) * 0.05, 1e-6)
    x = np.stack([np.ones(len(texts)), np.log(means + floor) - np.log(floor)], axis=1)
    beta, ridge = np.zeros(2), np.diag([1e-6, 1e-2])
    prior = np.where(labels == 1, share / max(labels.mean(), 1e-3), (1 - share) / max(1 - labels.mean(), 1e-3))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (prior * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (prior * (labels - p)) - ridge @ beta)
    return {"threshold": threshold, "floor": floor, "bias": float(beta[0]), "slope": float(beta[1])}


def logits(texts: list[str | None], folded: np.ndarray, curve: dict) -> np.ndarray:
    means = shrunk_means(texts, folded, curve["threshold"])
    return curve["bias"] + curve["slope"] * np.log(means / curve["floor"] + 1)


def scorer(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", fold: int = 4, held: int = 2, sample: int = 900, longest: int = 20_000) -> Callable[[Column], Column]:
    """Train, and give the function from a column of texts to one of scores.  Only labels whose crc bucket is not ``held`` are learnt.

    Only texts pass through Python; all other columns stay with Spark.
    """
    bounded_batches(docs.sparkSession)
    rows, share = labelled_sample(docs, labels, label, crc_bucket(F.col("doc_id"), fold) != held, sample, longest)
    y = np.array([r["label"] for r in rows], int)
    texts = [r["text"] for r in rows]
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    aside = np.arange(len(y)) % 5 == 4  # a fifth, in the order of the hash, to calibrate on
    if len(set(y[aside])) == 2 and len(set(y[~aside])) == 2:
        folded, _ = train([t for t, a in zip(texts, aside, strict=True) if not a], y[~aside])
        curve = calibrate([t for t, a in zip(texts, aside, strict=True) if a], y[aside], folded, share)
    else:
        folded, curve = np.zeros(BUCKETS, np.float32), {"threshold": 0.0, "floor": 1.0, "bias": float(np.log(share / (1 - share))), "slope": 0.0}
    model = docs.sparkSession.sparkContext.broadcast(folded)  # 512 KB whatever the corpus

    @F.pandas_udf(DoubleType())
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            column = batch.tolist()
            z = np.concatenate([logits(column[s], model.value, curve) for s in textvec.slices(column)]) if column else np.empty(0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scores


def op5_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """Scores of all documents; ``predicted`` is 1 from ``threshold`` on."""
    toxic = scorer(docs, labels)
    scored = docs.select("doc_id", toxic(F.col("text")).alias("toxic_score"))
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))
