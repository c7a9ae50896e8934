"""Benchmark decontamination by latent semantic retrieval, then longest-common-subsequence and answer checks.

1.  Texts and benchmark items become ids of the benchmark's words (others are -1); the ids are written down once.
2.  Passages are windows of 32 words, one every 16.  Document frequencies are counted over the passages of all
    documents, in the columns that the benchmark can match; words of over 5 % of passages weigh nothing in the
    cosine, which no result hangs on, as 4. finds the rest.
3.  A randomised SVD of the TF-IDF passages of the whole corpus: tasks multiply their passages with a random
    test matrix and back, and Spark sums the products, of fixed size: words of the benchmark x rank.
4.  Passages and items are projected; a passage whose cosine to an item, or to one of the item's own windows,
    passes a threshold makes the two a candidate.
    An exact rule finds the rest: of an item's rarest words so many must lie in a chunk of text that the
    subsequence of 5. can be long enough at all; what cannot pass that bound cannot pass 5. either.
5.  For candidates, the longest common subsequence of the item and the words around the passage must cover
    most of the item (a paraphrase may change, drop or add words) in a stretch of about the item's length, and
    most of the item's answer, its last sentence, in that same stretch.

The benchmark is cut into blocks of items of bounded bytes, and each block is broadcast and searched by itself,
so that neither the driver nor a task ever holds more of it.  Defined results: null and empty texts or items
match nothing; items of fewer than ``shortest`` words are matched where all their words follow each other;
repeated items and rows are matched each; a null id of a document or an item stays in its row; empty tables give
empty results; extra columns, whatever their names, pass by.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textvec
from ledgerloom.llm.common import bounded_batches, durable

HOP = 16
RANK = 96
OVERSAMPLE = 16
#: Bytes of a block of items; its words x rank matrices stay under 200 MB on the driver.
BLOCK_BYTES = 1 << 20
#: Cosines of a slice of passages with all probes of a block.
MOST_COSINES = 1 << 22
#: Texts whose passages are worked on at once, so that their vectors stay in a core's cache.
SLICE = 100
#: Words of the smallest chunks of the exact rule.
CHUNK = 128


@dataclass
class Benchmark:
    item: list[int | None]  # ids of items, one a row
    words: list[np.ndarray]  # their word ids
    answer: list[int]  # where each one's answer begins
    vocabulary: np.ndarray  # sorted word hashes
    longest: int


def blocks(items: DataFrame, size: int | None = None) -> list[DataFrame]:
    """The items with a text, in blocks of about ``size`` bytes."""
    held = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    total = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // (size or BLOCK_BYTES))
    return [held.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) for k in range(n)]


def read_benchmark(items: DataFrame) -> Benchmark:
    """Bring one block's items to the driver."""
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    hashes = [textvec.read([t]).hash for _, t in rows]
    vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
    answer = []
    for (_, t), h in zip(rows, hashes, strict=True):
        parts = [p for p in re.split(r"(?<=[.!?])\s+", t.strip()) if len(textvec.read([p]).hash)]
        answer.append(len(h) - len(textvec.read([parts[-1]]).hash) if len(parts) > 1 else 0)
    return Benchmark([i for i, _ in rows], [np.searchsorted(vocabulary, h).astype(np.int32) for h in hashes], answer, vocabulary, max((len(h) for h in hashes), default=0))


def _slots(vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """A table from a hash's leading bits to a place in the vocabulary, with room for few collisions."""
    bits = max(10, int(np.ceil(np.log2(len(vocabulary) + 1))) + 6)
    table = np.full(1 << bits, len(vocabulary), np.int32)
    slot = (vocabulary >> np.uint64(64 - bits)).astype(np.int64)
    table[slot[::-1]] = np.arange(len(vocabulary))[::-1]  # the first of a run of equal slots
    return table, bits


def word_ids(words: textvec.Words, vocabulary: np.ndarray) -> np.ndarray:
    """The place of each word in the sorted vocabulary, or -1."""
    n = len(vocabulary)
    if not n:
        return np.full(len(words.hash), -1, np.int32)
    table, bits = _slots(vocabulary)
    padded = np.append(vocabulary, np.uint64(0))
    place = table[(words.hash >> np.uint64(64 - bits)).astype(np.int64)]
    hit = padded[place] == words.hash
    open_ = np.flatnonzero(~hit & (place < n))
    while len(open_ := open_[place[open_] + 1 < n]):  # go on along the run of the slot
        place[open_] += 1
        same = (padded[place[open_]] >> np.uint64(64 - bits)) == (words.hash[open_] >> np.uint64(64 - bits))
        open_ = open_[same]
        done = padded[place[open_]] == words.hash[open_]
        hit[open_[done]] = True
        open_ = open_[~done]
    return np.where(hit & (place < n), place, -1).astype(np.int32)


def windows(ids: list[np.ndarray], table: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first hop, sums of the table's rows over the window) of all passages that hold a word at all.

    Only words that are ``live`` count; the last row of both tables stands for words outside the benchmark.
    """
    lengths = np.array([len(x) for x in ids], np.int64)
    hops = -(-lengths // HOP)
    if not hops.sum():
        return np.empty(0, int), np.empty(0, int), np.empty((0, table.shape[1]), table.dtype)
    first = np.concatenate([[0], np.cumsum(hops)[:-1]])
    flat = np.concatenate(ids)
    at = np.flatnonzero(live[flat])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    of = np.searchsorted(starts + lengths, at, side="right")
    hop = first[of] + (at - starts[of]) // HOP
    both = np.zeros((hops.sum(), table.shape[1]), table.dtype)
    if len(at):
        bounds = np.flatnonzero(np.diff(hop, prepend=-1))
        both[hop[bounds]] = np.add.reduceat(table[flat[at]], bounds, axis=0)
    doc = np.repeat(np.arange(len(ids)), hops)
    nth = np.arange(hops.sum()) - first[doc]
    more = nth + 1 < hops[doc]
    alive = np.zeros(len(doc), bool)
    alive[hop] = True
    alive[:-1] |= more[:-1] & alive[1:]
    # the last hop alone is a part of the window before, and the cosine of windows that are not alive is 0 with all
    whole = np.flatnonzero((more | (hops[doc] == 1)) & alive)
    sums = both[whole]
    sums[more[whole]] += both[whole[more[whole]] + 1]
    return doc[whole], nth[whole], sums


def _summed(frame: DataFrame, run: Callable) -> dict[int, np.ndarray]:
    """Sum matrices that tasks give as (row, values), and bring the sum, of fixed size, to the driver by row."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": part["row"].iloc[:1], "values": [np.sum(np.stack(part["values"].tolist()), axis=0)]})

    schema = "row int, values array<double>"
    return {r["row"]: np.array(r["values"]) for r in frame.mapInPandas(run, schema).groupBy("row").applyInPandas(add, schema).collect()}


def unpacked(column: pd.Series) -> list[np.ndarray]:
    """Ids of words as the written table holds them: bytes of 32-bit numbers, which no reader takes apart."""
    return [np.frombuffer(x, np.int32) for x in column]


def _passage_matrix(ids: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Disjoint passages of 32 words as sparse TF-IDF rows of length 1: (passage, word, weight, passages)."""
    passage, word, base = [], [], 0
    for x in ids:
        good = np.flatnonzero((x >= 0) & (idf[x] > 0))
        passage.append(good // (2 * HOP) + base)
        word.append(x[good])
        base += -(-len(x) // (2 * HOP))
    p, w = (np.concatenate(passage), np.concatenate(word).astype(np.int64)) if passage else (np.empty(0, int), np.empty(0, int))
    key, times = np.unique(p * len(idf) + w, return_counts=True)
    p, w = key // len(idf), key % len(idf)
    weight = times * idf[w]
    norm = np.sqrt(np.bincount(p, weights=weight**2, minlength=base))
    return p, w, weight / np.maximum(norm[p], 1e-12), base


def latent_basis(ids: DataFrame, idf: np.ndarray, seed: int = 23) -> np.ndarray:
    """Right singular vectors of the corpus's passages over their singular values (words x RANK).

    One pass: with A the passages, tasks give Y = A'(A W) for a random orthonormal W; the factor
    Y (W'Y)^(-1/2) then has A's right singular vectors.  Dividing by the singular values keeps the few
    directions that only tell languages and styles apart from hiding what passages are about.
    """
    n = len(idf)
    width = min(RANK + OVERSAMPLE, n)
    test, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))
    held = ids.sparkSession.sparkContext.broadcast(test.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, width), np.float32)
        for batch in batches:
            for begin in range(0, len(batch), SLICE):
                p, w, weight, _ = _passage_matrix(unpacked(batch["ids"][begin:begin + SLICE]), idf)
                if not len(p):
                    continue
                weight = weight.astype(np.float32)[:, None]
                bounds = np.flatnonzero(np.diff(p, prepend=-1))
                small = np.add.reduceat(held.value[w] * weight, bounds, axis=0)
                back = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(p))))
                order = np.argsort(w, kind="stable")
                cuts = np.flatnonzero(np.diff(w[order], prepend=-1))
                total[w[order][cuts]] += np.add.reduceat(small[back[order]] * weight[order], cuts, axis=0)
        used = np.flatnonzero(np.abs(total).sum(1))
        if len(used):
            yield pd.DataFrame({"row": used.astype(np.int32), "values": list(total[used].astype(float))})

    y = np.zeros((n, width))
    for k, v in _summed(ids, run).items():
        y[k] = v
    small = test.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    good = values > max(values[-1], 1e-12) * 1e-9
    if not good.any():  # no passage holds a word of the benchmark
        return np.zeros((n, 1))
    factor = y @ (vectors[:, good] / np.sqrt(values[good]))
    left, singular, _ = np.linalg.svd(factor, full_matrices=False)
    keep = singular[:RANK] > singular[0] * 1e-6
    return left[:, :RANK][:, keep] / singular[:RANK][keep]


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = row = (1 << len(a)) - 1
    for x in b:
        m = row & masks.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def fewest(length: int, covered: float) -> int:
    """The least number of words that covers the share ``covered`` of an item."""
    n = int(covered * length)
    return n if n / length >= covered else n + 1


def reach(length: int) -> int:
    """Words of the stretch in which an item's subsequence must lie."""
    return int(1.3 * length) + 1


@dataclass
class Rarest:
    """Items of one class of lengths by their rarest words; a stretch of any of them lies in one chunk of two blocks."""

    block: int
    first: np.ndarray  # by word, its first place in ``owner``
    owner: np.ndarray  # item of each occurrence of a word among an item's rarest
    need: np.ndarray  # by item, occurrences that a chunk must hold


def rarest_words(words: list[np.ndarray], df: np.ndarray, covered: float, shortest: int) -> list[Rarest]:
    """Of an item, all but ``most`` places must be matched, so of any more places than that, the excess."""
    classes: dict[int, list[int]] = {}
    for k, x in enumerate(words):
        if len(x) >= shortest:
            classes.setdefault(max(CHUNK, 1 << (reach(len(x)) - 1).bit_length()), []).append(k)
    out = []
    for block, members in sorted(classes.items()):
        need, word, owner = np.zeros(len(words), np.int64), [], []
        for k in members:
            x = words[k]
            least = fewest(len(x), covered)
            most = len(x) - least
            need[k] = -(-least // 2)
            word.append(x[np.argsort(df[x], kind="stable")[: most + need[k]]])
            owner.append(np.full(len(word[-1]), k))
        w, o = np.concatenate(word), np.concatenate(owner)
        order = np.argsort(w, kind="stable")
        out.append(Rarest(block, np.searchsorted(w[order], np.arange(len(df) + 1)), o[order], need))
    return out


def holding_chunks(ids: list[np.ndarray], rarest: Rarest) -> np.ndarray:
    """(text, item, first word) of every chunk that holds enough of an item's rarest words."""
    block, n, items = rarest.block, len(rarest.first) - 1, len(rarest.need)
    lengths = np.array([len(x) for x in ids], np.int64)
    blocks = -(-lengths // block)
    base = np.cumsum(blocks) - blocks
    if not blocks.sum():
        return np.empty((0, 3), np.int64)
    flat = np.concatenate(ids)
    # the last row stands for words outside the benchmark
    used = np.append(np.diff(rarest.first) > 0, False)
    at = np.flatnonzero(used[flat])
    doc = np.repeat(np.arange(len(ids)), lengths)[at]
    nth = (at - (np.cumsum(lengths) - lengths)[doc]) // block
    held = np.unique((base[doc] + nth) * n + flat[at])
    chunk, word = held // n, held % n
    doc = np.repeat(np.arange(len(ids)), blocks)
    # a block belongs to the chunk that begins with it, and to the one before; the last chunk of a text begins before its last block
    before = np.where(chunk > base[doc[chunk]], chunk - 1, -1)
    own = np.where((chunk + 1 < (base + blocks)[doc[chunk]]) | (blocks[doc[chunk]] == 1), chunk, -1)
    both = np.concatenate([own * n + word, before * n + word])
    both = np.unique(both[np.concatenate([own, before]) >= 0])
    chunk, word = both // n, both % n
    times = rarest.first[word + 1] - rarest.first[word]
    place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(rarest.first[word], times)
    key, count = np.unique(np.repeat(chunk, times) * items + rarest.owner[place], return_counts=True)
    key = key[count >= rarest.need[key % items]]
    chunk = key // items
    return np.stack([doc[chunk], key % items, (chunk - base[doc[chunk]]) * block], axis=1)


def likely_hops(text: np.ndarray, item: np.ndarray, begin: int, end: int, covered: float) -> np.ndarray:
    """Hops of a chunk from which a stretch of the item's reach holds enough of its words."""
    inside = np.concatenate([[0], np.cumsum(np.isin(text[begin:end], item))])
    size = min(reach(len(item)), len(inside) - 1)
    good = np.flatnonzero(inside[size:] - inside[: len(inside) - size] >= fewest(len(item), covered)) + begin
    return np.unique(np.maximum(good + size - 1 - len(item), 0) // HOP)  # the words around these hops hold the whole stretch


def followed(ids: list[np.ndarray], shorts: dict[int, dict[bytes, list[int]]]) -> list[tuple[int, int, int]]:
    """(text, item, first place) of items, by length and words, all of whose words follow each other in a text."""
    out = {}
    for size, items in shorts.items():
        begins = np.unique([np.frombuffer(b, np.int32)[0] for b in items])
        for d, x in enumerate(ids):
            x = np.ascontiguousarray(x, np.int32)
            for p in np.flatnonzero(np.isin(x[: max(len(x) - size + 1, 0)], begins)):
                for k in items.get(x[p:p + size].tobytes(), ()):
                    out.setdefault((d, k), int(p))
    return [(d, k, p) for (d, k), p in out.items()]


SCHEMA = "doc_id long, row_hash long, item_id long, score double, answer_score double, place long"


def find_leaks(docs: DataFrame, items: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, row_hash, item_id, score, answer_score, place) of every item found in a text; row_hash is that of the text."""
    bounded_batches(docs.sparkSession)
    found = [_find_block(docs, block, **limits) for block in blocks(items)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], SCHEMA)


def _find_block(docs: DataFrame, items: DataFrame, *, cosine: float = 0.52, covered: float = 0.7, answered: float = 0.5, shortest: int = 5, often: float = 0.05) -> DataFrame:
    bench = read_benchmark(items)
    spark = docs.sparkSession
    if not len(bench.vocabulary):  # items without words match nothing
        return spark.createDataFrame([], SCHEMA)
    held = spark.sparkContext.broadcast(bench)
    # ids pass as text: pandas would make floats of ids with nulls among them
    base = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            column, out = batch["text"].tolist(), []
            for s in textvec.slices(column):
                words = textvec.read(column[s])
                ids = word_ids(words, held.value.vocabulary)
                out += [x.tobytes() for x in np.split(ids, np.cumsum(words.counts)[:-1])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "row_hash": batch["row_hash"], "ids": out})

    ids = durable(base.mapInPandas(tokenise, "doc_id string, row_hash long, ids binary"), "word-ids")
    n = len(bench.vocabulary)

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, passages = np.zeros(n), 0
        for batch in batches:
            for begin in range(0, len(batch), 500):
                _, w, _, count = _passage_matrix(unpacked(batch["ids"][begin:begin + 500]), np.ones(n))
                total += np.bincount(w, minlength=n)
                passages += count
        yield pd.DataFrame({"word": np.append(np.arange(n), n), "n": np.append(total, passages)})

    df = np.zeros(n + 1)
    for r in ids.mapInPandas(frequencies, "word long, n double").groupBy("word").agg(F.sum("n").alias("n")).collect():  # one row a word of the benchmark
        df[r["word"]] = r["n"]
    idf = np.log((df[n] + 1) / (df[:n] + 1)) + 0.1
    frequent = df[:n] > often * df[n]
    for x in bench.words:  # an item of frequent words alone keeps them
        if len(x) and (~frequent[x]).sum() < shortest:
            frequent[x] = False
    idf[frequent] = 0
    basis = latent_basis(ids, idf)
    table = np.zeros((n + 1, basis.shape[1]), np.float32)
    table[:n] = basis * idf[:, None]

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    # an item is found by its whole or by any of its windows, at any shift against the text's
    probes, owners = [], []
    for k, x in enumerate(bench.words):
        if len(x) >= shortest:
            for begin in range(0, max(len(x) - 2 * HOP, 0) + HOP, HOP // 2):
                part = x[begin:begin + 2 * HOP]
                if len(part) >= min(len(x), HOP):
                    probes.append(table[part].sum(0))
                    owners.append(k)
    probes = unit(np.stack(probes)) if probes else np.zeros((0, basis.shape[1]), np.float32)
    owners = np.array(owners, int)
    shorts: dict[int, dict[bytes, list[int]]] = {}
    for k, x in enumerate(bench.words):
        if 0 < len(x) < shortest:
            shorts.setdefault(len(x), {}).setdefault(x.tobytes(), []).append(k)
    model = spark.sparkContext.broadcast((table, np.append(idf > 0, False), probes.astype(np.float32), owners, rarest_words(bench.words, df[:n], covered, shortest), shorts))

    def retrieve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, live, probes, owners, rarest, shorts = model.value
        b = held.value
        times = [Counter(x.tolist()) for x in b.words]
        for batch in batches:
            found = []
            for begin in range(0, len(batch), SLICE):
                part = unpacked(batch["ids"][begin:begin + SLICE])
                doc, hop, sums = windows(part, table, live)
                seen = set()
                step = max(64, MOST_COSINES // max(len(probes), 1))
                for lo in range(0, len(doc), step):
                    near = unit(sums[lo:lo + step]) @ probes.T if len(probes) else np.zeros((0, 0))
                    passed = np.flatnonzero(near.max(axis=1, initial=-1) >= cosine)  # few passages are near anything
                    at, probe = np.nonzero(near[passed] >= cosine)
                    at = passed[at]
                    pair = doc[at + lo] * len(b.item) + owners[probe]
                    order = np.argsort(pair, kind="stable")
                    bounds = np.flatnonzero(np.diff(pair[order], prepend=-1))
                    for key, places in zip(pair[order[bounds]].tolist(), np.split(hop[at[order] + lo], bounds)[1:], strict=True):
                        d, k = divmod(key, len(b.item))
                        hops = sorted(set(places.tolist()))
                        hit = _best(part[d], b.words[k], times[k], b.answer[k], hops, covered, answered)
                        if hit and hit[0] >= covered and hit[1] >= answered:
                            found.append((begin + d, k, *hit))
                            seen.add((d, k))
                for r in rarest:
                    for d, k, at in holding_chunks(part, r).tolist():
                        if (d, k) in seen:
                            continue
                        hops = likely_hops(part[d], b.words[k], at, at + 2 * r.block, covered)
                        hit = _best(part[d], b.words[k], times[k], b.answer[k], hops, covered, answered) if len(hops) else None
                        if hit and hit[0] >= covered and hit[1] >= answered:
                            found.append((begin + d, k, *hit))
                found += [(begin + d, k, 1.0, 1.0, place) for d, k, place in followed(part, shorts)]
            if found:
                rows = pd.DataFrame(found, columns=["row", "item", "score", "answer_score", "place"]).sort_values("score").drop_duplicates(["row", "item"], keep="last")
                item_id = pd.array([b.item[k] for k in rows["item"]], "Int64")
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[rows["row"]].array, "row_hash": batch["row_hash"].iloc[rows["row"]].array, "item_id": item_id, **{c: rows[c].array for c in ("score", "answer_score", "place")}})

    return ids.mapInPandas(retrieve, SCHEMA.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def _best(text: np.ndarray, item: np.ndarray, times: Counter, answer: int, hops: np.ndarray, covered: float, answered: float) -> tuple[float, float, int] | None:
    """The stretch around the passages that covers most of an item: (share covered, share of its answer there, place); ``times``: of each of its words."""
    best = None
    a, tail = item.tolist(), item[answer:].tolist()
    least, size = fewest(len(a), covered), reach(len(a))
    step = min(4, size - len(a) + 1)  # stretches as far apart hold any verbatim item

    def consider(common: int, stretch: list[int], place: int) -> None:
        nonlocal best
        # one that holds most of the answer too goes before one that only covers more of the item
        now = (common / len(a), lcs(tail, stretch) / max(len(tail), 1), place)
        if best is None or (now[1] >= answered, now[0]) > (best[1] >= answered, best[0]):
            best = now

    done = -1
    for h in hops:
        begin, end = max(0, int(h) * HOP - len(a)), int(h) * HOP + 2 * HOP + len(a)
        if begin < done and best and best[0] >= 0.999 and best[1] >= answered:
            continue
        s = text[begin:end].tolist()
        if sum(times[x] for x in times.keys() & set(s)) < least:  # the subsequence cannot be longer than the common words
            continue
        done = end
        whole = lcs(a, s)
        if whole < least:
            continue
        if len(s) <= size:
            consider(whole, s, begin)
            continue
        # a subsequence scattered over a stretch much longer than the item is no copy: try stretches of its own length
        starts = list(range(0, len(s) - size + step, step))
        common = [lcs(a, s[k:k + size]) for k in starts]
        top = max(common)
        if top >= least:
            for k, c in zip(starts, common, strict=True):
                if c >= least and (c == top or best is None or best[1] < answered):
                    consider(c, s[k:k + size], begin + k)
        # one of those between may still hold enough, or the answer too
        if top + step - 1 >= least and (best is None or best[1] < answered):
            for k in range(len(s) - size + 1):
                if k % step and (c := lcs(a, s[k:k + size])) >= least:
                    consider(c, s[k:k + size], begin + k)
    return best


def op1_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a (document, benchmark item) found."""
    return find_leaks(docs.select("doc_id", "text"), items).select("doc_id", "item_id", "score", "answer_score", "place")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all columns, in which no benchmark item was found."""
    leaks = durable(find_leaks(docs.select("doc_id", "text"), items).select("doc_id", "row_hash").distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("text_hash"))
    same = rows["row_id"].eqNullSafe(leaks["doc_id"]) & (rows["text_hash"] == leaks["row_hash"])
    return rows.join(leaks, same, "left_anti").select("row.*")
