"""Approximate nearest neighbours by collision-counting hashing, query-centred.

Each of m random projections of the unit vectors is sorted and cut into runs; for each run the vectors before it are
kept as one set of bits.  A query opens a window around its own projection in every array, which is the difference of
two such sets; a vector collides as often as it lies in windows, and collisions are summed for 64 vectors in one word.
The radius grows step by step (virtual rehashing: the same sets, wider windows), and vectors whose collisions pass the
threshold are verified by their cosine, until k verified ones lie within the radius; the last ones are ordered by
their exact cosine.

Spark deals vectors into shards of bounded size, by vec_id, so that a vector that a third of all rows share is
spread evenly.  A task sorts a shard's projections into its index once and then searches it for a stream of
queries, batch after batch, holding no more of them than one batch; it returns k rows a query.  Queries are cut
into blocks only where a shard's would take one task too long (``BLOCK_ROWS``), or where there are fewer shards
than cores; an index is built once for each block, and is cheap beside that many searches.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, as
query or as candidate; vectors of huge or tiny components count like others; vectors of different lengths are never compared; a query's own row, and any row of the
same vec_id, is no candidate; ties go to the smaller vec_id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 128
GROWTH = 1.12
HALF_WIDTH = 0.75  # of a window, in radii
SHARD_ROWS = 32768
BLOCK_ROWS = 16384
LEAST_BLOCK_ROWS = 256
RUNS = 64  # of a sorted projection
AT_ONCE = 32  # queries whose windows are counted together
#: Share of arrays; the chance to collide is 0.547 at the radius and 0.486 at the next one.
THRESHOLD = 0.5


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: its cosines stay exactly the same, and no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def sliced_sum(sets: Iterator[np.ndarray]) -> list[np.ndarray]:
    """How many of the bit sets hold each bit, as binary digits, the lowest first, each a bit set itself."""
    digits: list[list[np.ndarray]] = [[]]

    def add(level: int, bits: np.ndarray) -> None:
        if level == len(digits):
            digits.append([])
        digits[level].append(bits)
        if len(digits[level]) == 3:
            x, y, z = digits[level]
            odd = x ^ y
            digits[level] = [odd ^ z]
            add(level + 1, x & y | odd & z)

    for bits in sets:
        add(0, bits)
    for level, held in enumerate(digits):  # grows while carries go up
        if len(held) == 2:
            digits[level] = [held[0] ^ held[1]]
            add(level + 1, held[0] & held[1])
    return [held[0] for held in digits]


def at_least(digits: list[np.ndarray], least: int) -> np.ndarray:
    """The bit set of those whose sum is ``least`` or more."""
    over, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for level in reversed(range(max(len(digits), least.bit_length()))):
        bit = digits[level] if level < len(digits) else np.zeros_like(over)
        if least >> level & 1:
            same &= bit
        else:
            over |= same & bit
            same &= ~bit
    return over | same


class Index:
    """The sorted projections of one shard, each cut into runs of equal length, with the set of vectors before each run."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 29) -> None:
        self.ids, self.vectors = ids, scaled(vectors)
        n, dim = vectors.shape
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.axes = np.random.default_rng(seed + dim).normal(size=(dim, PROJECTIONS))
        units = self.vectors / self.norms[:, None]
        self.units = units.astype(np.float32)
        projected = np.ascontiguousarray((units @ self.axes).T)
        runs = min(RUNS, n)
        run_of = (np.arange(n) * runs // n).astype(np.uint8)
        begins = -(-np.arange(runs) * n // runs)
        self.first = np.empty((PROJECTIONS, runs))
        self.before = np.zeros((PROJECTIONS, runs + 1, -(-n // 64) * 8), np.uint8)
        run = np.empty(n, np.uint8)
        for j, row in enumerate(projected):
            order = np.argsort(row)
            run[order], self.first[j] = run_of, row[order[begins]]
            self.before[j, :, :-(-n // 8)] = np.packbits(run < np.arange(runs + 1, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        self.before = self.before.view(np.uint64)

    def collided(self, places: np.ndarray, half: np.ndarray, least: int) -> np.ndarray:
        """For each query, the bit set of the vectors that lie in at least so many of its windows, these being widened to whole runs."""
        low = np.maximum((self.first < (places - half[:, None])[:, :, None]).sum(2) - 1, 0)
        high = (self.first <= (places + half[:, None])[:, :, None]).sum(2)
        return at_least(sliced_sum(self.before[j, high[:, j]] ^ self.before[j, low[:, j]] for j in range(PROJECTIONS)), least)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The k nearest found for each query, as (query, vector, cosine)."""
        return [row for at in range(0, len(queries), AT_ONCE) for row in self._search(query_ids[at:at + AT_ONCE], scaled(queries[at:at + AT_ONCE]), k)]

    def _search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        n, dim = self.vectors.shape
        query_norms = np.sqrt((queries * queries).sum(1))
        units = queries / query_norms[:, None]
        places, asked = units @ self.axes, units.astype(np.float32)
        slack = (dim + 4) * 2.0**-22  # more than scores in single precision, and their order, can be wrong by
        probe = np.linspace(0, n - 1, min(n, 256)).astype(int)
        near = np.sqrt(np.maximum(2 - 2 * (self.units[probe] @ asked.T).astype(float), 0))
        radius = np.maximum(0.8 * near.min(0), 0.05)
        others = n - (self.ids == query_ids[:, None]).sum(1)
        found = [np.empty(0, int) for _ in queries]
        scores = [np.empty(0, np.float32) for _ in queries]
        checked = np.zeros((len(queries), self.before.shape[2]), np.uint64)
        going = np.flatnonzero(others > 0)
        while len(going):
            collided = self.collided(places[going], HALF_WIDTH * radius[going], int(np.ceil(THRESHOLD * PROJECTIONS)))
            fresh = collided & ~checked[going]
            checked[going] |= collided
            over = []
            for row, bits in zip(going, fresh, strict=True):
                new = np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little"))
                new = new[self.ids[new] != query_ids[row]]
                if len(new):
                    found[row] = np.concatenate([found[row], new])
                    scores[row] = np.concatenate([scores[row], self.units[new] @ asked[row]])
                within = int((2 - 2 * (scores[row] + slack) <= radius[row] ** 2).sum())
                over.append(within >= k or len(found[row]) >= others[row] or radius[row] > 2.2)
            going = going[~np.array(over)]
            radius[going] *= GROWTH
        out = []
        for row, (qid, q) in enumerate(zip(query_ids, queries, strict=True)):
            new = found[row]
            if len(new) > k:  # all that may tie with the k-th stay
                new = new[scores[row] >= np.partition(scores[row], -k)[-k] - 2 * slack]
            exact = (self.vectors[new] * q).sum(1) / (self.norms[new] * query_norms[row])
            best = np.lexsort((self.ids[new], -exact))[:k]
            out += [(int(qid), int(self.ids[new[b]]), float(exact[b])) for b in best]
        return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score).  ``vectors``: vec_id, embedding; ``queries``: query_id, embedding."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    asks = queries.filter(F.col("query_id").isNotNull() & usable(F.col("embedding"))).select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    shards, asked = max(1, -(-rows.count() // SHARD_ROWS)), asks.count()
    # so many blocks that queries and cores suffice, but no block is small
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // BLOCK_ROWS), min(-(-asked // LEAST_BLOCK_ROWS), -(-cores // shards)))
    dim = F.size("embedding").alias("dim")
    left = rows.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "embedding")
    right = asks.select(dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted: of each (dim, shard, block) first the vectors, then the queries, in as many batches as they take."""
        now, held, index = None, [], None
        for batch in batches:
            found = []
            for (key, asking), part in batch.assign(key=list(zip(batch["dim"], batch["shard"], batch["block"], strict=True))).groupby(["key", "asks"], sort=False):
                if key != now:
                    now, held, index = key, [], None
                if not asking:
                    held.append((part["id"].to_numpy(), np.stack(part["embedding"])))
                elif held or index:
                    if index is None:
                        index, held = Index(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])), []
                    found += index.search(part["id"].to_numpy(), np.stack(part["embedding"]), k)
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    spread = left.union(right).repartition(shards * blocks, *key).sortWithinPartitions(*key, "asks")
    found = spread.mapInPandas(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Neighbours of the rows whose vec_id is divisible by ``every``, among all rows."""
    asks = embeddings.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return search(embeddings.select("vec_id", "embedding"), asks, k)
