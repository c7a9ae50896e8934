"""Hard-negative mining over rotated one-bit codes, with exact integer scores.

1.  Each vector of integers is turned by a fixed random rotation and kept as the signs of its components, one bit each,
    beside its norm and its alignment: the cosine t between the vector and its code.  What the code leaves of it is
    coded in the same way, layer after layer.
2.  For an anchor, its rotated vector is cut into bit planes, so that popcounts give its product with every code.
    What a code leaves of a vector is at right angles to it, and by Cauchy-Schwarz adds at most sqrt(1 - t^2) times
    the vector's norm and what the code leaves of the anchor; so does the rounding of the planes.  The interval is
    certain, not likely.
3.  After each layer, rows whose interval cannot reach the answer are left out; all that survive are scored in integers.

Rows are dealt into shards of bounded size by their ids, anchors into blocks; every shard meets every block, first
for positives, then for negatives, and returns a few rows for each anchor, which windows rank.  Anchors are a stated
share of the rows, so all work grows with the square of the table.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; a component
counts as floor(256 * x), held to 2**24 either way so that products stay exact; vectors of different lengths are never
compared; rows of the anchor's own vec_id are neither positives nor negatives of it; repeated rows are separate
candidates, and an anchor that stands twice with the same label and vector is one anchor; an empty table gives an empty
result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable

LIMIT = 1 << 24
LAYERS, PLANES = 4, 8
#: Components in a shard, and anchors in a block.
SHARD_VALUES, BLOCK_ANCHORS, LEAST_BLOCK = 1 << 21, 4096, 64
#: Of the product of two norms: more than rounding can add.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 41) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """[rows x words] of 64 bits each, the last filled with zeros."""
    n, dim = bits.shape
    out = np.zeros((n, -(-dim // 64) * 8), np.uint8)
    out[:, : -(-dim // 8)] = np.packbits(bits, axis=1)
    return out.view(np.uint64)


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a matrix of integers: codes [rows x layers x words], norms before each layer and after the last, and alignments."""
    rest = values.astype(float) @ rotation(values.shape[1])
    root = np.sqrt(max(values.shape[1], 1))
    codes, norms, along = [], [np.sqrt((rest * rest).sum(1))], []
    for _ in range(LAYERS):
        sums = np.abs(rest).sum(1)
        codes.append(packed(rest > 0))
        along.append(np.divide(sums / root, norms[-1], out=np.zeros(len(rest)), where=norms[-1] > 0))
        rest = rest - np.where(rest > 0, 1.0, -1.0) * (sums / root**2)[:, None]
        norms.append(np.sqrt((rest * rest).sum(1)))
    return np.stack(codes, 1), np.stack(norms, 1), np.stack(along, 1)


class Codes:
    """The rows of one shard that one block of anchors meets."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.dim = int(rows["dim"].iat[0])
        n = len(rows)
        self.ids, self.labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        self.values = np.frombuffer(b"".join(rows["ints"]), "<i4").reshape(n, self.dim)
        self.codes = np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(n, LAYERS, -(-self.dim // 64)).swapaxes(0, 1).copy()
        self.ones = np.bitwise_count(self.codes).sum(2)
        self.norms = np.frombuffer(b"".join(rows["norms"]), "<f8").reshape(n, LAYERS + 1).T.copy()
        self.along = np.frombuffer(b"".join(rows["along"]), "<f8").reshape(n, LAYERS).T.copy()
        # products of floats are exact as long as all sums fit 53 bits
        self.large = float(np.abs(self.values).max(initial=0)) * self.dim
        self.floats = self.values.astype(float)

    def narrowed(self, query: np.ndarray, rows: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Of ``rows``, those that ``keep`` lets pass, layer after layer, given certain bounds of their products with ``query``."""
        turned = query.astype(float) @ rotation(self.dim)
        norm = float(np.sqrt(turned @ turned))
        low, high = (float(turned.min()), float(turned.max())) if self.dim else (0.0, 0.0)
        step = (high - low) / ((1 << PLANES) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.uint8)
        planes = [packed((levels >> plane & 1).astype(bool)[None, :])[0] for plane in range(PLANES)]
        rounded = low + step * levels
        total, rounding, root = float(rounded.sum()), float(np.sqrt(((turned - rounded) ** 2).sum())), np.sqrt(max(self.dim, 1))
        middle, half = np.zeros(len(rows)), SLACK * self.norms[0][rows] * norm
        for layer in range(LAYERS):
            if not len(rows):
                break
            codes, inside = self.codes[layer][rows], np.zeros(len(rows))
            for plane, word in enumerate(planes):
                inside += np.bitwise_count(codes & word).sum(1).astype(float) * (1 << plane)
            product = (2 * (low * self.ones[layer][rows] + step * inside) - total) / root
            weight = self.norms[layer][rows] * self.along[layer][rows]
            middle, half = middle + weight * product, half + weight * rounding
            left = self.norms[layer + 1][rows] * np.sqrt(np.maximum(norm * norm - np.maximum(np.abs(product) - rounding, 0) ** 2, 0))
            alive = keep(middle - half - left, middle + half + left)
            rows, middle, half = rows[alive], middle[alive], half[alive]
        return rows

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact integer products."""
        if self.large * float(np.abs(query).max(initial=0)) < 1 << 53:
            return (self.floats[rows] @ query.astype(float)).astype(np.int64)
        return self.values[rows].astype(np.int64) @ query.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
        """(vec_id, score) of the first rows by score, ties by smaller id."""
        if len(rows) > most:  # all that tie with the last stay
            top = scores >= np.partition(scores, -most)[-most]
            rows, scores = rows[top], scores[top]
        for k in np.lexsort((self.ids[rows], -scores))[:most]:
            yield int(self.ids[rows[k]]), int(scores[k])

    def positives(self, anchor_id: int, label: int, query: np.ndarray, most: int) -> list[tuple[int, int]]:
        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= np.partition(low, -most)[-most] if len(low) > most else np.ones(len(low), bool)

        rows = self.narrowed(query, np.flatnonzero((self.labels == label) & (self.ids != anchor_id)), keep)
        return list(self.best(rows, self.scores(rows, query), most))

    def negatives(self, anchor_id: int, label: int, query: np.ndarray, wanted: list[int], most: int) -> list[list[tuple[int, int]]]:
        """For each positive's score, the first rows of other labels within 80 to 100 hundredths of it."""
        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            alive = np.zeros(len(low), bool)
            for score in wanted:
                reach = (100 * high >= 80 * score) & (low <= score)
                sure = low[(100 * low >= 80 * score) & (high <= score)]
                alive |= reach & (high >= np.partition(sure, -most)[-most]) if len(sure) >= most else reach
            return alive

        rows = self.narrowed(query, np.flatnonzero((self.labels != label) & (self.ids != anchor_id)), keep)
        scores = self.scores(rows, query)
        fitting = [(80 * score <= 100 * scores) & (scores <= score) for score in wanted]
        return [list(self.best(rows[fits], scores[fits], most)) for fits in fitting]


def index(embeddings: DataFrame) -> DataFrame:
    """Written down: dim, vec_id, label, ints, code, norms, along of every row that takes part."""
    vec, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    ints = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * 256), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    taken = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding").cast("array<double>")))
    rows = taken.select(vec.alias("vec_id"), F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), ints.alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["values"].map(len)):
                values = np.array(part["values"].tolist(), np.int64).reshape(len(part), dim)
                codes, norms, along = encoded(values)
                yield pd.DataFrame({"dim": dim, "vec_id": part["vec_id"], "label": part["label"], "ints": [v.tobytes() for v in values.astype("<i4")], "code": [c.tobytes() for c in codes], "norms": [x.astype("<f8").tobytes() for x in norms], "along": [x.astype("<f8").tobytes() for x in along]})

    return durable(rows.mapInPandas(run, "dim int, vec_id long, label long, ints binary, code binary, norms binary, along binary"), "codes")


KEY = ("dim", "shard", "block")


def _cells(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell of a shard and a block that they meet in."""
    values, asked = rows.agg(F.coalesce(F.sum(F.col("dim") + 1), F.lit(0))).first()[0], anchors.count()
    shards = max(1, -(-values // SHARD_VALUES))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // BLOCK_ANCHORS), min(-(-asked // LEAST_BLOCK), -(-cores // shards)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda of, n: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    return (rows.select("*", own(["vec_id", "ints"], shards).alias("shard"), each(blocks).alias("block")),
            anchors.select("*", own([F.lit(1), "anchor"], blocks).alias("block"), each(shards).alias("shard")))


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = index(embeddings)
    anchors = durable(
        rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["dim", "vec_id", "label", "ints"]).select("dim", F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("ints").alias("query")), "anchors")

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left):
            codes = Codes(left)
            for a in right.itertuples():
                found += [(a.anchor, v, s) for v, s in codes.positives(a.anchor_id, a.anchor_label, np.frombuffer(a.query, "<i4"), positives)]
        return pd.DataFrame(found, columns=["anchor", "positive_id", "positive_score"])

    def between(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left):
            codes = Codes(left)
            for a in right.itertuples():
                wanted = [int(s) for s in a.wanted]
                for place, best in enumerate(codes.negatives(a.anchor_id, a.anchor_label, np.frombuffer(a.query, "<i4"), wanted, negatives)):
                    found += [(a.anchor, place, v, s) for v, s in best]
        return pd.DataFrame(found, columns=["anchor", "place", "negative_id", "negative_score"])

    left, right = _cells(rows, anchors)
    met = left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInPandas(near, "anchor long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    chosen = met.withColumn("place", F.row_number().over(best) - 1).filter(F.col("place") < positives)
    # at most ``positives`` rows an anchor
    chosen = durable(chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("chosen")), "positives")
    asking = anchors.join(chosen.select("anchor", F.col("chosen.positive_score").alias("wanted")), "anchor")
    left, right = _cells(rows, asking)
    met = left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInPandas(between, "anchor long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    named = anchors.select("anchor", "anchor_id").join(chosen.select("anchor", F.explode("chosen").alias("p")), "anchor").select("anchor", "anchor_id", F.col("p.place").alias("place"), F.col("p.positive_id").alias("positive_id"), F.col("p.positive_score").alias("positive_score"))
    return ranked.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's query over all embeddings: anchors are the rows whose vec_id is divisible by 100."""
    return hard_negatives(embeddings.select("vec_id", "label", "embedding"))


#: The same in DuckDB.
ORACLE_SQL = f"""
with taken as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: greatest(least(floor(256 * x::double), {LIMIT}), -{LIMIT})::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = len(embedding)
), anchors as (select distinct * from taken where vec_id % 100 = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, a.v as anchor_v, b.vec_id, b.label,
         coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::bigint as score
  from anchors a join taken b on len(a.v) = len(b.v) and a.vec_id <> b.vec_id
), positives as (
  select *, row_number() over (partition by anchor_id, anchor_label, anchor_v order by score desc, vec_id) as place
  from scored where label = anchor_label qualify place <= 5
), ranked as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.anchor_label, p.anchor_v, p.place order by s.score desc, s.vec_id) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and s.anchor_label = p.anchor_label and s.anchor_v = p.anchor_v
  where s.label <> s.anchor_label and 80 * p.score <= 100 * s.score and s.score <= p.score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
