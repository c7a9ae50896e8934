"""N-gram Jaccard join by a MinHash LSH forest, followed by exact verification.

1.  Equal texts form a class, by 128 bits of two hashes; everything after works on classes.
2.  Each tree of the forest orders minima of its own of hashes of a class's shingles (five words); the classes
    sorted by these signatures are the tree's prefix trie, and a key names a path of it from the root.
3.  A class shortens its path from the deepest level on until pairs of the least similarity that it can link
    with, given both sizes, are met with the target recall: 1 - (1 - s^d)^t over t trees.  Two sets of three
    shingles link at 1 only, so they keep 16 levels; large sets come down to 9 for 0.8, where 96 trees miss
    one pair of a million.
4.  Candidates are the pairs below a shared path, and no others.  A pair belongs to the first path that its
    two classes share, in the order of trees; of each path only those classes that have a pair of their own
    there, of fitting sizes, are verified at all.
5.  Paths of many classes are cut into chunks of bounded rows and bytes; each pair of chunks is one piece of
    work, so that one path spreads over many tasks.  There shingle sets are intersected exactly, as products
    of 0/1 matrices; a piece returns counts and a spanning forest, never its pairs.
6.  Components of the verified links are the final classes.

Rows out: one per document.  Defined results: texts of fewer than five words have one shingle of all their
words; texts without words (null or empty) equal each other but link to nothing; repeated rows are separate
rows of one class; a null id sorts last when a class chooses its least id; an empty table gives an empty
result; extra columns pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textvec
from ledgerloom.llm.common import bounded_batches, discard, durable
from ledgerloom.llm.graph import components

SHINGLE = 5
TREES = 96
DEEPEST = 16
#: Sets of more shingles than this are taken for large: their least similarity is the threshold.
SMALL = 24
PIECE_ROWS, PIECE_BYTES = 2048, 16 << 20
SALTS = 16


def depth_for(similarity: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix, shortened level by level from ``deepest``, that reaches ``recall`` at ``similarity``."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - similarity**depth) ** trees >= recall:
            return depth
    return 1


def least_similarity(n: int, m: int, threshold: float) -> float | None:
    """The least similarity of a linked pair of sets of ``n`` and ``m`` shingles; None if no such pair can link."""
    common = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
    return common / (n + m - common) if common <= min(n, m) else None


@lru_cache(maxsize=None)
def depths(n: int, threshold: float, recall: float) -> tuple[int, ...]:
    """The levels at which a set of ``n`` shingles meets all sets that it can link with."""
    base = depth_for(threshold, recall)
    if n > SMALL:
        return (base,)
    out = set()
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        least = least_similarity(n, m, threshold)
        if least is not None:
            out.add(base if m > SMALL else depth_for(least, recall))
    return tuple(sorted(out))


def _trees(seed: int) -> np.ndarray:
    """[trees x levels] odd multipliers, one for each minimum: of shingles' hashes, themselves well mixed, each gives another order."""
    return np.random.default_rng(seed).integers(0, 1 << 31, (TREES, DEEPEST), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _paths(h: np.ndarray, bounds: np.ndarray, levels: tuple[int, ...], seed: int) -> np.ndarray:
    """[texts x (trees * levels)] keys: 7 bits of the tree, 4 of the level, 52 of a hash of the minima down to it."""
    h = (h >> np.uint64(32)).astype(np.uint32)
    out, product = [], np.empty_like(h)
    for tree, multipliers in enumerate(_trees(seed)):
        path = np.full(len(bounds), tree + 1, np.uint64)
        for level in range(1, max(levels) + 1):
            np.multiply(h, multipliers[level - 1], out=product)
            path = textvec.mixed(path * textvec.BASE + np.minimum.reduceat(product, bounds))
            if level in levels:
                out.append(np.uint64(tree << 56 | (level - 1) << 52) | path >> np.uint64(12))
    return np.stack(out, axis=1).view(np.int64)


def path_keys(texts: list[str | None], threshold: float, recall: float, seed: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of shingles, keys) of every text; texts without words have neither."""
    doc, h = textvec.shingle_sets(textvec.read(texts), SHINGLE)
    sizes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    keys: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    by_levels: dict[tuple[int, ...], list[int]] = {}
    for k in np.flatnonzero(sizes):
        by_levels.setdefault(depths(min(int(sizes[k]), SMALL + 1), threshold, recall), []).append(k)
    for levels, members in by_levels.items():
        mine = np.zeros(len(texts), bool)
        mine[members] = True
        for k, row in zip(members, _paths(h[mine[doc]], np.cumsum(sizes[members]) - sizes[members], levels, seed), strict=True):
            keys[k] = row
    return sizes, keys


def _class_hashes(text: Column) -> list[Column]:
    """A class's 128 bits; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.md5(whole.cast("binary")), whole).alias("a"), F.xxhash64(F.lit(71), whole).alias("b")]


def own_pairs(key: int, left: list[np.ndarray], right: list[np.ndarray], size_left: np.ndarray, size_right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of members of the path ``key`` share no earlier path, and have sizes that can link."""
    a, b = size_left[:, None], size_right[None, :]
    out = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
    if out.size <= 64:
        sets = [[set(x[: np.searchsorted(x, key)].tolist()) for x in side] for side in (left, right)]
        for i, x in enumerate(sets[0]):
            for j, y in enumerate(sets[1]):
                out[i, j] = out[i, j] and x.isdisjoint(y)
        return out
    cut = [[x[: np.searchsorted(x, key)] for x in side] for side in (left, right)]
    flat = [np.concatenate(side) for side in cut]
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in cut]
    for slot in np.intersect1d(flat[0] >> 52, flat[1] >> 52):  # of a tree and level a set has one key
        columns = []
        for f, r, side, none in zip(flat, rows, cut, (-1, -2), strict=True):
            column = np.full(len(side), none, np.int64)
            here = f >> 52 == slot
            column[r[here]] = f[here]
            columns.append(column)
        out &= columns[0][:, None] != columns[1][None, :]
        if not out.any():
            break
    return out


def _intersections(sets: list[np.ndarray], other: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of two lists of sorted sets, where asked: one by one if few are, else as products of 0/1 matrices over slices of the common shingles."""
    out = np.zeros(asked.shape, np.float32)
    if asked.sum() <= 4 * sum(asked.shape):
        for i, j in np.argwhere(asked):
            out[i, j] = len(np.intersect1d(sets[i], other[j], assume_unique=True))
        return out
    left, right = np.concatenate(sets), np.concatenate(other)
    common = np.intersect1d(left, right)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets, other)]
    places = [np.searchsorted(common, x) for x in (left, right)]
    good = [(p < len(common)) & (common[np.minimum(p, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for p, x in zip(places, (left, right), strict=True)]
    for begin in range(0, len(common), 2048):
        end = min(begin + 2048, len(common))
        parts = []
        for r, p, g, n in zip(rows, places, good, asked.shape, strict=True):
            inside = g & (p >= begin) & (p < end)
            m = np.zeros((n, end - begin), np.float32)
            m[r[inside], p[inside] - begin] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _sides(key: int, chunks: np.ndarray, shared: list[np.ndarray], sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece's two chunks, or its one chunk twice, as places of members; and which of their pairs are its own."""
    a, b = np.flatnonzero(chunks == chunks.min()), np.flatnonzero(chunks == chunks.max())
    own = own_pairs(key, [shared[k] for k in a], [shared[k] for k in b], sizes[a], sizes[b], threshold)
    if chunks.min() == chunks.max():
        np.fill_diagonal(own, False)
    return a, b, own


def verify_piece(key: int, nodes: np.ndarray, chunks: np.ndarray, shared: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a piece: pairs within its one chunk, or across its two.  (links of each node, root of its tree)."""
    n = len(nodes)
    links, parent = np.zeros(n, np.int64), np.arange(n)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    size = np.array([len(s) for s in sets], np.int64)
    a, b, own = _sides(key, chunks, shared, size, threshold)
    both = _intersections([sets[k] for k in a], [sets[k] for k in b], own)
    # |A and B| >= t |A or B|, compared without dividing
    good = own & (both * (1 + threshold) >= threshold * (size[a][:, None] + size[b][None, :]) - 1e-6)
    if chunks.min() == chunks.max():
        links[a] = good.sum(1)
    else:
        links[a], links[b] = good.sum(1), good.sum(0)
    for k, row in enumerate(good):
        for j in np.flatnonzero(row):
            x, y = root(a[k]), root(b[j])
            if x != y:
                if nodes[x] > nodes[y]:
                    x, y = y, x
                parent[y] = x
    return links, nodes[[root(k) for k in range(n)]]


def _by_piece(batches: Iterator[pd.DataFrame], read, done, most: int = 5000) -> Iterator[pd.DataFrame]:
    """Gather rows that are sorted by piece, one row a node, and give what ``done`` makes of each whole piece."""
    held, now, ready, n_ready = {}, None, [], 0
    for batch in batches:
        for piece, node, rest in read(batch):
            if piece != now:
                if held:
                    out = done(now, held)
                    ready.append(out)
                    n_ready += len(out)
                held, now = {}, piece
                if n_ready > most:
                    yield pd.concat(ready)
                    ready, n_ready = [], 0
            held[node] = rest
    if held:
        ready.append(done(now, held))
    if ready:
        yield pd.concat(ready)


def candidates(shared: DataFrame, threshold: float) -> DataFrame:
    """(key, piece, node, chunk, shared) of the classes that have a pair of their own in a piece; ``shared``: node, size, shared keys in order."""
    entries = shared.select("node", "size", "shared", F.col("shared")[0].alias("first"), F.explode("shared").alias("key"))
    groups = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.min("first").alias("low"), F.max("first").alias("high"))
    # where all members share the same earlier path, every pair belongs to that one
    groups = groups.filter(~((F.col("low") == F.col("high")) & (F.col("low") < F.col("key")))).select(
        "key", F.greatest(F.ceil(F.col("n") / PIECE_ROWS), F.ceil(F.col("mass") * 8 / PIECE_BYTES)).cast("int").alias("chunks"))
    columns = ["piece", "key", "node", "chunk", "alone", "size", "shared"]
    # a path may hold a third of all classes: deal them out over salts
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = (
        entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("piece", F.xxhash64("key", F.least("chunk", "with"), F.greatest("chunk", "with")))
        .withColumn("alone", F.col("with") == F.col("chunk"))
        .select(*columns)
    )

    def read(batch: pd.DataFrame) -> Iterator[tuple]:
        for piece, key, node, chunk, alone, size, keys in zip(*(batch[c] for c in columns), strict=True):
            yield (piece, key, bool(alone)), node, (chunk, size, np.asarray(keys))

    def done(now: tuple, held: dict) -> pd.DataFrame:
        piece, key, alone = now
        nodes, rows = np.fromiter(held, np.int64), list(held.values())
        chunks, sizes, shared = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows]
        stay = np.zeros(len(nodes), bool)
        if alone or chunks.min() != chunks.max():
            a, b, own = _sides(key, chunks, shared, sizes, threshold)
            stay[a[own.any(1)]] = stay[b[own.any(0)]] = True
        kept = np.flatnonzero(stay)
        return pd.DataFrame({"piece": np.full(len(kept), piece, np.int64), "key": np.full(len(kept), key, np.int64), "node": nodes[kept], "chunk": chunks[kept].astype(np.int32), "shared": [shared[k] for k in kept]})

    schema = "piece long, key long, node long, chunk int, shared array<long>"
    return members.repartition("piece").sortWithinPartitions("piece").mapInPandas(lambda batches: _by_piece(batches, read, done), schema)


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """(doc_id, a, b, rep_id, class_id, copies, n_links, head) for every document.

    a, b: its class of equal texts; copies: rows of that class; n_links: different texts of Jaccard similarity
    ``threshold`` or more; class_id: the least doc_id of the component of links, head whether the class holds it.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_class_hashes(F.col("text")))
    named = base.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of ids with nulls among them

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            column = batch["text"].tolist()
            sizes, keys = [], []
            for s in textvec.slices(column):
                n, k = path_keys(column[s], threshold, recall)
                sizes.append(n)
                keys += k
            if sizes:
                yield pd.DataFrame({"doc_id": batch["doc_id"], "a": batch["a"], "b": batch["b"], "size": np.concatenate(sizes).astype(np.int64), "keys": keys})

    schema = "doc_id string, a long, b long, size long, keys array<long>"
    sketched = durable(named.mapInPandas(sketch, schema).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()), "sketch")
    by_class = sketched.groupBy("a", "b").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"), F.max("size").alias("size"), F.min("row").alias("row"))
    classes = durable(by_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    entries = sketched.select("row", "keys").join(classes.filter("size > 0").select("row", "node", "size"), "row").select("node", "size", F.explode("keys").alias("key"))
    several = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = durable(entries.join(several, "key").groupBy("node", "size").agg(F.array_sort(F.collect_list("key")).alias("shared")), "shared")
    open_ = durable(candidates(shared, threshold), "candidates")
    # the text of a class is that of any row of its least id
    texts = base.withColumnRenamed("doc_id", "rep_id")
    placed = open_.join(classes.select("node", F.col("a").alias("x"), F.col("b").alias("y"), F.col("rep_id").alias("z")), "node")
    same = (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")) & F.col("z").eqNullSafe(F.col("rep_id"))
    work = placed.join(texts, same).select("piece", "key", "node", "chunk", "shared", "text")

    def read(batch: pd.DataFrame) -> Iterator[tuple]:
        column = batch["text"].tolist()
        for s in textvec.slices(column):
            doc, h = textvec.shingle_sets(textvec.read(column[s]), SHINGLE)
            cuts = np.searchsorted(doc, np.arange(1, s.stop - s.start))
            for piece, key, node, chunk, keys, own in zip(*(batch[c][s] for c in ("piece", "key", "node", "chunk", "shared")), np.split(h, cuts), strict=True):
                yield (piece, key), node, (chunk, np.asarray(keys), own)

    def done(now: tuple, held: dict) -> pd.DataFrame:
        nodes, rows = np.fromiter(held, np.int64), list(held.values())
        links, roots = verify_piece(now[1], nodes, np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows], threshold)
        return pd.DataFrame({"node": nodes, "links": links, "root": roots})[links > 0]

    spread = work.repartition("piece").sortWithinPartitions("piece")
    verified = durable(spread.mapInPandas(lambda batches: _by_piece(batches, read, done), "node long, links long, root long"), "verified")
    counted = verified.groupBy("node").agg(F.sum("links").alias("n_links"))
    found = components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = classes.join(counted, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), F.col("rep_id"), F.col("a"), F.col("b")))
    heads = grouped.groupBy("component").agg(least.alias("first"))
    final = durable(
        grouped.join(heads, "component").select("a", "b", "rep_id", F.col("first.rep_id").alias("class_id"), ((F.col("first.a") == F.col("a")) & (F.col("first.b") == F.col("b"))).alias("head"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")),
        "neardup",
    )
    discard(classes, shared, open_, verified)
    # a class may hold a third of all rows: deal it out over salts
    salted = final.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sketched.select("doc_id", "a", "b", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["a", "b", "salt"]).drop("salt")


def op9_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """One row a document: its class, how many different texts it links to, and how many rows equal it."""
    return join(docs.select("doc_id", "text")).select("doc_id", "class_id", "n_links", F.col("copies").alias("n_equal"), F.col("rep_id").alias("equal_id"))


def kept_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, the least doc_id, with all its columns; of repeated rows, one."""
    heads = join(docs.select("doc_id", "text"), threshold).filter("head").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "a", "b").distinct()
    a, b = _class_hashes(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), a.alias("row_a"), b.alias("row_b"))
    hit = rows.join(heads, rows["row_id"].cast("long").eqNullSafe(heads["doc_id"]) & (rows["row_a"] == heads["a"]) & (rows["row_b"] == heads["b"]), "left_semi")
    return hit.groupBy("row_id", "row_a", "row_b").agg(F.first("row").alias("row")).select("row.*")
