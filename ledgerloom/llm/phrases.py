"""Phrase collocations from an FM-index per shard over word ids.

1.  Each task cuts its texts into shards of one language and of bounded words, and numbers the words of a shard.  Words
    frequent in all shards together are kept, all others part phrases as ends of pieces do.  Of the rest a shard builds
    its FM-index: the Burrows-Wheeler transforms of the words and of the words backwards, both in the order of as many
    words as a phrase may have, which is all that intervals of that length need.
2.  A phrase is a pair of intervals of one width, its count, in both transforms.  From the intervals of one level those
    of the next are reached by extending all of them at once: to the left in one transform, to the right in the other,
    each time with the other interval kept in step.  So an extension knows both phrases that it extends.
3.  Counts are summed across shards: a shard deals its phrases into groups by a hash and sends each group one packed
    block, and a group tells each shard which of its own are frequent in all together.  Only those are extended further:
    what is inside a frequent phrase is at least as frequent, so nothing is lost.  A phrase is named by the ids of the two
    phrases that it extends, from whose intervals the index finds its own again; so no interval is ever sent, and no text
    after the first level.
4.  Counts of first and last parts come down the same two lines, so every cut of a candidate is scored without a search.

Rows out: the first phrases of each language.  Defined results: a null text has no words; a null language is ``und``;
repeated rows and ids count as often as they stand; a shard takes a text of any length
whole; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from ledgerloom.llm.common import bounded_batches, bucketed, discard, durable

#: Words of a shard, and how many shards' words a task holds before it closes the largest that is not full.
SHARD_WORDS, HELD = 2_000_000, 4
#: Bytes of text of a task, enough to fill shards: the more words a shard has, the fewer different phrases it has to send for each of them.
TASK_BYTES = 64_000_000
#: Words of the corpus for each group that sums counts across shards: as many groups as it takes for each to stay bounded.
GROUP_WORDS = 2_000_000
#: Stands between pieces; no text in UTF-8 holds this byte.
GAP = b"\xff"
_TABLE = bytearray(range(256))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 0xFF
_TABLE = bytes(_TABLE)


def words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, with a gap at each end of a piece."""
    return text.encode().lower().translate(_TABLE).replace(GAP, b" \xff ").split()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the different ones."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.empty(len(keys), np.int32)
    new[order] = np.cumsum(np.concatenate([[False], sorted_keys[1:] != sorted_keys[:-1]]), dtype=np.int32)
    return new


def _in_order(keys: np.ndarray) -> np.ndarray:
    """The places of the keys (under 2**31) in their order, equal ones in the order of their places."""
    return np.sort(keys.astype(np.int64) << 32 | np.arange(len(keys))) & 0xFFFFFFFF


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, suffixes in the order of their first ``depth`` symbols; the text is taken as a ring."""
    key, length = symbols.astype(np.int64), 1
    while length < depth:
        step = min(length, depth - length)
        rank = key if length == 1 else _ranks(key).astype(np.int64)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        length += step
    return np.roll(symbols, 1)[np.argsort(key)]


def steps(bwt: np.ndarray) -> np.ndarray:
    """For each row, the row of the suffix one symbol longer."""
    out = np.empty(len(bwt), np.int32)
    out[_in_order(bwt)] = np.arange(len(bwt), dtype=np.int32)
    return out


def extended(bwt: np.ndarray, step: np.ndarray, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All extensions of intervals by the symbol before: (parent, low, other, size), ``other`` being the interval in the transform of the other direction.

    In the other direction the extensions of an interval stand inside it in the order of their symbols.
    """
    parent_of = np.full(len(bwt), -1, np.int32)
    rows = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
    parent_of[step[rows]] = np.repeat(np.arange(len(low), dtype=np.int32), size)  # rows of one extension now stand together
    symbol_of = np.repeat(np.arange(int(bwt.max(initial=0)) + 1), np.bincount(bwt))
    edge = np.flatnonzero(np.concatenate([[True], (parent_of[1:] != parent_of[:-1]) | (symbol_of[1:] != symbol_of[:-1])]))
    width = np.diff(np.append(edge, len(bwt)))
    of = parent_of[edge]
    edge, width, of = edge[of >= 0], width[of >= 0], of[of >= 0]
    order = _in_order(of)  # of one parent, extensions by symbol
    edge, width, of = edge[order], width[order], of[order]
    inside = np.cumsum(width) - width - (np.cumsum(size) - size)[of]
    whole = symbol_of[edge] > 0  # gaps are symbol 0
    return of[whole], edge[whole], (other[of] + inside)[whole], width[whole]


class Shard:
    """Both transforms of the words of one shard."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.forward, self.backward = forward, backward
        self.forward_step, self.backward_step = steps(forward), steps(backward)

    def extensions(self, low: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(low, back, size, head, tail) of phrases one word longer whose head (all but the last word) and tail (all but the first) are both among the intervals given."""
        tail, tail_low, tail_back, sizes = extended(self.forward, self.forward_step, low, back, size)
        head, head_back, head_low, _ = extended(self.backward, self.backward_step, back, low, size)
        # one phrase has one interval, whichever side it was reached from
        at = np.full(len(self.forward), -1, np.int64)
        at[head_low] = head
        both = at[tail_low] >= 0
        return tail_low[both], tail_back[both], sizes[both], at[tail_low[both]], tail[both]


    def ranked(self, bwt: np.ndarray) -> np.ndarray:
        """The rows of a transform by symbol: how many stand below (symbol, row) is the row of the suffix one symbol longer."""
        return np.sort(bwt.astype(np.int64) << 32 | np.arange(len(bwt)))

    def first(self, low: np.ndarray) -> np.ndarray:
        """The symbols that rows of the forward transform begin with."""
        return np.searchsorted(np.cumsum(np.bincount(self.forward)), low, "right")

    def prepended(self, symbol: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, size) of intervals extended to the left by one symbol each."""
        ranked = self.ranked(self.forward)
        start = np.searchsorted(ranked, symbol << 32 | low)
        return start, np.searchsorted(ranked, symbol << 32 | low + size) - start

    def backs(self, low: np.ndarray, length: int) -> np.ndarray:
        """The lows in the backward transform of phrases of ``length`` words, given by their lows in the forward one."""
        after = np.empty(len(self.forward), np.int32)
        after[self.forward_step] = np.arange(len(self.forward), dtype=np.int32)  # the row of the suffix one symbol shorter
        ranked, row, back = self.ranked(self.backward), low, np.zeros(len(low), np.int64)
        for _ in range(length):
            back = np.searchsorted(ranked, self.first(row) << 32 | back)
            row = after[row]
        return back


def pressed(data: bytes) -> bytes:
    return ZstdCompressor(level=1).compress(data)


def unpressed(data: bytes) -> bytes:
    return ZstdDecompressor().decompress(data)


def stored(symbols: np.ndarray) -> bytes:
    return pressed(symbols.astype("<u2" if symbols.max(initial=0) < 1 << 16 else "<u4").tobytes())


def loaded(data: bytes, symbols: int) -> np.ndarray:
    raw = unpressed(data)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * symbols else "<u4").astype(np.int32)


def packed(ascending: int, *columns: np.ndarray) -> bytes:
    """Columns of numbers, the first ``ascending`` of them as steps; each byte of all rows stands beside its like."""
    table = np.stack([np.diff(c, prepend=0) if k < ascending else c for k, c in enumerate(columns)]).astype("<i8")
    return pressed(table.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes())


def unpacked(data: bytes, ascending: int, columns: int) -> np.ndarray:
    """The columns as rows of one array."""
    raw = np.frombuffer(unpressed(data), np.uint8).reshape(columns, 8, -1)
    table = raw.transpose(0, 2, 1).copy().view("<i8")[..., 0]
    table[:ascending] = np.cumsum(table[:ascending], axis=1)
    return table


#: A shard: its words in order as numbers, its different words in the order of their numbers (from 1), and their counts.
SHARDS = "shard long, lang string, symbols binary, size int, words binary, counts binary, different int"


def _shards(most_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal shard, total
            ids, parts = held.pop(lang)
            symbols = np.concatenate([*parts, np.zeros(1, np.int32)])
            total -= sizes.pop(lang)
            shard += 1
            counts = np.bincount(symbols, minlength=len(ids))[1:]
            return _batch(SHARDS, 1, shard=[shard], lang=[lang], symbols=[stored(symbols)], size=[len(symbols)], words=[pressed(b" ".join(list(ids)[1:]))], counts=[stored(counts)], different=[len(counts)])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, parts = held.setdefault(lang, ({GAP: 0}, []))
                found = words(text)
                parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in [GAP, *found]), np.int32, len(found) + 1))
                total, sizes[lang] = total + len(found) + 1, sizes.get(lang, 0) + len(found) + 1
                if sizes[lang] >= most_words:
                    yield closed(lang)
                elif total >= HELD * most_words:
                    yield closed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield closed(lang)

    return run


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(schema: str, n: int, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that are not given are null."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    arrays = [pa.array(columns[c]).cast(KINDS[k]) if c in columns else pa.nulls(n, KINDS[k]) for c, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


#: What one group sums of a shard: phrases as (head, tail, size); of single words, the words themselves, with (number, size).
BLOCK = "group long, shard long, lang string, words binary, data binary"
#: What a group found frequent: a phrase with its count, or, for a shard, all that it holds: (id, head, tail), of words (number, id).
MET = "id long, lang string, word binary, head long, tail long, f long, shard long, data binary"
#: Both transforms of a shard, and the ids of its symbols from 1.
INDEX = "shard long, forward binary, backward binary, size int, ids binary"
Grouped = Callable[[pa.Table], pa.Table]
Together = Callable[[pa.Table, pa.Table], pa.Table]


def _counted(own: pa.Table) -> pa.Table:
    """How many words a shard holds."""
    lang, counts, n = (own.column(c)[0].as_py() for c in ("lang", "counts", "different"))
    return pa.table({"lang": pa.array([lang], pa.string()), "n": pa.array([int(loaded(counts, n).sum())], pa.int64())})


def _word_blocks(groups: int) -> Grouped:
    def run(own: pa.Table) -> pa.Table:
        shard, lang, listed, counts, n = (own.column(c)[0].as_py() for c in ("shard", "lang", "words", "counts", "different"))
        if not n:
            return pa.Table.from_batches([_batch(BLOCK, 0)])
        each, size, start = unpressed(listed).split(b" "), loaded(counts, n), crc32(lang.encode())
        of = np.fromiter((crc32(w, start) % groups for w in each), np.int64, n)
        out = []
        for group, at in _parted(of):
            out.append((group, pressed(b" ".join([each[k] for k in at])), packed(1, at + 1, size[at])))
        group, texts, data = zip(*out, strict=True)
        return pa.Table.from_batches([_batch(BLOCK, len(out), group=group, shard=np.full(len(out), shard), lang=[lang] * len(out), words=texts, data=data)])

    return run


def _parted(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group with the places that belong to it, ascending."""
    order = np.argsort(of, kind="stable")
    edge = np.flatnonzero(np.diff(of[order], prepend=-1))
    yield from zip(of[order][edge].tolist(), np.split(order, edge[1:]), strict=True)


def _answers(blocks: pa.Table, parts: list[np.ndarray], held: np.ndarray, answer: Callable[[np.ndarray, np.ndarray], bytes]) -> pa.RecordBatch:
    """To each shard its own frequent phrases, from the columns of its block and their ids (-1: not frequent)."""
    out = []
    for shard, part, ids in zip(blocks.column("shard").to_pylist(), parts, np.split(held, np.cumsum([p.shape[1] for p in parts])[:-1]), strict=True):
        if (ids >= 0).any():
            out.append((shard, answer(part[:, ids >= 0], ids[ids >= 0])))
    return _batch(MET, len(out), shard=pa.array([n for n, _ in out], pa.int64()), data=pa.array([d for _, d in out], pa.binary()))


def _ids(group: int, groups: int, n: int) -> np.ndarray:
    """Ids that a group gives: of all groups together they are dense, so that blocks of them pack well."""
    return group + groups * np.arange(n)


def _met_words(least: int, groups: int) -> Grouped:
    def run(blocks: pa.Table) -> pa.Table:
        """Words of one group, summed across shards."""
        codes: dict[tuple[str, bytes], int] = {}
        parts, code = [], []
        for lang, listed, data in zip(*(blocks.column(c).to_pylist() for c in ("lang", "words", "data")), strict=True):
            parts.append(unpacked(data, 1, 2))
            code.append(np.fromiter((codes.setdefault((lang, w), len(codes)) for w in unpressed(listed).split(b" ")), np.int64, parts[-1].shape[1]))
        code, f = np.concatenate(code), np.zeros(len(codes), np.int64)
        np.add.at(f, code, np.concatenate([p[1] for p in parts]))
        far, names, ids = np.flatnonzero(f >= least), list(codes), np.full(len(f), -1)
        far = far[np.argsort(-f[far], kind="stable")]  # the most frequent, of which most phrases consist, get the smallest
        ids[far] = _ids(blocks.column("group")[0].as_py(), groups, len(far))
        frequent = _batch(MET, len(far), id=ids[far], lang=pa.array([names[k][0] for k in far], pa.string()), word=pa.array([names[k][1] for k in far], pa.binary()), f=f[far])
        return pa.Table.from_batches([frequent, _answers(blocks, parts, ids[code], lambda part, ids: packed(1, part[0], ids))])

    return run


def _met(least: int, groups: int, answered: bool) -> Grouped:
    def run(blocks: pa.Table) -> pa.Table:
        """Phrases of one group, named by the ids of head and tail, summed across shards."""
        parts = [unpacked(d, 1, 3) for d in blocks.column("data").to_pylist()]
        head, tail, size = np.concatenate(parts, axis=1)
        order = np.lexsort((tail, head))
        edge = np.flatnonzero((np.diff(head[order], prepend=-1) != 0) | (np.diff(tail[order], prepend=-1) != 0))
        f = np.add.reduceat(size[order], edge)
        far, ids = np.flatnonzero(f >= least), np.full(len(f), -1)
        ids[far] = _ids(blocks.column("group")[0].as_py(), groups, len(far))
        first, held = order[edge[far]], np.empty(len(order), np.int64)
        frequent = _batch(MET, len(far), id=ids[far], head=head[first], tail=tail[first], f=f[far])
        if not answered:
            return pa.Table.from_batches([frequent])
        held[order] = np.repeat(ids, np.diff(np.append(edge, len(order))))
        return pa.Table.from_batches([frequent, _answers(blocks, parts, held, lambda part, ids: packed(2, ids, part[0], part[1]))])

    return run


def _blocks(shard: Shard, number: int, low: np.ndarray, back: np.ndarray, size: np.ndarray, ids: np.ndarray, groups: int) -> pa.Table:
    """The phrases of a shard one word longer than those given, in a block for each group that sums them."""
    _, _, size, head, tail = shard.extensions(low, back, size)
    head, tail = ids[head], ids[tail]
    order = np.lexsort((tail, head))
    head, tail, size = head[order], tail[order], size[order]
    mixed = (head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tail.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    of = (mixed >> np.uint64(32)).astype(np.int64) % groups
    out = [(group, packed(1, head[at], tail[at], size[at])) for group, at in _parted(of)] if len(of) else []
    return pa.Table.from_batches([_batch(BLOCK, len(out), group=[g for g, _ in out], shard=np.full(len(out), number), data=pa.array([d for _, d in out], pa.binary()))])


def _indexed(depth: int) -> Together:
    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        """The index of a shard over its frequent words."""
        if not own.num_rows or not known.num_rows:
            return pa.Table.from_batches([_batch(INDEX, 0)])
        shard, n, data = (own.column(c)[0].as_py() for c in ("shard", "size", "symbols"))
        symbols, (old, ids) = loaded(data, n), np.concatenate([unpacked(d, 1, 2) for d in known.column("data").to_pylist()], axis=1)
        number = np.zeros(int(symbols.max()) + 1, np.int32)
        number[old] = np.arange(1, len(old) + 1)
        symbols = number[symbols]
        symbols = symbols[np.concatenate([[True], (symbols[1:] > 0) | (symbols[:-1] > 0)])]  # one gap for many
        both = [stored(transform(s, depth)) for s in (symbols, symbols[::-1])]
        return pa.Table.from_batches([_batch(INDEX, 1, shard=[shard], forward=both[:1], backward=both[1:], size=[len(symbols)], ids=[packed(0, ids)])])

    return run


def _read(own: pa.Table) -> tuple[int, Shard, np.ndarray, np.ndarray, np.ndarray]:
    """A shard with the lows, sizes and ids of its words."""
    shard, n, ids, *data = (own.column(c)[0].as_py() for c in ("shard", "size", "ids", "forward", "backward"))
    index = Shard(*(loaded(d, n) for d in data))
    sizes = np.bincount(index.forward)
    return shard, index, (np.cumsum(sizes) - sizes)[1:], sizes[1:], unpacked(ids, 0, 1)[0]


def _pairs(groups: int) -> Grouped:
    def run(own: pa.Table) -> pa.Table:
        """Phrases of two words of a shard."""
        number, shard, low, size, ids = _read(own)
        return _blocks(shard, number, low, low, size, ids, groups)

    return run


def _longer(groups: int, length: int) -> Grouped:
    def run(own: pa.Table) -> pa.Table:
        """Phrases of a shard one word longer than its frequent ones of ``length``, which are found again from its words up."""
        number, shard, low, size, ids = _read(own)
        for k in range(2, length + 1):
            new, head, tail = np.concatenate([unpacked(d, 2, 3) for d in own.column(f"of_{k}")[0].as_py()], axis=1)
            order = np.argsort(ids)
            head, tail = (order[np.searchsorted(ids, x, sorter=order)] for x in (head, tail))
            low, size = shard.prepended(shard.first(low[head]), low[tail], size[tail])
            ids = new
        order = np.argsort(low)
        low, size, ids = low[order], size[order], ids[order]
        return _blocks(shard, number, low, shard.backs(low, length), size, ids, groups)

    return run


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a statement when it ends: each of ours writes a table, which alone is read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def frequent_phrases(docs: DataFrame, most_words: int, least: int, shard_words: int) -> tuple[list[DataFrame], DataFrame]:
    """Of each length: id, lang, phrase, f, and counts of its first and last 1, 2, ... words (prefixes, suffixes), and from two words on the ids of head and tail; and (lang, n)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TASK_BYTES))
    # in buckets, as the index and what is known of a shard are, so that none is shuffled when they meet
    shards = bucketed(texts.coalesce(tasks).mapInArrow(_shards(shard_words), SHARDS), "phrase_shards", "shard", "zstd")
    counted = shards.select("shard", "lang", "words", "counts", "different")
    totals = durable(counted.groupBy("shard").applyInArrow(_counted, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    groups = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // GROUP_WORDS
    met = durable(counted.groupBy("shard").applyInArrow(_word_blocks(groups), BLOCK).groupBy("group").applyInArrow(_met_words(least, groups), MET), "phrase-words", "zstd")
    levels = [met.filter("shard is null").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))]
    answers = met.filter("shard is not null").select("shard", "data")
    own = shards.select("shard", "symbols", "size")
    index = bucketed(own.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_indexed(most_words), INDEX), "fm_index", "shard", "zstd")
    discard(shards)
    known: list[DataFrame] = []
    for length in range(2, most_words + 1):
        if length == 2:
            blocks = index.groupBy("shard").applyInArrow(_pairs(groups), BLOCK)
        else:
            # a row a shard on all sides
            told = reduce(lambda own, answers: own.join(answers, "shard"), known, index)
            blocks = told.groupBy("shard").applyInArrow(_longer(groups, length - 1), BLOCK)
        level = durable(blocks.groupBy("group").applyInArrow(_met(least, groups, length < most_words), MET), "phrase-level", "zstd")
        if length < most_words:  # shuffled once, for all levels that follow
            answers = level.filter("shard is not null").groupBy("shard").agg(F.collect_list("data").alias(f"of_{length}"))
            known.append(bucketed(answers, "phrase_answers", "shard", "zstd"))
        pairs = level.filter("shard is null").select("id", "head", "tail", "f")
        heads = levels[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"), "prefixes")
        tails = levels[-1].select(F.col("id").alias("tail"), "last", "suffixes")
        longer = pairs.join(heads, "head").join(tails, "tail").select(
            "id", "lang", F.concat("first", F.lit(bytearray(b" ")), "last").alias("phrase"), "last", "f",
            F.concat("prefixes", F.array("f")).alias("prefixes"), F.concat("suffixes", F.array("f")).alias("suffixes"), "head", "tail")
        levels.append(durable(longer, "phrases"))
        discard(level)
    discard(met, index, *known)
    return levels[1:], totals


def collocations(docs: DataFrame, most_words: int = 5, least: int = 100, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of 2 to ``most_words`` words that are inside no longer candidate of the same count."""
    with _own_shuffles(docs.sparkSession):
        levels, totals = frequent_phrases(docs, most_words, least, shard_words)
    kept = []
    for level, above in zip(levels, [*levels[1:], None], strict=True):
        if above is not None:
            # inside a longer phrase just as frequent, a phrase is so by way of a left or right extension
            reach = above.select(F.col("tail").alias("id"), "f").union(above.select(F.col("head").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("reach"))
            level = level.join(reach, "id", "left").filter(F.coalesce(F.col("reach"), F.lit(0)) < F.col("f"))
        kept.append(level.select("lang", "phrase", F.col("f").alias("a"), "prefixes", "suffixes"))
    wide = lambda c: c.cast("decimal(38,0)")
    parts = F.size("prefixes")

    def cut(k: Column) -> Column:
        left, right = F.element_at("prefixes", k), F.element_at("suffixes", parts - k)
        score = F.call_function("div", wide(F.lit(1000)) * wide(F.col("a")) * wide(F.col("n")), wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    lowest = F.array_min(F.transform(F.sequence(F.lit(1), parts - 1), cut))
    # a row a language
    return reduce(DataFrame.union, kept).join(totals, "lang").withColumn("cut", lowest).select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def op13_collocations(docs: DataFrame, top: int = 2000) -> DataFrame:
    """The contract's query: the first ``top`` phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _sql(most_words: int = 5, least: int = 100, top: int = 2000) -> str:
    """The same in DuckDB."""
    sizes = range(1, most_words + 1)
    grams = "\nunion all ".join(f"select lang, {k} as m, list_slice(ws, i, i + {k - 1}) as g from placed where i + {k - 1} <= len(ws)" for k in sizes)
    return f"""
with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from texts),
split as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from pieces),
placed as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from split),
grams as ({grams}),
f as materialized (select lang, m, g, count(*) as f from grams group by all having count(*) >= {least}),
totals as (select lang, sum(len(ws))::bigint as n from split group by lang),
candidates as materialized (select * from f where m >= 2),
covered as (
  select distinct lang, list_slice(g, s, s + k - 1) as g, k as m, f from candidates, range(2, {most_words}) as ks(k), range(1, {most_words}) as ss(s) where k < m and s + k - 1 <= m
), kept as (select c.* from candidates c anti join covered d on c.lang = d.lang and c.m = d.m and c.g = d.g and d.f >= c.f),
cuts as (
  select c.lang, c.g, c.f as a, x.f as l, y.f as r, n, k, (1000::hugeint * c.f * n) // (x.f::hugeint * y.f) as score
  from kept c join totals using (lang), range(1, {most_words}) as ks(k)
  join f x on true join f y on true
  where k < c.m and x.lang = c.lang and x.m = k and x.g = list_slice(c.g, 1, k) and y.lang = c.lang and y.m = c.m - k and y.g = list_slice(c.g, k + 1, c.m)
), chosen as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
ranked as (select *, array_to_string(g, ' ') as phrase, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from chosen)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= {top}
"""


ORACLE_SQL = _sql()
