"""Exact deduplication by Grace hash partitioning and open-addressing tables that compare complete content.

1.  Every text is normalised and hashed once, beside the scan.  Each task keeps an open-addressing table of the
    contents it has met, of bounded bytes; copies that meet there become one record, so that a group of copies, however
    large, leaves one record a table and not one a row.  Rows, and records with their content, are written down.
2.  Records are partitioned by their hash, so many partitions that one holds ``BUCKET_BYTES`` on average; Spark's
    shuffle files are the spill files of this level.  A task streams its bucket through a table that compares
    complete content.  Where a table is full, content that it does not hold spills to files in the shared
    folder, and these are partitioned again by another hash, level after level, until every bucket fits.  Content that
    a table holds has met all its records there, so every group is settled on one level.
3.  Records learn their group's row that stays and its size, and rows learn it from their record.

Defined results: null counts as the empty text; texts are equal when identical after each run of blanks
(``[\\x20\\x09-\\x0D]+``) has become one space; of equal texts the row of the smallest doc_id stays, null ids last, and of
repeated rows of that doc_id one; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, durable

#: Content that one table may hold: of a task beside the scan, and of a bucket.
COMBINE_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20
#: A content counts so much more than its own bytes, for its place in a table.
ENTRY_BYTES = 200
NO_ID = 1 << 63


class ContentTable:
    """Open addressing with linear probing: a slot leads to an entry, and an entry is met only if its whole content is equal."""

    def __init__(self, hash_of: Callable[[bytes], int] = hash) -> None:
        self.hash_of, self.mask, self.slots = hash_of, 63, [-1] * 64
        self.contents: list[bytes] = []
        self.hashes: list[int] = []
        self.bytes = 0

    def find(self, content: bytes, add: bool = True) -> int:
        """The number of the entry of ``content``; one that is not there is added, or else -1."""
        h = self.hash_of(content)
        slots, mask = self.slots, self.mask
        at = h & mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & mask
        if not add:
            return -1
        k = slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.contents) > mask:
            self._grow()
        return k

    def _grow(self) -> None:
        self.mask = mask = 4 * self.mask + 3
        self.slots = slots = [-1] * (mask + 1)
        for k, h in enumerate(self.hashes):
            at = h & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = k


class Groups:
    """A table with each entry's least (doc_id, row) and number of rows."""

    def __init__(self) -> None:
        self.table, self.least, self.size = ContentTable(), [], []

    def add(self, content: bytes, least: tuple[int, int], size: int, room: int) -> int:
        """The entry's number, or -1 where the content is not there and ``room`` bytes are taken; one content always finds room."""
        k = self.table.find(content, add=self.table.bytes < room)
        if k == len(self.least):
            self.least.append(least)
            self.size.append(size)
        elif k >= 0:
            self.least[k] = min(self.least[k], least)
            self.size[k] += size
        return k


def normalised(text: Column) -> Column:
    """Runs of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


#: A row of a document: its record, doc_id, digest.  A record: itself, its least doc_id and row, its rows and content.
ROWS = "record long, row long, doc_id long, digest binary, size long, content binary"


def _combined(room: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with the record of their content, and records; numbers are a task's own, from its partition's number on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        row = first = base
        groups, digests = Groups(), []

        def records() -> pd.DataFrame:
            n = len(digests)
            return pd.DataFrame({"record": range(first, first + n), "row": [r for _, r in groups.least], "doc_id": pd.array([None if d == NO_ID else d for d, _ in groups.least], "Int64"), "digest": digests, "size": pd.array(groups.size, "Int64"), "content": groups.table.contents})

        for batch in batches:
            found = []
            ids = [NO_ID if missing else d for d, missing in zip(batch["doc_id"].fillna(0).astype("int64").tolist(), batch["doc_id"].isna(), strict=True)]
            for k, (doc_id, content, digest) in enumerate(zip(ids, batch["content"], batch["digest"], strict=True)):
                entry = groups.add(content, (doc_id, row + k), 1, room)
                if entry < 0:
                    yield records()
                    first += len(digests)
                    groups, digests = Groups(), []
                    entry = groups.add(content, (doc_id, row + k), 1, room)
                if entry == len(digests):
                    digests.append(digest)
                found.append(first + entry)
            yield pd.DataFrame({"record": found, "row": range(row, row + len(found)), "doc_id": batch["doc_id"], "digest": batch["digest"], "size": pd.array([None] * len(found), "Int64"), "content": None})
            row += len(found)
        if digests:
            yield records()

    return run


#: A link has a record and its group; a group its least doc_id and row, and its rows; what did not fit is a record as before.
SETTLED = "bucket long, entry long, record long, row long, doc_id long, digest binary, size long, content binary"


def _settled(room: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One bucket, streamed through a table of ``room`` bytes of different contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, groups = TaskContext.get().partitionId(), Groups()
        for batch in batches:
            ids = [NO_ID if missing else d for d, missing in zip(batch["doc_id"].fillna(0).astype("int64").tolist(), batch["doc_id"].isna(), strict=True)]
            entries = pd.Series([groups.add(content, least, size, room) for content, least, size in zip(batch["content"], zip(ids, batch["row"], strict=True), batch["size"], strict=True)], batch.index, "int64")
            fits = entries >= 0
            yield pd.DataFrame({"bucket": bucket, "entry": entries[fits], "record": batch["record"][fits], "row": pd.array([None] * int(fits.sum()), "Int64"), "doc_id": None, "digest": None, "size": None, "content": None}).astype({"doc_id": "Int64", "size": "Int64"})
            if not fits.all():
                spilt = batch[~fits]
                yield pd.DataFrame({"bucket": pd.array([None] * len(spilt), "Int64"), "entry": pd.array([None] * len(spilt), "Int64"), **{c: spilt[c] for c in ("record", "row", "doc_id", "digest", "size", "content")}})
        n = len(groups.least)
        yield pd.DataFrame({"bucket": bucket, "entry": range(n), "record": pd.array([None] * n, "Int64"), "row": [r for _, r in groups.least], "doc_id": pd.array([None if d == NO_ID else d for d, _ in groups.least], "Int64"), "digest": None, "size": groups.size, "content": None})

    return run


def groups_of_equal_texts(docs: DataFrame, combine_bytes: int = COMBINE_BYTES, bucket_bytes: int = BUCKET_BYTES, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of every row.  ``digest`` spreads content over buckets; equality is decided by content alone."""
    bounded_batches(docs.sparkSession)
    content = normalised(F.col("text")).cast("binary")
    digest = digest or (lambda c: F.unhex(F.sha2(c, 256)))
    read = docs.select(F.col("doc_id").cast("long"), content.alias("content")).withColumn("digest", digest(F.col("content")))
    rows = durable(read.mapInPandas(_combined(combine_bytes), ROWS), "dedup-rows", "zstd")
    records = rows.filter("content is not null")
    total = records.agg(F.coalesce(F.sum(F.octet_length("content") + ENTRY_BYTES), F.lit(0)).alias("bytes")).first()["bytes"]
    levels: list[DataFrame] = []
    while total:
        buckets = -(-total // bucket_bytes)
        spread = records.repartition(buckets, F.xxhash64(F.lit(len(levels)), "digest"))
        level = durable(spread.mapInPandas(_settled(bucket_bytes), SETTLED).withColumn("level", F.lit(len(levels))), "dedup-level", "zstd")
        levels.append(level)
        records = level.filter("content is not null").select("record", "row", "doc_id", "digest", "size", "content")
        total = records.agg(F.coalesce(F.sum(F.octet_length("content") + ENTRY_BYTES), F.lit(0)).alias("bytes")).first()["bytes"]
    if not levels:
        return rows.select("doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), F.lit(None).cast("boolean").alias("kept"))
    settled = reduce(DataFrame.union, levels)
    group = ["level", "bucket", "entry"]
    links = settled.filter("record is not null and content is null").select(*group, "record")
    totals = settled.filter("record is null").select(*group, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))
    known = links.join(totals, group).select("record", "keep_id", "keep_row", "group_size")
    each = rows.filter("content is null").select("record", "row", "doc_id", "digest")
    return each.join(known, "record").select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))


def op11_exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document with the document of its text that stays, the number of equal texts, and the SHA-256 of the normalised text."""
    found = groups_of_equal_texts(docs)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: The same in DuckDB; a table in which one doc_id stands twice may choose another of its rows.
ORACLE_SQL = """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as content from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       row_number() over (partition by content order by doc_id nulls last) = 1 as kept, sha256(content) as text_sha256
from t window same as (partition by content)
"""
