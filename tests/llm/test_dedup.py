"""Exact deduplication against brute force: tiny tables, hashes that all collide, awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import dedup

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rows = [(1000 - k, rng.choice(base), "en") for k in range(300)]
    rows += [(k, base[0].replace(" ", rng.choice([" ", "\t", "\n\n", " \r\n", "\x0b\x0c"])), "en") for k in range(2000, 2200)]  # a third of all rows
    rows += [(3000, None, None), (3001, "", "en"), (3002, " ", "en"), (3003, "\n\t", "en"), (3004, " ", "en"), (3005, "x" * 300_000, "en"), (3006, "x" * 300_000, "en"), (3007, " ", None)]
    rows += [(None, "only without an id", "en"), (None, "only without an id", "en"), (None, base[1], "en"), (7, "twice", "en"), (7, "twice", "en"), (8, "twice", "en")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({"content": F.lit("clash"), "record": F.lit(1), "keep_id": F.lit("x"), "size": F.lit(None).cast("int"), "row": F.lit(0), "DIGEST": F.lit(1)}).cache()


def brute(docs):
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")].append(r["doc_id"])
    out = []
    for content, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known, default=None), len(ids), hashlib.sha256(content.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def check(got, docs):
    want, groups = brute(docs)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_equal_texts_and_the_row_that_stays(docs):
    check(dedup.op11_exact_dedup(docs).collect(), docs)


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1).cast("binary"), lambda c: F.lit(b"same")])
def test_full_buckets_spill_and_equal_digests_are_told_apart_by_content(docs, digest):
    got = dedup.groups_of_equal_texts(docs, combine_bytes=700, bucket_bytes=4000, digest=digest).collect()
    want, groups = brute(docs)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], key=str) == sorted([w[:3] for w in want], key=str)
    assert sum(r["kept"] for r in got) == groups


def test_a_table_whose_hashes_all_collide():
    table = dedup.ContentTable(hash_of=lambda content: 5)
    contents = [str(k).encode() for k in range(500)]
    assert [table.find(c) for c in contents] == list(range(500)) == [table.find(c, add=False) for c in contents]
    assert table.find(b"new", add=False) == -1 and len(table.contents) == 500


def test_no_rows(docs):
    got = dedup.op11_exact_dedup(docs.limit(0))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and got.count() == 0
