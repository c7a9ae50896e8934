"""The pipeline's stages: what each keeps and drops of one awkward table, alone and in their order."""

from collections import Counter

import corpus_pipeline
import pytest
from ledgerloom.llm import decontaminate, mixing, toxicity
from ledgerloom.llm.common import durable
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
#: Words of the operators' own columns, as columns of the documents.
CLASHES = ("row", "row_id", "a", "b", "head", "class_id", "copies", "copy", "score", "size", "target", "words", "row_hash", "text_hash", "node", "key")


def counted(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = durable(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns
        if name != "mixing":
            before = Counter(r["doc_id"] for r in docs.collect())
            assert all(before[r["doc_id"]] for r in after.collect())
        docs = after
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == sizes[-1] and set(docs.columns) < set(last.columns)


@pytest.fixture(scope="module")
def awkward(spark):
    """All documents, with nulls in every column, empty and very long texts, copies, near copies, a leak and repeated rows."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() if r["text"]), key=len)
    text = " ".join(f"plain{k % 89}word{k % 7}" for k in range(120))
    near = text.replace("plain5word5", "another", 1)
    far = " ".join(f"other{k % 83}thing{k % 5}" for k in range(120))
    rows = [
        (None, None, None, None, None), (9_001, None, "en", None, 0), (9_002, "", None, "web", None), (9_003, " \t\n", "en", "", 3),
        (9_010, text, "en", "web", None), (9_011, text, "en", "web", None), (9_012, near, "en", "news", None), (9_013, far, "en", "web", None),
        (9_020, f"{far} before it. {item} and more after it", "en", "web", None),
        (9_030, " ".join(f"long{k * k % 99_991}" for k in range(60_000)), "en", "books", None),
        (9_040, "one row that stands here twice over", "en", "web", 35), (9_040, "one row that stands here twice over", "en", "web", 35),
    ]
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return durable(given.unionByName(extra).withColumns({c: F.lit(f"own {c}") for c in CLASHES}), "test-awkward")


def test_the_toxic_stage_drops_what_the_operator_marks_alone(spark, awkward):
    kept = STAGES["toxicity"](spark, awkward, SF)
    assert kept.columns == awkward.columns
    marks = toxicity.op5_toxicity(awkward, spark.read.parquet(f"{SF}/labels.parquet"))
    assert counted(kept) == counted(marks.filter("predicted = 0"))
    assert {9_001, 9_002, 9_003, 9_010, 9_030, None} <= set(counted(kept))


def test_the_join_keeps_one_of_each_group(spark, awkward):
    rows = STAGES["ngram_jaccard"](spark, awkward, SF)
    assert rows.columns == awkward.columns
    kept = counted(rows)
    assert max(kept.values()) == 1 and {9_010, 9_013, 9_020, 9_030, 9_040} <= set(kept)
    assert not {9_011, 9_012} & set(kept)

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}

    texts = {r["doc_id"]: shingles(r["text"]) for r in awkward.filter("length(text) > 5").select("doc_id", "text").collect()}
    for gone in set(texts) - set(kept):
        assert any(len(texts[gone] & s) >= 0.75 * len(texts[gone] | s) for d, s in texts.items() if d != gone), gone


def test_decontamination_drops_leaks_alone(spark, awkward):
    rows = STAGES["decontamination"](spark, awkward, SF)
    assert rows.columns == awkward.columns
    pairs = decontaminate.op1_decontamination(awkward, spark.read.parquet(f"{SF}/benchmark.parquet"))
    leaks = {r["doc_id"] for r in pairs.select("doc_id").collect()}
    before, after = counted(awkward), counted(rows)
    assert 9_020 in leaks and not leaks & {9_001, 9_002, 9_003, 9_010, 9_011, 9_012, 9_013, 9_030, 9_040}
    assert after == Counter({d: n for d, n in before.items() if d not in leaks})


def test_the_mix_repeats_rows_as_the_operator_says(spark, awkward):
    rows = STAGES["mixing"](spark, awkward, SF)
    assert rows.columns == awkward.columns
    after = counted(rows)
    taken = Counter()
    size = {}
    for r in mixing.op3_mixing(awkward).collect():
        taken[r["doc_id"]] += r["taken"]
        size[r["doc_id"]] = r["size"]
    assert all(after[d] * size[d] == taken[d] for d in size)
    assert all(n <= 3 * counted(awkward)[d] for d, n in after.items())


def test_shards_hold_every_row_once(spark, awkward):
    rows = STAGES["sharding"](spark, awkward, SF)
    assert counted(rows) == counted(awkward) and set(awkward.columns) < set(rows.columns)
    slots = {}
    for r in rows.select("shard", "slot").collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_tables_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
