"""Phrase mining against brute force, over one shard and over many, and the transforms alone."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    vocabulary = ["Ab", "b", "ÀB", "日本", "c-d", "e'", " ", "x\x1fy", "f", "G"]
    rows = [(k, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(rng.randrange(1, 80))), rng.choice(["en", "en", "de", None, "und"])) for k in range(150)]
    rows += [(500 + k, "the same words again and again in every copy of it; New York City", "en") for k in range(60)]
    rows += [(600, None, "en"), (601, "", None), (602, " \t . ", "fr"), (603, "only two", "fr"), (None, "the same words again", "en"), (604, " ".join(rng.choice("pqrs") for _ in range(20_000)), "es"), (605, "word " * 3000, "es"), (605, "word " * 3000, "es")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({"shard": F.lit(1), "word": F.lit("x"), "SIZE": F.lit(None).cast("string"), "n": F.lit(0), "words": F.lit(2)}).cache()


def brute(docs, most_words, least):
    f, n = defaultdict(Counter), Counter()
    for r in docs.select("text", "lang").collect():
        lang = r["lang"] if r["lang"] is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, most_words + 1):
                f[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        inside = defaultdict(int)
        for g, c in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i:i + m]] = max(inside[g[i:i + m]], c)
        for g, a in candidates.items():
            if inside[g] < a:
                score, _, l, r = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                out.append((lang, " ".join(g), a, l, r, n[lang], score))
    return sorted(out)


@pytest.mark.parametrize(("most_words", "least", "shard_words", "group_words"), [(5, 20, phrases.SHARD_WORDS, phrases.GROUP_WORDS), (5, 3, 300, 5000), (3, 1, 2000, 20_000)])
def test_same_phrases_as_brute_force(docs, monkeypatch, most_words, least, shard_words, group_words):
    monkeypatch.setattr(phrases, "GROUP_WORDS", group_words)
    want = brute(docs, most_words, least)
    assert len(want) > 20
    assert sorted(map(tuple, phrases.collocations(docs, most_words, least, shard_words).collect())) == want


def test_the_first_of_each_language(docs):
    want = defaultdict(list)
    for lang, phrase, a, l, r, n, score in brute(docs, 5, 100):
        want[lang].append((-score, -a, phrase.encode(), l, r, n))
    got = phrases.op13_collocations(docs, top=7).collect()
    found = sorted((r["lang"], r["rank"], -r["score"], -r["a"], r["phrase"].encode(), r["l"], r["r"], r["n"]) for r in got)
    assert found == sorted((lang, k, *row) for lang, rows in want.items() for k, row in enumerate(sorted(rows)[:7], 1))


def test_shards_fill_and_answers_are_shuffled_once(docs, monkeypatch, spark):
    made = {}

    def kept(df, label, *more):
        out = bucketed(df, label, *more)
        made.setdefault(label, []).append((out.count(), df.rdd.getNumPartitions()))
        return out

    bucketed = phrases.bucketed
    monkeypatch.setattr(phrases, "bucketed", kept)
    want = brute(docs, 5, 20)
    assert sorted(map(tuple, phrases.collocations(docs.repartition(40), 5, 20).collect())) == want
    [(shards, tasks)] = made["phrase_shards"]
    assert tasks <= spark.sparkContext.defaultParallelism and shards <= 5 * tasks  # of five languages, where 40 tasks closed theirs each
    assert len(made["phrase_answers"]) == 3  # of 2, 3 and 4 words, each read again without a shuffle


def test_ids_of_all_groups_are_dense():
    assert sorted(np.concatenate([phrases._ids(g, 3, 4) for g in range(3)]).tolist()) == list(range(12))


def test_no_rows_and_nothing_frequent(docs):
    for few in (docs.limit(0), docs.filter("doc_id in (600, 601, 602, 603)")):
        got = phrases.op13_collocations(few)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_extensions_both_ways_are_those_of_the_text():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.choice([0, 1, 1, 2, 2, 3, 4], 3000), 0).astype(np.int32)
    shard = phrases.Shard(phrases.transform(symbols, 5), phrases.transform(symbols[::-1], 5))
    sizes = np.bincount(symbols)
    low = (np.cumsum(sizes) - sizes)[1:]
    back, size, grams = low, sizes[1:], [(k,) for k in range(1, 5)]
    for m in range(2, 6):
        before = low, size
        low, back, size, head, tail = shard.extensions(low, back, size)
        grams = [(*grams[h], grams[t][-1]) for h, t in zip(head, tail, strict=True)]
        windows = Counter(tuple(w) for w in np.lib.stride_tricks.sliding_window_view(symbols, m).tolist() if 0 not in w)
        assert dict(zip(grams, size.tolist(), strict=True)) == windows
        assert (shard.backs(low, m) == back).all()
        first = np.array([g[0] for g in grams])
        again = shard.prepended(first, *(before[k][tail] for k in (0, 1)))
        assert (shard.first(low) == first).all() and (again[0] == low).all() and (again[1] == size).all()


def test_blocks_hold_what_was_packed():
    rng = np.random.default_rng(3)
    for n in (1, 7, 5000):
        columns = np.stack([np.sort(rng.integers(0, 1 << 31, n)), *rng.integers(0, 1 << 62, (2, n)), rng.integers(1, 1 << 31, n)])
        assert (phrases.unpacked(phrases.packed(1, *columns), 1, 4) == columns).all()
