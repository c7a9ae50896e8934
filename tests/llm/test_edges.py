"""Rows that once stopped an operator: very deep urls, and benchmarks without a word; collisions counted by sets."""

import time

import numpy as np

from ledgerloom.llm import ann, decontaminate, urls


def test_urls_of_very_many_segments_take_time_linear_in_them(spark):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    deep = [(k, "http://deep.example/" + "/".join(f"s{j % 7}{'abc'[j % 3]}" for j in range(n)) + f"/{k}") for k, n in enumerate((2_000, 2_000, 20_000, 19_999))]
    flat = [(100 + k, f"http://deep.example/a/{'xyz'[k % 3]}/{k}") for k in range(40)]
    begin = time.time()
    got = {r["page_id"]: r for r in urls.op10_url_filter(spark.createDataFrame(deep + flat, "page_id long, url string"), labels).collect()}
    assert time.time() - begin < 120 and len(got) == 44
    assert all(got[k]["path"] == url.removeprefix("http://deep.example") and got[k]["verdict"] == "allow" for k, url in deep)


def test_a_block_of_items_without_words_matches_nothing(spark):
    docs = spark.createDataFrame([(1, "!!! some words here and more of them"), (2, None), (3, "!!!")], "doc_id long, text string")
    for items in ([(1, "!!!")], [(1, "!!!"), (2, "")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert decontaminate.op1_decontamination(docs, bench).count() == 0 and decontaminate.clean_documents(docs, bench).count() == 3


def test_collisions_are_those_of_windows_widened_to_whole_runs():
    rng = np.random.default_rng(4)
    for n in (1, 50, 3000):
        vectors = rng.normal(size=(n, 16))
        index = ann.Index(np.arange(n), vectors)
        units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        projected, asked = units @ index.axes, units[:7] @ index.axes
        for half in (0.0, 0.3, 1.0, 9.0):
            bits = index.collided(asked, np.full(len(asked), half), 64)
            held = np.stack([np.unpackbits(b.view(np.uint8), count=n, bitorder="little") for b in bits]).astype(bool)
            inside = [(np.abs(projected - a) <= half).sum(1) >= 64 for a in asked]
            run = 2 * -(-n // ann.RUNS)
            ranks = projected.argsort(0).argsort(0)
            for row, a in enumerate(asked):
                low, high = (projected < a - half).sum(0), (projected <= a + half).sum(0)
                wider = ((ranks >= low - run) & (ranks < high + run)).sum(1) >= 64
                assert held[row][inside[row]].all() and wider[held[row]].all()


def test_sums_of_bit_sets_are_exact():
    rng = np.random.default_rng(5)
    for many in (1, 2, 3, 7, 128):
        sets = rng.random((many, 640)) < 0.6
        bits = [np.packbits(x, bitorder="little").view(np.uint64)[None] for x in sets]
        for least in (1, 2, many // 2 + 1, many, many + 1):
            got = np.unpackbits(ann.at_least(ann.sliced_sum(bits), least)[0].view(np.uint8), bitorder="little")
            assert (got == (sets.sum(0) >= least)).all()
