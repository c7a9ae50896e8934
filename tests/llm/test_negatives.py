"""Hard-negative mining against brute force, and the certainty of its intervals."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows(spark):
    """Crowded clusters (so that many rows fall within the limits), a hot label, ties, repeated rows, other lengths and rows that take no part."""
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    out = [(k, [c + rng.gauss(0, 0.3) for c in centres[k % 4]], 0 if k % 3 else k % 10) for k in range(700)]
    out += [(1000 + k, [0.5] * 20, k % 3) for k in range(60)] + [(1001, [0.5] * 20, 1), (1100, [0.5] * 20, 1), (1100, [0.5] * 20, 1)]
    out += [(2000 + k, [rng.gauss(0, 1) for _ in range(3)], k % 2) for k in range(40)] + [(3000, [], 1), (3001, [], 1), (3002, [], 0), (3100, [0.0] * 20, 1), (3200, [1e6] * 20, 0)]
    out += [(4000, None, 1), (4100, [1.0] * 20, None), (4200, [float("nan")] * 20, 1), (4300, [None, 1.0] + [0.5] * 18, 1), (4400, [float("inf")] * 20, 0), (None, [1.0] * 20, 1)]
    df = spark.createDataFrame(out, SCHEMA).repartition(3)
    return df.withColumns({"dim": F.lit("x"), "values": F.lit(1), "SHARD": F.lit(2), "anchor": F.lit(None).cast("string")}).cache()


def brute(rows):
    taken = []
    for r in rows.select("vec_id", "embedding", "label").collect():
        if r["vec_id"] is None or r["label"] is None or r["embedding"] is None or any(x is None or not np.isfinite(x) for x in r["embedding"]):
            continue
        v = tuple(max(min(int(np.floor(256 * float(x))), negatives.LIMIT), -negatives.LIMIT) for x in r["embedding"])
        taken.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], v))
    out = []
    for i, label, v in sorted({t for t in taken if t[0] % 100 == 0}):
        scored = sorted((-sum(map(int.__mul__, v, w)), j, other) for j, other, w in taken if j != i and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(s, j) for s, j, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, pid, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_values", [negatives.SHARD_VALUES, 2000])
def test_same_rows_as_brute_force(rows, monkeypatch, shard_values):
    monkeypatch.setattr(negatives, "SHARD_VALUES", shard_values)
    want = brute(rows)
    assert len(want) > 100
    assert sorted(map(tuple, negatives.op12_hard_negatives(rows).collect())) == want


def test_fewer_rows_than_asked_for_and_none(rows):
    few = rows.filter("vec_id in (0, 3, 6, 9) or vec_id between 1000 and 1003")
    assert sorted(map(tuple, negatives.op12_hard_negatives(few).collect())) == brute(few)
    assert negatives.op12_hard_negatives(rows.limit(0)).collect() == []


@pytest.mark.parametrize("dim", [1, 7, 64, 200])
def test_intervals_are_certain_and_leave_rows_out(dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim)) * 90
    values = np.floor(centres[rng.integers(0, 6, 3000)] + rng.normal(size=(3000, dim)) * 25).astype(np.int64)
    code, norms, along = negatives.encoded(values)
    frame = pd.DataFrame({"dim": dim, "vec_id": range(3000), "label": 0, "ints": [v.tobytes() for v in values.astype("<i4")], "code": [c.tobytes() for c in code], "norms": [x.tobytes() for x in norms], "along": [x.tobytes() for x in along]})
    codes = negatives.Codes(frame)
    scored = []
    for k in range(0, 3000, 100):
        truth = values @ values[k]

        def certain(low, high, truth=truth):
            assert (low <= truth).all() and (truth <= high).all()
            return np.ones(len(low), bool)

        assert len(codes.narrowed(values[k], np.arange(3000), certain)) == 3000
        scored.append(len(codes.narrowed(values[k], np.arange(3000), lambda low, high: high >= np.partition(low, -6)[-6])) / 3000)
    assert np.mean(scored) < 0.25  # how much depends on the data; results never do
