import math
import random
from collections import Counter

from ledgerloom.sources import delimited, layout

SCHEMA = "path string, page int, page_height double, x double, y double, width double, height double, text string"


def placed(path, page, y, *runs):
    return [(path, page, 800.0, float(x), float(y), float(w), 10.0, t) for x, w, t in runs]


def statement():
    rows = []
    for page in (1, 2):
        rows += placed("f", page, 20, (40, 200, f"Bank of the Lake page {page}"))
        rows += placed("f", page, 150, (40, 430, "An address that runs across all of the columns"))
        rows += placed("f", page, 200, (40, 25, "Date"), (120, 30, "Label"), (420, 30, "Sum"))
        rows += placed("f", page, 214, (40, 20, "op."), (120, 40, "of it"))
        for k in range(6):
            y = 230 + 30 * k
            # a word in two runs, a baseline that drifts by a point, sums of different widths
            rows += placed("f", page, y, (40, 50, f"0{k + 1}/0{page}/2026"), (120, 30, "CARRE")) + placed("f", page, y + 1, (150, 25, "FOUR"), (180, 20, str(k)), (450 - 10 * (k % 3) - 20, 10 * (k % 3) + 20, f"{k},50"))
            if k == 2:
                rows += placed("f", page, y + 14, (120, 80, "wrapped on"))
        rows += placed("f", page, 412, (120, 90, "Total of it"), (410, 40, "15,00"))
        rows += placed("f", page, 790, (40, 60, f"Page {page}/2"))
    return rows


def test_a_table_is_found_among_furniture(spark):
    got = [r["cells"] for r in layout.read_layout(spark.createDataFrame(statement(), SCHEMA)).orderBy("pos").collect()]
    body = [[f"0{k + 1}/0{page}/2026", f"CARREFOUR {k}" + (" wrapped on" if k == 2 else ""), f"{k},50"] for page in (1, 2) for k in range(6)]
    head = ["Date op.", "Label of it", "Sum"]
    assert got == [head, *body[:6], head, *body[6:]]


def test_rows_go_on_to_mappings(spark):
    rows = layout.read_layout(spark.createDataFrame(statement(), SCHEMA))
    read = delimited.records(rows, 0).filter("record['Sum'] <> 'Sum'").collect()
    assert len(read) == 12 and {r["record"]["Date op."] for r in read} >= {"01/01/2026", "06/02/2026"}


def test_pages_without_amounts_give_all_lines(spark):
    rows = placed("g", 1, 300, (40, 30, "a"), (200, 30, "b")) + placed("g", 1, 330, (40, 30, "c"), (200, 30, "d")) + placed("g", 1, 360, (200, 30, "e")) + placed("g", 1, 380, (0, 0, " "))
    got = [r["cells"] for r in layout.read_layout(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()]
    assert got == [["a", "b"], ["c", "d e"]]
    assert layout.read_layout(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gutters_are_those_of_single_bins(spark):
    """Against a count of each bin, on random lines with runs that overlap, touch, and have no or a negative width; rows do not grow with a line's width."""
    rng = random.Random(5)
    files = {f"f{k}": [[(rng.choice((0, 30, 60, 61, 90)) + rng.random() * rng.choice((0, 9)), rng.choice((-3.0, 0.0, 4.5, 20.0, 29.0))) for _ in range(rng.randrange(1, 6))] for _ in range(rng.randrange(1, 30))] for k in range(60)}
    rows = [(p, [(0.0, x, "t", w, 10.0, 10.0) for x, w in runs]) for p, held in files.items() for runs in held]
    df = spark.createDataFrame(rows, "path string, items array<struct<y:double,x:double,text:string,width:double,height:double,tall:double>>")
    got = {r["path"]: r["cuts"] for r in layout.gutters(df).collect()}
    want = {}
    for p, held in files.items():
        ink = Counter()
        for runs in held:
            ink.update({b for x, w in runs for lo, hi in [sorted((max(0, math.floor(x)), max(0, math.ceil(x + w))))] for b in range(lo, hi + 1)})
        busy = sorted(b for b, n in ink.items() if n > max(1, math.floor(len(held) * layout.TOLERANCE)))
        cuts = [(a + 1 + b) / 2 for a, b in zip(busy, busy[1:]) if b - a - 1 >= layout.GUTTER]
        if cuts:
            want[p] = cuts
    assert got == want and len(want) > 10
    wide = spark.createDataFrame([(f"w{k}", [(0.0, 0.0, "t", 1e6, 10.0, 10.0)]) for k in range(2000)], df.schema)
    assert layout.gutters(wide).count() == 0
