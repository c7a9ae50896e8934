"""Pages of placed text read back as the table that they show.

Runs are rows (path, page, page_height, x, y, width, height, text), y growing down the page; rows come out as
(path, pos, cells), as from ``delimited.parse``, so that mappings and header rows work on them.  All of it is windows
and aggregates over a file's lines; a file is bounded by the upload limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import trimmed

#: Shares of a run's height: baselines of one line differ by less, and words are further apart.
SAME_LINE, SPACE = 0.6, 0.25
#: Points that a break between columns has at least, and the share of lines that may write into it.
GUTTER, TOLERANCE = 5, 0.08
#: The share of a page's height at its top and bottom where running heads stand.
MARGIN = 0.12
HEADINGS = 2
DATED = 0.7
PLAIN_HEIGHT = 10.0
AMOUNT = r"\d[\d\s  .']*[.,]\d{2}(?!\d)"


def _lines(runs: DataFrame) -> DataFrame:
    """(path, page, page_height, y, items, priced, nth) of each line: runs no further than a share of their height below the line's first.

    Runs further than that from the one before begin a line for sure; only stretches between such runs are
    walked through, so no page is held as one array.
    """
    order = Window.partitionBy("path", "page").orderBy("y", "x", "text")
    tall = F.when(F.col("height") > 0, F.col("height")).otherwise(PLAIN_HEIGHT)
    some = runs.filter(trimmed(F.col("text")) != "").withColumn("tall", tall)
    breaks = F.coalesce((F.col("y") - F.lag("y").over(order) > F.col("tall") * SAME_LINE).cast("int"), F.lit(1))
    cut = some.withColumn("breaks", breaks).withColumn("stretch", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    item = F.struct("y", "x", "text", "width", "height", "tall")
    held = cut.groupBy("path", "page", "stretch").agg(F.max("page_height").alias("page_height"), F.array_sort(F.collect_list(item)).alias("runs"))

    def walk(a: Column, r: Column) -> Column:
        fresh = a["top"].isNull() | (r["y"] - a["top"] > r["tall"] * SAME_LINE)
        return F.struct(F.when(fresh, r["y"]).otherwise(a["top"]).alias("top"), F.concat(a["tops"], F.array(F.when(fresh, r["y"]).otherwise(a["top"]))).alias("tops"))

    start = F.struct(F.lit(None).cast("double").alias("top"), F.array().cast("array<double>").alias("tops"))
    tops = F.aggregate("runs", start, walk, lambda a: a["tops"])
    each = held.select("path", "page", "page_height", F.explode(F.arrays_zip("runs", tops.alias("tops"))).alias("z")).select("path", "page", "page_height", F.col("z.tops").alias("top"), F.col("z.runs").alias("run"))
    lines = each.groupBy("path", "page", "top").agg(F.max("page_height").alias("page_height"), F.array_sort(F.collect_list("run")).alias("items"))
    priced = F.exists("items", lambda r: r["text"].rlike(AMOUNT))
    return lines.select("path", "page", "page_height", F.col("top").alias("y"), "items", priced.alias("priced"))


def _without_running_heads(lines: DataFrame) -> DataFrame:
    """Of lines without amounts in a margin that every page of a file repeats, numbers aside, the first alone stays."""
    band = F.col("page_height") * MARGIN
    furniture = ~F.col("priced") & ((F.col("y") <= band) | (F.col("y") >= F.col("page_height") - band))
    words = F.array_join(F.transform("items", lambda r: r["text"]), " ")
    shape = F.when(furniture, F.trim(F.regexp_replace(F.regexp_replace(words, r"\d+", "#"), r"\s+", " ")))
    alike = Window.partitionBy("path", "shape")
    distinct = lambda window: F.size(F.collect_set("page").over(window))
    told = lines.withColumn("shape", shape).withColumn("pages", distinct(Window.partitionBy("path"))).withColumn("on", distinct(alike)).withColumn("again", F.row_number().over(alike.orderBy("page", "y")))
    return told.filter("shape is null or pages < 2 or on < pages or again = 1").drop("shape", "pages", "on", "again")


def _tables(lines: DataFrame) -> DataFrame:
    """Lines of each page's table with ``headings``, how many lines of it are its heading, and ``found``, whether the file has a table at all.

    The table is the stretch of lines densest in amounts: each counts one with an amount and minus one without,
    and the first stretch of the greatest sum wins.  A stretch goes on while its sum is not negative, so its
    beginning is after the least sum of all lines so far, and its sum the rise from there.  Up to two lines of
    several runs above it are its heading.
    """
    page = Window.partitionBy("path", "page")
    order = page.orderBy("y")
    upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = lines.withColumn("nth", F.row_number().over(order)).withColumn("rise", F.sum(F.when(F.col("priced"), 1).otherwise(-1)).over(upto))
    zero = F.struct(F.lit(0).cast("long").alias("rise"), F.lit(0).alias("nth"))
    low = F.least(zero, F.coalesce(F.min(F.struct(F.col("rise").cast("long").alias("rise"), "nth")).over(before), zero))
    scored = numbered.withColumn("low", low).withColumn("best", F.max(F.struct((F.col("rise") - F.col("low.rise")).alias("sum"), (-F.col("nth")).alias("early"), (F.col("low.nth") + 1).alias("begin"))).over(page))
    title = ~F.col("priced") & (F.size("items") >= 2)
    above = lambda k: F.coalesce(F.max(F.when(F.col("nth") == F.col("best.begin") - k, title)).over(page), F.lit(False))
    headed = scored.withColumn("headings", F.when(above(1) & above(2), HEADINGS).when(above(1), 1).otherwise(0))
    inside = (F.col("best.sum") > 0) & F.col("nth").between(F.col("best.begin") - F.col("headings"), -F.col("best.early"))
    told = headed.withColumn("inside", inside).withColumn("found", F.max("inside").over(Window.partitionBy("path")))
    heading = F.col("inside") & (F.col("nth") < F.col("best.begin"))
    return told.filter("inside or not found").select("path", "page", "y", "items", heading.alias("heading"), "found")


def gutters(lines: DataFrame) -> DataFrame:
    """(path, cuts) of files of several columns: where these part, the middles of stripes of the page that hardly a line of the file writes into."""
    allowed = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("path")) * TOLERANCE))
    begin, end = (lambda r: F.greatest(F.lit(0), F.floor(r["x"])).cast("int")), (lambda r: F.greatest(F.lit(0), F.ceil(r["x"] + r["width"])).cast("int"))
    spans = F.array_sort(F.transform("items", lambda r: F.struct(F.least(begin(r), end(r)).alias("begin"), F.greatest(begin(r), end(r)).alias("end"))))

    def merge(spans_: Column, r: Column) -> Column:
        """A line writes once into what several of its runs cover; runs come by their beginning."""
        last, size = F.try_element_at(spans_, F.lit(-1)), F.size(spans_)
        joined = F.named_struct(F.lit("begin"), last["begin"], F.lit("end"), F.greatest(last["end"], r["end"]))
        return F.when(last["end"] >= r["begin"], F.concat(F.slice(spans_, 1, F.greatest(size - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(spans_, F.array(r)))

    merged = F.aggregate(spans, F.array().cast("array<struct<begin:int,end:int>>"), merge)
    turns = F.flatten(F.transform(merged, lambda r: F.array(F.named_struct(F.lit("bin"), r["begin"], F.lit("step"), F.lit(1)), F.named_struct(F.lit("bin"), r["end"] + 1, F.lit("step"), F.lit(-1)))))
    steps = lines.withColumn("allowed", allowed).select("path", "allowed", F.explode(turns).alias("t")).groupBy("path", F.col("t.bin").alias("bin")).agg(F.sum("t.step").alias("step"), F.first("allowed").alias("allowed"))
    order = Window.partitionBy("path").orderBy("bin")
    inked = steps.withColumns({"ink": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "next": F.lead("bin").over(order)}).filter("ink > allowed")
    return inked.withColumn("gap", F.lag("next").over(order)).filter(F.col("bin") - F.col("gap") >= GUTTER).groupBy("path").agg(F.array_sort(F.collect_list((F.col("gap") + F.col("bin")) / 2)).alias("cuts"))


def _joined(runs: Column) -> Column:
    """Runs from left to right as one text, with a blank where the page leaves one."""
    start = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("end"), F.lit(PLAIN_HEIGHT).alias("height"))

    def add(a: Column, r: Column) -> Column:
        height = F.when(r["height"] > 0, r["height"]).otherwise(a["height"])
        blank = F.when((a["text"] != "") & (r["x"] - a["end"] > height * SPACE), " ").otherwise("")
        return F.struct(F.concat(a["text"], blank, r["text"]).alias("text"), (r["x"] + r["width"]).alias("end"), height.alias("height"))

    text = F.aggregate(F.array_sort(runs, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0)), start, add, lambda a: a["text"])
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def _cells(items: Column, cuts: Column) -> Column:
    """A line's runs by the column in which their middle lies."""
    place = lambda r: F.size(F.filter(cuts, lambda c: r["x"] + r["width"] / 2 > c))
    return F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: _joined(F.filter(items, lambda r: place(r) == k)))


def _unwrapped(rows: DataFrame) -> DataFrame:
    """Join a row of one cell, not the first, to the row above, if that has two cells at least and this one among them; ``rows``: path, pos, cells.

    Such a row changes neither how many cells the row above has nor which, so all of a run of them look at the
    same row, and go on until one does not fit.
    """
    order = Window.partitionBy("path").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.filter(F.transform("cells", lambda c, i: F.when(c != "", i)), lambda i: i.isNotNull())
    told = rows.withColumn("filled", filled).withColumn("lone", (F.size("filled") == 1) & (F.get("filled", F.lit(0)) > 0))
    own = told.withColumn("anchor", F.last(F.when(~F.col("lone"), F.struct("pos", "filled")), ignorenulls=True).over(upto))
    fits = F.coalesce(F.col("lone") & (F.size("anchor.filled") >= 2) & F.array_contains("anchor.filled", F.get("filled", F.lit(0))), F.lit(False))
    since = Window.partitionBy("path", "anchor.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.col("lone") & F.min(F.when(F.col("lone"), F.col("fits"))).over(since)
    grouped = own.withColumn("fits", fits).withColumn("follows", follows).withColumn("row", F.sum((~F.col("follows")).cast("int")).over(upto))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cells"))), lambda x: x["cells"])
    merged = F.transform(F.get("all", F.lit(0)), lambda c, i: F.array_join(F.filter(F.transform("all", lambda cells: cells[i]), lambda v: v != ""), " "))
    return grouped.groupBy("path", "row").agg(lines.alias("all"), F.first("found").alias("found")).select("path", F.col("row").alias("pos"), merged.alias("cells"), "found")


def read_layout(runs: DataFrame) -> DataFrame:
    """(path, pos, cells) of the table of each file: lines, running heads, the densest block, columns, wrapped labels; rows without a first cell go where most have one.

    A file without amounts gives all its lines.  Files without a run give no row.
    """
    # all windows, groups and the join below are of a file or finer: one shuffle serves them
    chosen = _tables(_without_running_heads(_lines(runs.repartition("path"))))
    cuts = F.coalesce("cuts", F.array().cast("array<double>"))
    split = chosen.join(gutters(chosen), "path", "left").withColumn("cuts", cuts).select("path", "page", "y", "heading", "found", _cells(F.col("items"), F.col("cuts")).alias("cells"))
    # the lines of a page's heading are one row
    first = F.when(F.col("heading"), F.min("y").over(Window.partitionBy("path", "page"))).otherwise(F.col("y"))
    whole = split.withColumn("at", first).groupBy("path", "page", "at", "found").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "cells"))), lambda x: x["cells"]).alias("all"))
    merged = F.transform(F.get("all", F.lit(0)), lambda c, i: F.array_join(F.filter(F.transform("all", lambda cells: cells[i]), lambda v: v != ""), " "))
    rows = _unwrapped(whole.select("path", "found", F.row_number().over(Window.partitionBy("path").orderBy("page", "at")).alias("pos"), merged.alias("cells")))
    dated = F.avg((F.col("cells")[0] != "").cast("double")).over(Window.partitionBy("path"))
    kept = rows.withColumn("dated", dated).filter((F.col("cells")[0] != "") | ~F.col("found") | (F.col("dated") < DATED))
    return kept.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).alias("pos"), "cells")
