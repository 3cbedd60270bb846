"""Rows, lines and runs out of positioned text: gap-and-island windows, ordered by place."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_islands(df: DataFrame, keys: list[str], value: str, tolerance: float, *ties: str, name: str = "island") -> DataFrame:
    """A number for each run of rows whose value is at most tolerance above the row before."""
    order = Window.partitionBy(*keys).orderBy(value, *ties)
    new = F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stitch(runs: DataFrame, keys: list[str], y_tolerance: float = 1.0, space: float = 0.15, merge: float = 1.0) -> DataFrame:
    """Text runs of a line joined where the gap allows, with a space where it is wide.

    runs: keys, s, cy, x0 (left), x1 (right), fs. Gives keys, s, cx, cy and n of each joined run.
    """
    lines = gap_islands(runs, keys, "cy", y_tolerance, "x0", name="line")
    order = Window.partitionBy(*keys, "line").orderBy("x0", "cy", "s")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap, size = F.col("x0") - reach, F.coalesce(F.lag("fs").over(order), F.lit(10.0))
    rows = lines.withColumns({"_break": F.when(gap <= size * merge, 0).otherwise(1), "_space": F.coalesce(gap > size * space, F.lit(False)), "_at": F.row_number().over(order)})
    rows = rows.withColumn("run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when((F.col("_break") == 0) & F.col("_space"), F.concat(F.lit(" "), F.col("s"))).otherwise(F.col("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", piece.alias("p")))), lambda x: x["p"]), "")
    return rows.groupBy(*keys, "line", "run").agg(text.alias("s"), ((F.min("x0") + F.max("x1")) / 2).alias("cx"), F.min("cy").alias("cy"), F.count("*").alias("n"))


RUN = "struct<s:string,cy:double,left:double,right:double,fs:double,n:int>"


def folded(items: Column, breaks: Callable[[Column, Column], Column], spaced: Callable[[Column, Column], Column]) -> Column:
    """Items (an array of RUN in order) joined one after another: an item begins a new run where it breaks with the run so far, else
    it is put on, with a space where it is spaced. The run keeps place and size of its first item. For the items of an island, which are few.
    """

    def step(acc: Column, it: Column) -> Column:
        cur = F.element_at(acc, -1)
        grown = F.struct(
            F.concat(cur["s"], F.when(spaced(cur, it), " ").otherwise(""), it["s"]).alias("s"), cur["cy"].alias("cy"), cur["left"].alias("left"), F.greatest(cur["right"], it["right"]).alias("right"), cur["fs"].alias("fs"), (cur["n"] + 1).alias("n")
        )
        return F.when((F.size(acc) == 0) | breaks(cur, it), F.concat(acc, F.array(it))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    return F.aggregate(items, F.array().cast(f"array<{RUN}>"), lambda acc, it: F.when(F.size(acc) == 0, F.array(it)).otherwise(step(acc, it)))


def anchored_runs(runs: DataFrame, keys: list[str], y_tolerance: float = 1.0, space: float = 0.15, merge: float = 1.0) -> DataFrame:
    """Text runs joined as they come by height and then from the left, with a space where the gap is wide.

    runs: keys, s, cy, x0 (left), x1 (right), fs. Gives keys, line, run, s, cx, cy and n of each joined run. Runs go by place, those of
    one height from the left; each is held against the first of the run so far, so lines that drift come apart where they are too far
    from where they began. Rows further apart than the tolerance never meet: each island between is one walk, whose work grows with its length.
    """

    @F.pandas_udf("array<int>")
    def walked(cy: pd.Series, left: pd.Series, right: pd.Series, fs: pd.Series) -> pd.Series:
        """Twice the number of each item's run, and one more if a space goes before it."""
        out = []
        for ys, lefts, rights, sizes in zip(cy, left, right, fs, strict=True):
            run, codes, y, reach, size = -1, [], 0.0, 0.0, 0.0
            for at, begin, end, high in zip(ys.tolist(), lefts.tolist(), rights.tolist(), sizes.tolist(), strict=True):
                gap = begin - reach
                if run < 0 or abs(at - y) > y_tolerance or gap > size * merge:
                    run, y, reach, size = run + 1, at, end, high
                    codes.append(2 * run)
                else:
                    codes.append(2 * run + (gap > size * space))
                    reach = end if math.isnan(reach) else reach if math.isnan(end) else max(reach, end)
            out.append(codes)
        return pd.Series(out)

    lines = gap_islands(runs, keys, "cy", y_tolerance, "x0", name="line")
    item = F.struct("cy", "x0", "s", "x1", "fs")
    held = lines.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(item)).alias("items"))
    double = lambda c: F.col(f"items.{c}").cast("array<double>")
    size = F.transform(double("fs"), lambda v: F.when(v != 0, v).otherwise(10.0))
    coded = held.withColumn("codes", walked(double("cy"), double("x0"), double("x1"), size))
    rows = coded.select(*keys, "line", F.posexplode(F.arrays_zip("items", "codes")).alias("at", "i")).select(*keys, "line", "at", F.floor(F.col("i.codes") / 2).cast("int").alias("run"), "i.items.*", (F.col("i.codes") % 2 == 1).alias("_spaced"))
    piece = F.struct("at", F.concat(F.when(F.col("_spaced"), " ").otherwise(""), "s").alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["p"]), "")
    cx = (F.min_by("x0", "at") + F.max("x1")) / 2
    return rows.groupBy(*keys, "line", "run").agg(text.alias("s"), cx.alias("cx"), F.min_by("cy", "at").alias("cy"), F.count("*").alias("n"))


def normalise(items: DataFrame, keys: list[str]) -> DataFrame:
    """Places scaled to the page's own extent, downward, four digits."""
    page = Window.partitionBy(*keys)
    wide = F.greatest(F.max("x").over(page) - F.min("x").over(page), F.lit(1e-9))
    high = F.greatest(F.max("y").over(page) - F.min("y").over(page), F.lit(1e-9))
    return items.withColumns({"cx_norm": F.floor((F.col("x") - F.min("x").over(page)) / wide * 1e4 + 0.5) / 1e4, "cy_norm": F.floor((F.max("y").over(page) - F.col("y")) / high * 1e4 + 0.5) / 1e4})


def span_matches(tokens: DataFrame, keys: list[str], label: str, longest: int = 4) -> DataFrame:
    """Where neighbouring tokens, joined by blanks, spell label: keys, seq of the first, x (mean) and n_tokens."""
    order = Window.partitionBy(*keys).orderBy("seq")
    out = tokens.withColumns({"_s": F.collect_list("str").over(order.rowsBetween(0, longest - 1)), "_x": F.collect_list("x").over(order.rowsBetween(0, longest - 1))})
    hit = F.filter(F.sequence(F.lit(1), F.size("_s")), lambda n: F.array_join(F.slice("_s", 1, n), " ") == label)
    out = out.withColumn("n_tokens", F.get(hit, 0)).where("n_tokens is not null")
    mean = F.aggregate(F.slice("_x", 1, F.col("n_tokens")), F.lit(0.0), lambda a, x: a + x) / F.col("n_tokens")
    return out.withColumn("x", mean).drop("_s", "_x")


def numbered(df: DataFrame, keys: list[str], prefix: str, *order: Column | str) -> DataFrame:
    """A label such as S01 by order within keys."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("label", F.concat(F.lit(prefix), F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), "0")))


def polyline(points: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """points (x, y) with the length of their segment and the running length."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def split_notes(texts: DataFrame, text: str = "text") -> DataFrame:
    """The numbered notes of each text: ref, note. A number starts a note only if it follows the one before.

    "ANSI 569. MAXIMUM" looks like a start; as 569 is not the next number, it is none.
    """
    flat = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), flat), F.lit(r"\s(\d{1,3})\.\s+(?=[A-Z])"), 1)
    bodies = F.split(F.concat(F.lit(" "), flat), r"\s\d{1,3}\.\s+(?=[A-Z])")
    marks = F.transform(pieces, lambda n, i: F.struct(n.cast("int").alias("n"), F.get(bodies, i + 1).alias("body")))

    def step(acc: Column, m: Column) -> Column:
        last = F.element_at(acc, -1)
        start = F.when(F.size(acc) == 0, m["n"] <= 99).otherwise(m["n"] == last["n"] + 1)
        joined = F.struct(last["n"].alias("n"), F.concat(last["body"], F.lit(" "), m["n"].cast("string"), F.lit(". "), m["body"]).alias("body"))
        put = F.concat(acc, F.array(m))
        swap = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))
        return F.when(start, put).when(F.size(acc) == 0, acc).otherwise(swap)

    notes = F.aggregate(marks, F.array().cast("array<struct<n:int,body:string>>"), step)
    return texts.withColumn("_note", F.explode(notes)).withColumns({"ref": F.col("_note.n"), "note": F.trim("_note.body")}).drop("_note")
