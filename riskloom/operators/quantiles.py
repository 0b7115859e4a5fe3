"""Exact quantiles without a whole-column buffer, in two scans.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, which does not survive a column of 10^12 doubles.  The
quantile at p (linear interpolation, as pandas/numpy/DuckDB ``quantile_cont``)
needs the order statistics at ranks floor(h) and ceil(h), h = (n - 1) p.

* Scan 1: count, min, max and a mergeable rank sketch (``percentile_approx``)
  of every (column, group); the sketch's values a few error bounds to both
  sides of p bracket the ranks.
* Scan 2: rows inside a bracket are counted by value, rows below it as one sum
  (partial aggregates: only the brackets' distinct values, a fraction of about
  ``8 / ACCURACY`` of the rows, are shuffled).  They are written as a table.
* The ranks are then looked up in that table: by a window per bracket while
  brackets are small, by histogram refinement of the table when they are not.

A bracket that misses its rank (the sketch only promises its error) is found
out by its exact counts and refined on the input itself, as every target was
before there was a sketch: bins of equal width, the bin with the rank, and so
on until one value is left.  Only per-target summaries reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, drop_scratch

BINS = 4096
MAX_PASSES = 64
ACCURACY = 10_000         # of the sketch: rank error 1 / ACCURACY of the rows
WINDOW_ROWS = 1_000_000   # distinct values of a bracket that one window sorts


def _long(df: DataFrame, columns: Sequence[str], by: str | None) -> DataFrame:
    g = F.col(by).cast("string") if by else F.lit("")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x"))
                                for c in columns])).alias("_cell")
    return (df.select(g.alias("_g"), cells).select("_g", "_cell.c", "_cell.x")
            .where(F.col("x").isNotNull() & ~F.isnan("x")))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    by: str | None = None, bins: int = BINS) -> dict:
    """{(group, column): [q(p) for p in probs]} (group '' when ``by`` is None).

    Empty groups give ``None`` values.
    """
    long = _long(df, columns, by)
    around = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-4 / ACCURACY, 4 / ACCURACY)]
    stats = long.groupBy("_g", "c").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"),
                                        F.percentile_approx("x", around, ACCURACY).alias("q")).collect()
    targets: dict = {}      # (group, column, rank) -> bracket, rows below it, value
    wanted: dict = {}
    for r in stats:
        n = int(r["n"])
        hs = [(n - 1) * p for p in probs]
        wanted[(r["_g"], r["c"])] = (n, hs)
        for i, h in enumerate(hs):
            for k in (math.floor(h), math.ceil(h)):
                # the sketch brackets, but for the ends of the order, and where its error is less than a few rows
                lo = r["mn"] if n <= ACCURACY or probs[i] <= 4 / ACCURACY else r["q"][2 * i]
                hi = r["mx"] if n <= ACCURACY or probs[i] >= 1 - 4 / ACCURACY else r["q"][2 * i + 1]
                targets.setdefault((r["_g"], r["c"], k), {"lo": lo, "hi": hi, "below": 0, "value": None, "whole": (r["mn"], r["mx"])})
    _by_brackets(long, targets, bins)
    for s in targets.values():
        if s["value"] is None:      # the bracket missed: the whole range, on the input
            s["lo"], s["hi"], s["below"] = *s["whole"], 0
    _refine(long.withColumn("w", F.lit(1).cast("long")), targets, bins)
    out = {}
    for key, (n, hs) in wanted.items():
        vals = []
        for h in hs:
            a = targets[(*key, math.floor(h))]["value"]
            b = targets[(*key, math.ceil(h))]["value"]
            vals.append(None if a is None else a + (b - a) * (h - math.floor(h)))
        out[key] = vals
    return out


def _by_brackets(long: DataFrame, targets: dict, bins: int) -> None:
    """Values of all targets whose bracket holds their rank, from one scan."""
    spark = long.sparkSession
    ivals: dict = {}
    for (g, c, _), s in targets.items():
        ivals.setdefault((g, c, s["lo"], s["hi"]), len(ivals))
    if not ivals:
        return
    spec = [(g, c, i, lo, hi) for (g, c, lo, hi), i in ivals.items()]
    # <= (groups x columns x probs) rows: a bounded broadcast
    brackets = F.broadcast(spark.createDataFrame(spec, "_g string, c string, iid int, lo double, hi double"))
    inside = (long.join(brackets, ["_g", "c"]).where(F.col("x") <= F.col("hi"))
              .groupBy("iid", F.when(F.col("x") >= F.col("lo"), F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("w")))
    table = cut_lineage(inside, "brackets")
    sizes = {r["iid"]: r for r in table.groupBy("iid").agg(
        F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("w"))), F.lit(0)).alias("below"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("w"))), F.lit(0)).alias("inside"), F.count("x").alias("values")).collect()}
    held = {}
    for (g, c, k), s in targets.items():
        i = ivals[(g, c, s["lo"], s["hi"])]
        if i in sizes and sizes[i]["below"] <= k < sizes[i]["below"] + sizes[i]["inside"]:
            held[(g, c, k)] = i
    table = table.where(F.col("x").isNotNull())
    if max((sizes[i]["values"] for i in held.values()), default=0) <= WINDOW_ROWS:
        ranks = spark.createDataFrame([(i, g, c, k, k - int(sizes[i]["below"])) for (g, c, k), i in held.items()], "tid int, g string, c string, k long, r long")
        before = Window.partitionBy("iid").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = table.withColumn("_to", F.sum("w").over(before)).withColumn("_from", F.col("_to") - F.col("w"))
        hit = sums.join(F.broadcast(ranks), F.col("iid") == F.col("tid")).where((F.col("r") >= F.col("_from")) & (F.col("r") < F.col("_to")))
        for r in hit.select("g", "c", "k", "x").collect():      # one row per target
            targets[(r["g"], r["c"], r["k"])]["value"] = r["x"]
    else:
        for t, i in held.items():
            targets[t]["below"] = int(sizes[i]["below"])
        names = spark.createDataFrame([(i, g, c) for (g, c, _, _), i in ivals.items()], "iid int, _g string, c string")
        for i in set(held.values()):    # a bracket's targets, on its own values
            own = {t: targets[t] for t, j in held.items() if j == i}
            _refine(table.where(F.col("iid") == i).join(F.broadcast(names), "iid"), own, bins)
    drop_scratch(table)


def _refine(long: DataFrame, targets: dict, bins: int) -> None:
    """Histogram refinement of the open targets on (_g, c, x, w)."""
    for _ in range(MAX_PASSES):
        open_t = {t: s for t, s in targets.items() if s["value"] is None}
        for t, s in open_t.items():
            if s["lo"] == s["hi"]:
                s["value"] = s["lo"]
        open_t = {t: s for t, s in open_t.items() if s["value"] is None}
        if not open_t:
            break
        # targets sharing an interval (all ranks of a column on the first pass)
        # share one histogram: each row is binned once per distinct interval
        ivals = {}
        for (g, c, k), s in open_t.items():
            ivals.setdefault((g, c, s["lo"], s["hi"]), len(ivals))
        ispec = [(g, c, i, lo, hi) for (g, c, lo, hi), i in ivals.items()]
        tspec = [(ivals[(g, c, s["lo"], s["hi"])], g, c, k, s["below"]) for (g, c, k), s in open_t.items()]
        spark = long.sparkSession
        idf = spark.createDataFrame(ispec, "_g string, c string, iid int, lo double, hi double").withColumnRenamed("iid", "_iid")
        tdf = spark.createDataFrame(tspec, "_iid int, tg string, tc string, k long, below long")
        # <= (groups x columns x 2 x probs) rows each: bounded broadcasts
        j = long.join(F.broadcast(idf), ["_g", "c"]).where(
            (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
        b = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
        hist = (j.groupBy("_iid", b.alias("b"))
                .agg(F.sum("w").alias("n"), F.min("x").alias("bmn"), F.max("x").alias("bmx")))
        # the bin holding rank k: a running count over <= bins rows per target
        per_t = hist.join(F.broadcast(tdf), "_iid")
        before = Window.partitionBy("_iid", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        cum = F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0))
        hit = (per_t.withColumn("_cum", cum)
               .where((F.col("_cum") <= F.col("k")) & (F.col("k") < F.col("_cum") + F.col("n")))
               .select("tg", "tc", "k", "_cum", "bmn", "bmx").collect())  # one row per target
        for r in hit:
            s = open_t[(r["tg"], r["tc"], r["k"])]
            s["lo"], s["hi"], s["below"] = r["bmn"], r["bmx"], int(r["_cum"])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict:
    q = exact_quantiles(df, columns, [0.5])
    return {c: q.get(("", c), [None])[0] for c in columns}
