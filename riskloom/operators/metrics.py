"""Ranking metrics, confusion-based metrics and threshold search.

Everything starts from ``score_counts``: one row per *distinct* score with
its positive/negative counts (a partial aggregate, so duplicated scores cost
nothing extra).  Curves need cumulative counts in descending score order.
A global ``Window.orderBy(score)`` would put every distinct score into one
task, so the cumulative sums are computed in two levels:

1. distinct scores are cut into ``B`` equal-count buckets whose edges come
   from ``percentile_approx`` over the distinct scores; ``Bucketizer``
   assigns buckets by binary search inside the JVM;
2. bucket totals (``B`` rows) get suffix sums on a tiny table, are
   broadcast back (``B`` is a bounded parameter) and added to a running sum
   inside each bucket's own window partition.

Area under ROC (ties count one half), step-wise average precision, the
PR/ROC point tables, the arg-max threshold searches and the fixed-grid
searches are aggregates over that prefix table.  Driver fetches are one-row
totals and the (bounded) bucket edges, never row-level data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, drop_scratch

F1_EPS = 1e-10
_TARGET_SCORES_PER_BUCKET = 50_000
_MAX_BUCKETS = 65_536


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """num / den as double, 0 when den is 0 (zero_division=0)."""
    return F.when(den != 0, _d(num) / _d(den)).otherwise(F.lit(0.0))


# ----------------------------------------------------------- confusion -----

def confusion(df: DataFrame, label: str = "label", score: str = "fraud_probability",
              threshold: float = 0.5, pred: str | None = None) -> DataFrame:
    """tn, fp, fn, tp (always all four, also for one-class input) in one pass.

    Prediction is ``score >= threshold`` unless a 0/1 ``pred`` column is given.
    """
    y = F.col(label) == 1
    p = (F.col(pred) == 1) if pred else (F.col(score) >= F.lit(float(threshold)))
    cnt = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return df.agg(cnt(~y & ~p).alias("tn"), cnt(~y & p).alias("fp"),
                  cnt(y & ~p).alias("fn"), cnt(y & p).alias("tp"))


def basic_from_confusion(cm: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 (zero division -> 0)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return cm.select("*",
                     safe_div(tp + tn, n).alias("accuracy"),
                     safe_div(tp, tp + fp).alias("precision"),
                     safe_div(tp, tp + fn).alias("recall"),
                     safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def rates_from_confusion(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select("*", safe_div(tn, tn + fp).alias("specificity"),
                     safe_div(fp, fp + tn).alias("false_positive_rate"),
                     safe_div(fn, fn + tp).alias("false_negative_rate"))


def normalised_confusion(cm: DataFrame) -> DataFrame:
    """Row-normalised matrix and share-of-total, long form (actual, predicted)."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = cm.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"),
                 (F.col("tn") + F.col("fp") if a == 0 else F.col("fn") + F.col("tp")).alias("row_n"),
                 (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("all_n"))
        for a, p, c in cells])).alias("x")).select("x.*")
    return rows.select("actual", "predicted", "n", safe_div(F.col("n"), F.col("row_n")).alias("row_share"),
                       safe_div(F.col("n"), F.col("all_n")).alias("total_share"))


def classification_report(cm: DataFrame, names=("Normal", "Fraud")) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    # class 0 seen as positive: tp0 = tn, fp0 = fn, fn0 = fp
    p0, r0 = safe_div(tn, tn + fn), safe_div(tn, tn + fp)
    p1, r1 = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    f0, f1 = safe_div(2 * tn, 2 * tn + fn + fp), safe_div(2 * tp, 2 * tp + fp + fn)
    s0, s1 = tn + fp, fn + tp
    wavg = lambda a, b: safe_div(_d(a) * _d(s0) + _d(b) * _d(s1), n)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("class_name"), _d(p).alias("precision"),
                                            _d(r).alias("recall"), _d(f).alias("f1_score"),
                                            s.cast("bigint").alias("support"))
    acc = safe_div(tp + tn, n)
    rows = [row(names[0], p0, r0, f0, s0), row(names[1], p1, r1, f1, s1),
            row("accuracy", F.lit(None), F.lit(None), acc, n),
            row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            row("weighted avg", wavg(p0, p1), wavg(r0, r1), wavg(f0, f1), n)]
    return cm.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


# ------------------------------------------------------- prefix table ------

def score_counts(df: DataFrame, label: str = "label", score: str = "fraud_probability") -> DataFrame:
    """(score, pos, neg) per distinct non-NULL score."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint")
    return (df.where(F.col(score).isNotNull())
            .groupBy(_d(score).alias("score"))
            .agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg")))


@dataclass(frozen=True)
class Totals:
    P: int
    N: int
    n_scores: int
    max_score: float | None
    pos_at_max: int
    neg_at_max: int


def totals(counts: DataFrame) -> Totals:
    """One-row summary of the distinct-score table (bounded driver fetch)."""
    r = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.count(F.lit(1)).alias("k"),
                   F.max("score").alias("mx"),
                   F.max_by(F.struct("pos", "neg"), "score").alias("at")).first()
    at = r["at"]
    return Totals(int(r["P"] or 0), int(r["N"] or 0), int(r["k"]), r["mx"],
                  int(at["pos"]) if at else 0, int(at["neg"]) if at else 0)


def n_buckets_for(n_scores: int) -> int:
    return max(1, min(_MAX_BUCKETS, math.ceil(n_scores / _TARGET_SCORES_PER_BUCKET)))


def _bucketize(counts: DataFrame, buckets: int) -> DataFrame:
    if buckets <= 1:
        return counts.withColumn("_bkt", F.lit(0.0))
    probs = [i / buckets for i in range(1, buckets)]
    edges = counts.agg(F.percentile_approx("score", probs, 10_000).alias("e")).first()["e"] or []
    splits = [-math.inf] + sorted({float(e) for e in edges}) + [math.inf]
    return Bucketizer(splits=splits, inputCol="score", outputCol="_bkt").transform(counts)


def prefix_desc(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Adds ``tp``/``fp``: positives/negatives with score >= this score.

    Two-level cumulative sum (module doc); ``buckets`` defaults to about
    one bucket per 50k distinct scores.
    """
    if buckets is None:
        buckets = n_buckets_for(counts.count())
    b = _bucketize(counts, buckets)
    tot = b.groupBy("_bkt").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    # suffix sums over <= buckets rows: the only unpartitioned window, on a tiny table
    later = Window.orderBy(F.desc("_bkt")).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_bkt", F.coalesce(F.sum("_bp").over(later), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(later), F.lit(0)).alias("_on"))
    inb = Window.partitionBy("_bkt").orderBy(F.desc("score")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = b.join(F.broadcast(off), "_bkt")
    return out.select("score", "pos", "neg",
                      (F.sum("pos").over(inb) + F.col("_op")).cast("bigint").alias("tp"),
                      (F.sum("neg").over(inb) + F.col("_on")).cast("bigint").alias("fp"))


@dataclass
class ScoreCurve:
    """Distinct-score prefix table plus its totals."""
    points: DataFrame
    totals: Totals

    @classmethod
    def of(cls, df: DataFrame, label: str = "label", score: str = "fraud_probability",
           buckets: int | None = None, persist: bool = True) -> "ScoreCurve":
        # the distinct-score table is read three times (totals, edges, prefix)
        counts = cut_lineage(score_counts(df, label, score), "scores")
        t = totals(counts)
        pts = prefix_desc(counts, buckets if buckets is not None else n_buckets_for(t.n_scores))
        if persist:     # several curves and searches read it
            pts = cut_lineage(pts, "curve")
            drop_scratch(counts)
        return cls(pts, t)

    def release(self) -> None:
        """Delete the prefix table, once its results have been taken."""
        drop_scratch(self.points)

    # -- areas -------------------------------------------------------------
    def roc_auc(self) -> DataFrame:
        """Sum over scores of pos * (negatives below + negatives tied / 2) / (P N)."""
        P, N = self.totals.P, self.totals.N
        s = F.sum(_d("pos") * (F.lit(float(N)) - _d("fp") + _d("neg") / 2.0))
        auc = F.when(F.lit(P * N) > 0, s / F.lit(float(P) * float(N)))
        return self.points.agg(auc.alias("roc_auc"))

    def average_precision(self) -> DataFrame:
        """Sum over scores of (recall step) * precision at that score."""
        P = self.totals.P
        s = F.sum(_d("pos") * _d("tp") / (_d("tp") + _d("fp")))
        ap = F.when(F.lit(P) > 0, s / F.lit(float(P)))
        return self.points.agg(ap.alias("average_precision"))

    # -- point tables ------------------------------------------------------
    def roc_points(self) -> DataFrame:
        """(threshold, fpr, tpr) per distinct score plus the origin (NULL threshold)."""
        P, N = float(self.totals.P), float(self.totals.N)
        tpr = F.col("tp") / F.lit(P) if P else F.lit(0.0)
        fpr = F.col("fp") / F.lit(N) if N else F.lit(0.0)
        pts = self.points.select(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
        origin = self.points.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
        return pts.unionByName(origin)

    def pr_points(self, with_end: bool = True) -> DataFrame:
        """(threshold, precision, recall, key) ascending threshold; end point (1, 0)."""
        P = float(self.totals.P)
        prec = _d("tp") / (_d("tp") + _d("fp"))
        rec = (_d("tp") / F.lit(P)) if P else F.lit(1.0)
        pts = self.points.select(F.col("score").alias("threshold"), prec.alias("precision"),
                                 rec.alias("recall"), F.col("score").alias("_key"),
                                 F.col("tp"), F.col("fp"))
        if not with_end:
            return pts
        t = self.totals
        end = self.points.sparkSession.range(1).select(
            F.lit(t.max_score).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
            F.lit(0.0).alias("recall"), F.lit(math.inf).alias("_key"),
            F.lit(t.pos_at_max).cast("bigint").alias("tp"), F.lit(t.neg_at_max).cast("bigint").alias("fp"))
        return pts.unionByName(end)

    # -- threshold search --------------------------------------------------
    def argmax_threshold(self, metric: str = "f1", min_recall: float | None = None) -> DataFrame:
        """First (ascending threshold) point maximising f1 / precision / recall.

        With ``min_recall`` the f1 search is restricted to points with
        recall >= min_recall when any exists, else unrestricted.  The end
        point maps to the largest score.  Returns the curve values at the
        point and the metrics recomputed for ``score >= threshold``.
        """
        pr = self.pr_points()
        f1 = 2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall") + F1_EPS)
        pr = pr.withColumn("f1", f1)
        if metric not in ("f1", "precision", "recall"):
            raise ValueError(f"Unknown metric: {metric}")
        ok = (F.col("recall") >= F.lit(float(min_recall))).cast("int") if (
            min_recall is not None and metric == "f1") else F.lit(0)
        order = F.struct(ok.alias("ok"), F.col(metric).alias("m"), (-F.col("_key")).alias("k"))
        best = pr.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1", "tp", "fp"),
                               order).alias("b")).select("b.*")
        P, N = self.totals.P, self.totals.N
        tp, fp = F.col("tp"), F.col("fp")
        fn, tn = F.lit(P) - tp, F.lit(N) - fp
        return best.select(
            F.col("threshold"), F.col("precision").alias("curve_precision"),
            F.col("recall").alias("curve_recall"), F.col("f1").alias("curve_f1"),
            safe_div(tp + tn, F.lit(P + N)).alias("accuracy"),
            safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"),
            safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_score"))


def grouped_auc(df: DataFrame, group: str, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """(group, roc_auc) for each value of ``group`` (few: rounds, folds), with
    the same two levels as ``prefix_desc`` inside every group: equal-count
    buckets of its distinct scores, a window per (group, bucket), and bucket
    offsets from at most ``buckets`` rows a group.  NULL with one class only."""
    y = F.col(label) == 1
    counts = cut_lineage(df.where(F.col(score).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(score).cast("double").alias("_s")).agg(
        F.sum(y.cast("long")).alias("pos"), F.sum((~y).cast("long")).alias("neg")), "counts")
    if buckets is None:
        largest = counts.groupBy("_g").count().agg(F.max("count")).first()[0]
        buckets = n_buckets_for(largest or 0)
    probs = [i / buckets for i in range(1, buckets)] or [0.5]
    # one row of edges per group
    edges = F.broadcast(counts.groupBy(F.col("_g").alias("_eg")).agg(
        F.array_distinct(F.percentile_approx("_s", probs, 20 * max(buckets, 500))).alias("_e"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N")))
    b = counts.join(edges, F.col("_g") == F.col("_eg")).withColumn("_bkt", F.size(F.filter("_e", lambda e: e <= F.col("_s"))))
    tot = b.groupBy(F.col("_g").alias("_tg"), F.col("_bkt").alias("_tb")).agg(F.sum("neg").alias("_bn"))
    later = Window.partitionBy("_tg").orderBy(F.desc("_tb")).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_tg", "_tb", F.coalesce(F.sum("_bn").over(later), F.lit(0)).alias("_on"))
    inb = Window.partitionBy("_g", "_bkt").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = b.join(off, (F.col("_g") == F.col("_tg")) & (F.col("_bkt") == F.col("_tb"))).withColumn("fp", F.sum("neg").over(inb) + F.col("_on"))
    area = F.sum(_d("pos") * (_d("_N") - _d("fp") + _d("neg") / 2.0))
    both = F.first("_P") * F.first("_N")
    return rows.groupBy(F.col("_g").alias(group)).agg(F.when(both > 0, area / _d(both)).alias("roc_auc"))


def auc_of_ranges(ranges: DataFrame, group: str, order: str = "range") -> DataFrame:
    """(group, roc_auc) from a few rows per group, one per range of scores
    (ascending by ``order``): ``pos`` and ``neg`` rows and the ``area`` of ordered
    pairs inside the range.  NULL with one class only."""
    lower = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("area") + _d("pos") * F.coalesce(_d(F.sum("neg").over(lower)), F.lit(0.0))
    both = _d(F.sum("pos")) * _d(F.sum("neg"))
    return ranges.withColumn("_pairs", pairs).groupBy(group).agg(F.when(both > 0, F.sum("_pairs") / both).alias("roc_auc"))


# -------------------------------------------------------- fixed grids ------

def arange_grid(start: float, stop: float, step: float) -> list[float]:
    """The exact doubles of numpy's arange (comparisons with tied scores depend on them)."""
    return [float(x) for x in np.arange(start, stop, step)]


def linspace_grid(start: float, stop: float, num: int) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, num)]


def grid_counts(df: DataFrame, grid: list[float], label: str = "label",
                score: str = "fraud_probability") -> DataFrame:
    """tp/fp/fn/tn at each grid threshold (``score >= t``), one pass.

    Each row gets ``j`` = index of the largest grid value <= its score (a
    ``Bucketizer`` binary search; -1 below the grid), counts are aggregated
    per ``j`` (<= len(grid)+1 groups) and suffix-summed on that tiny table.
    """
    g = sorted(grid)
    splits = [-math.inf] + g + [math.inf]
    spark = df.sparkSession
    rows = Bucketizer(splits=splits, inputCol="_s", outputCol="_i").transform(
        df.where(F.col(score).isNotNull()).select(_d(score).alias("_s"), F.col(label).alias("_y")))
    agg = rows.groupBy((F.col("_i").cast("int") - 1).alias("j")).agg(
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("bigint").alias("_p"),
        F.sum(F.when(F.col("_y") == 1, 0).otherwise(1)).cast("bigint").alias("_n"))
    full = spark.range(-1, len(g)).select(F.col("id").cast("int").alias("j"))
    cnt = full.join(F.broadcast(agg), "j", "left").select(
        "j", F.coalesce("_p", F.lit(0)).alias("_p"), F.coalesce("_n", F.lit(0)).alias("_n"))
    # windows over len(grid)+1 aggregated rows only
    suffix = Window.orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    thresholds = F.array(*[F.lit(float(t)) for t in g])
    out = cnt.select("j", F.sum("_p").over(suffix).alias("tp"), F.sum("_n").over(suffix).alias("fp"),
                     F.sum("_p").over(whole).alias("_P"), F.sum("_n").over(whole).alias("_N"))
    return out.where(F.col("j") >= 0).select(
        "j", F.element_at(thresholds, F.col("j") + 1).alias("threshold"),
        F.col("tp").cast("bigint").alias("tp"), F.col("fp").cast("bigint").alias("fp"),
        (F.col("_P") - F.col("tp")).cast("bigint").alias("fn"),
        (F.col("_N") - F.col("fp")).cast("bigint").alias("tn"))


def grid_metrics(gc: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return gc.select("j", "threshold",
                     safe_div(tp, tp + fp).alias("precision"), safe_div(tp, tp + fn).alias("recall"),
                     safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def grid_search_min_recall(gm: DataFrame, min_recall: float = 0.8,
                           default_threshold: float = 0.5) -> DataFrame:
    """Best F1 among grid points with recall >= min_recall (first wins);
    otherwise the first point with the highest recall; otherwise the default
    threshold with zero metrics."""
    ok = (F.col("recall") >= F.lit(float(min_recall))).cast("int")
    order = F.struct(ok.alias("ok"),
                     F.when(ok == 1, F.col("f1")).otherwise(F.col("recall")).alias("m"),
                     (-F.col("j")).alias("k"))
    best = gm.agg(F.max_by(F.struct("threshold", "f1", "recall", "precision"), order).alias("b"),
                  F.max("recall").alias("_mr")).select("b.*", "_mr")
    none = F.col("_mr") <= 0
    return best.select(
        F.when(none, F.lit(float(default_threshold))).otherwise(F.col("threshold")).alias("threshold"),
        F.when(none, F.lit(0.0)).otherwise(F.col("f1")).alias("f1"),
        F.when(none, F.lit(0.0)).otherwise(F.col("recall")).alias("recall"),
        F.when(none, F.lit(0.0)).otherwise(F.col("precision")).alias("precision"))
