"""Registered queries: evaluation metrics and threshold searches over scored rows.

Two "models" are the deterministic score views ``scores`` (model_a) and
``scores2`` (model_b) of FIXTURES.md B4: heavy ties, real separation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import SWEEP_GRID, THRESHOLD_GRID
from riskloom.operators import metrics as M
from riskloom.plans.catalog import query, r6
from riskloom.plans.oracle import sql
from riskloom.sources import fixtures as X

MODELS = (("model_a", 31), ("model_b", 53))
GRID = M.arange_grid(*THRESHOLD_GRID)
SWEEP = M.linspace_grid(*SWEEP_GRID)


def _scores(spark, d, mult=31) -> DataFrame:
    return X.scores(spark, d, multiplier=mult)


# ---------------------------------------------------------- DuckDB parts --

def _prefix_sql(view="scores"):
    return {
        "c": f"""select fraud_probability as score, cast(sum(label) as bigint) as pos,
                        cast(count(*) - sum(label) as bigint) as neg from {view} group by 1""",
        "p": """select *, sum(pos) over w as tp, sum(neg) over w as fp from c
                window w as (order by score desc rows between unbounded preceding and current row)""",
        "t": "select sum(pos) as P, sum(neg) as N, max(score) as mx from c",
    }


def _cm_sql(view="scores", thr="0.5"):
    return f"""select
  cast(sum(case when label = 0 and fraud_probability < {thr} then 1 else 0 end) as bigint) as tn,
  cast(sum(case when label = 0 and fraud_probability >= {thr} then 1 else 0 end) as bigint) as fp,
  cast(sum(case when label = 1 and fraud_probability < {thr} then 1 else 0 end) as bigint) as fn,
  cast(sum(case when label = 1 and fraud_probability >= {thr} then 1 else 0 end) as bigint) as tp
from {view}"""


def _div(a, b):
    return f"(case when ({b}) <> 0 then cast({a} as double) / cast({b} as double) else 0.0 end)"


_BASIC = (f"{_div('tp + tn', 'tn + fp + fn + tp')} as accuracy, {_div('tp', 'tp + fp')} as precision, "
          f"{_div('tp', 'tp + fn')} as recall, {_div('2 * tp', '2 * tp + fp + fn')} as f1_score")
_RATES = (f"{_div('tn', 'tn + fp')} as specificity, {_div('fp', 'fp + tn')} as false_positive_rate, "
          f"{_div('fn', 'fn + tp')} as false_negative_rate")
_AUC = ("(select sum(cast(pos as double) * (cast(N as double) - cast(fp as double) + cast(neg as double) / 2.0))"
        " / (max(cast(P as double)) * max(cast(N as double))) from p, t)")
_AP = ("(select sum(cast(pos as double) * cast(tp as double) / cast(tp + fp as double)) / max(cast(P as double))"
       " from p, t)")


def _dbl_list(vals):
    return ", ".join(f"({i}, cast('{v!r}' as double))" for i, v in enumerate(vals))


# ------------------------------------------------------------- confusion --

@query("eval_confusion")
def eval_confusion(spark, d):
    return M.confusion(_scores(spark, d))


sql("eval_confusion", _cm_sql(), "scores")


@query("eval_basic")
def eval_basic(spark, d):
    return r6(M.basic_from_confusion(M.confusion(_scores(spark, d))).drop("tn", "fp", "fn", "tp"))


_BASIC_COLS = ("accuracy", "precision", "recall", "f1_score")
_RATE_COLS = ("specificity", "false_positive_rate", "false_negative_rate")


def _rnd(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


sql("eval_basic", f"select {_rnd(_BASIC_COLS)} from (select {_BASIC} from cm)", "scores",
    extra={"cm": _cm_sql()})


@query("eval_rates")
def eval_rates(spark, d):
    return r6(M.rates_from_confusion(M.confusion(_scores(spark, d))).drop("tn", "fp", "fn", "tp"))


sql("eval_rates", f"select {_rnd(_RATE_COLS)} from (select {_RATES} from cm)", "scores",
    extra={"cm": _cm_sql()})


@query("eval_confusion_normalised")
def eval_confusion_normalised(spark, d):
    return r6(M.normalised_confusion(M.confusion(_scores(spark, d))))


sql("eval_confusion_normalised", f"""
select actual, predicted, n, round({_div('n', 'row_n')}, 6) as row_share, round({_div('n', 'all_n')}, 6)
  as total_share from (
  select 0 as actual, 0 as predicted, tn as n, tn + fp as row_n, tn + fp + fn + tp as all_n from cm
  union all select 0, 1, fp, tn + fp, tn + fp + fn + tp from cm
  union all select 1, 0, fn, fn + tp, tn + fp + fn + tp from cm
  union all select 1, 1, tp, fn + tp, tn + fp + fn + tp from cm)""", "scores", extra={"cm": _cm_sql()})


@query("eval_report")
def eval_report(spark, d):
    return r6(M.classification_report(M.confusion(_scores(spark, d))))


_P0, _R0, _F0 = _div("tn", "tn + fn"), _div("tn", "tn + fp"), _div("2 * tn", "2 * tn + fn + fp")
_P1, _R1, _F1 = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn")
_N = "(tn + fp + fn + tp)"


def _w(a, b):
    return _div(f"{a} * cast(tn + fp as double) + {b} * cast(fn + tp as double)", _N)


sql("eval_report", f"""
select class_name, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1_score, 6) as f1_score, support from (
  select 'Normal' as class_name, {_P0} as precision, {_R0} as recall, {_F0} as f1_score,
         cast(tn + fp as bigint) as support from cm
  union all select 'Fraud', {_P1}, {_R1}, {_F1}, cast(fn + tp as bigint) from cm
  union all select 'accuracy', null, null, {_div('tp + tn', _N)}, cast({_N} as bigint) from cm
  union all select 'macro avg', ({_P0} + {_P1}) / 2, ({_R0} + {_R1}) / 2, ({_F0} + {_F1}) / 2,
                   cast({_N} as bigint) from cm
  union all select 'weighted avg', {_w(_P0, _P1)}, {_w(_R0, _R1)}, {_w(_F0, _F1)}, cast({_N} as bigint) from cm)""",
    "scores", extra={"cm": _cm_sql()})


@query("eval_pr_baseline")
def eval_pr_baseline(spark, d):
    return r6(_scores(spark, d).agg(F.avg(F.col("label").cast("double")).alias("positive_rate")))


sql("eval_pr_baseline", "select round(avg(cast(label as double)), 6) as positive_rate from scores", "scores")

# ---------------------------------------------------------------- curves --


def _curve(spark, d, mult=31, buckets=None):
    return M.ScoreCurve.of(_scores(spark, d, mult), buckets=buckets)


@query("eval_roc_auc")
def eval_roc_auc(spark, d):
    return r6(_curve(spark, d).roc_auc())


sql("eval_roc_auc", f"select round({_AUC}, 6) as roc_auc", "scores", extra=_prefix_sql())


@query("eval_average_precision")
def eval_average_precision(spark, d):
    return r6(_curve(spark, d).average_precision())


sql("eval_average_precision", f"select round({_AP}, 6) as average_precision", "scores", extra=_prefix_sql())


@query("eval_roc_points")
def eval_roc_points(spark, d):
    return r6(_curve(spark, d).roc_points())


sql("eval_roc_points", """
select score as threshold, round(cast(fp as double) / N, 6) as fpr, round(cast(tp as double) / P, 6) as tpr
from p, t union all select null, 0.0, 0.0""", "scores", extra=_prefix_sql())


@query("eval_pr_points")
def eval_pr_points(spark, d):
    return r6(_curve(spark, d).pr_points().select("threshold", "precision", "recall"))


_PR = """select score as threshold, cast(tp as double) / (tp + fp) as precision,
                cast(tp as double) / P as recall, score as k, tp, fp from p, t
         union all
         select mx, 1.0, 0.0, cast('inf' as double), (select pos from c where score = mx),
                (select neg from c where score = mx) from t"""
sql("eval_pr_points", "select threshold, round(precision, 6) as precision, round(recall, 6) as recall from pr",
    "scores", extra={**_prefix_sql(), "pr": _PR})


@query("win_pr_prefix")
def win_pr_prefix(spark, d):
    return _curve(spark, d).points


sql("win_pr_prefix", "select score, pos, neg, cast(tp as bigint) as tp, cast(fp as bigint) as fp from p",
    "scores", extra=_prefix_sql())


@query("win_roc_prefix")
def win_roc_prefix(spark, d):
    """Forced 16 score buckets: the two-level path on the test scale."""
    c = _curve(spark, d, buckets=16)
    P, N = float(c.totals.P), float(c.totals.N)
    return r6(c.points.select("score", "tp", "fp", (F.col("fp") / N).alias("fpr"),
                              (F.col("tp") / P).alias("tpr")))


sql("win_roc_prefix", """
select score, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(cast(fp as double) / N, 6) as fpr,
       round(cast(tp as double) / P, 6) as tpr from p, t""", "scores", extra=_prefix_sql())

# ------------------------------------------------------- threshold search --

_F1 = "2 * (precision * recall) / (precision + recall + 1e-10)"


def _argmax_sql(order):
    return f"""
select threshold, round(precision, 6) as curve_precision, round(recall, 6) as curve_recall,
       round(f1, 6) as curve_f1,
       round(cast(tp + (N - fp) as double) / (P + N), 6) as accuracy, round({_div('tp', 'tp + fp')}, 6) as precision,
       round({_div('tp', 'P')}, 6) as recall, round({_div('2 * tp', '2 * tp + fp + (P - tp)')}, 6) as f1_score
from (select *, {_F1} as f1 from pr), t order by {order} limit 1"""


@query("thr_argmax")
def thr_argmax(spark, d):
    return r6(_curve(spark, d).argmax_threshold("f1"))


sql("thr_argmax", _argmax_sql("f1 desc, k asc"), "scores", extra={**_prefix_sql(), "pr": _PR})


@query("thr_argmax_precision")
def thr_argmax_precision(spark, d):
    return r6(_curve(spark, d).argmax_threshold("precision"))


sql("thr_argmax_precision", _argmax_sql("precision desc, k asc"), "scores",
    extra={**_prefix_sql(), "pr": _PR})


@query("thr_min_recall")
def thr_min_recall(spark, d):
    return r6(_curve(spark, d).argmax_threshold("f1", min_recall=0.8))


sql("thr_min_recall", _argmax_sql("(recall >= 0.8) desc, f1 desc, k asc"), "scores",
    extra={**_prefix_sql(), "pr": _PR})


def _grid_sql(view, grid):
    return f"""
select g.j, g.threshold,
  cast(count(case when s.label = 1 and s.fraud_probability >= g.threshold then 1 end) as bigint) as tp,
  cast(count(case when s.label = 0 and s.fraud_probability >= g.threshold then 1 end) as bigint) as fp,
  cast(count(case when s.label = 1 and s.fraud_probability < g.threshold then 1 end) as bigint) as fn,
  cast(count(case when s.label = 0 and s.fraud_probability < g.threshold then 1 end) as bigint) as tn
from (values {_dbl_list(grid)}) g(j, threshold), {view} s group by g.j, g.threshold"""


def _grid_metrics_sql(view, grid):
    return f"""select j, threshold, {_div('tp', 'tp + fp')} as precision, {_div('tp', 'tp + fn')} as recall,
  {_div('2 * tp', '2 * tp + fp + fn')} as f1 from ({_grid_sql(view, grid)})"""


def _grid_best_sql(gm, digits=6):
    r = (lambda e: f"round({e}, {digits})") if digits else (lambda e: e)
    return f"""
select case when mr <= 0 then 0.5 else threshold end as threshold,
       {r("case when mr <= 0 then 0.0 else f1 end")} as f1,
       {r("case when mr <= 0 then 0.0 else recall end")} as recall,
       {r("case when mr <= 0 then 0.0 else precision end")} as precision
from (select *, max(recall) over () as mr from {gm})
order by (recall >= 0.8) desc, case when recall >= 0.8 then f1 else recall end desc, j asc limit 1"""


@query("thr_grid_recall80")
def thr_grid_recall80(spark, d):
    gm = M.grid_metrics(M.grid_counts(_scores(spark, d), GRID))
    return r6(M.grid_search_min_recall(gm, 0.8), exact=("threshold",))


sql("thr_grid_recall80", _grid_best_sql("gm"), "scores", extra={"gm": _grid_metrics_sql("scores", GRID)})


@query("thr_sweep")
def thr_sweep(spark, d):
    gm = M.grid_metrics(M.grid_counts(_scores(spark, d), SWEEP))
    return r6(gm.select("threshold", "recall", "precision"), exact=("threshold",))


sql("thr_sweep", f"""select threshold, round(recall, 6) as recall, round(precision, 6) as precision
from ({_grid_metrics_sql('scores', SWEEP)})""", "scores")

# ---------------------------------------------------------- model tables --


def _model_row(spark, d, name, mult):
    sc = _scores(spark, d, mult)
    basic = M.basic_from_confusion(M.confusion(sc)).select("accuracy", "precision", "recall", "f1_score")
    c = M.ScoreCurve.of(sc)
    # three one-row aggregates side by side: joined on a constant key
    return (basic.withColumn("_k", F.lit(1))
            .join(c.roc_auc().withColumn("_k", F.lit(1)), "_k")
            .join(c.average_precision().withColumn("_k", F.lit(1)), "_k")
            .select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1_score",
                    "roc_auc", "average_precision"))


def _rank_best(df: DataFrame, metric: str, order_col: str = "model") -> DataFrame:
    """row_number over a table with one row per model (a handful of rows)."""
    w = Window.orderBy(F.desc(metric), F.asc(order_col))
    return df.withColumn("rank", F.row_number().over(w)).withColumn(
        "is_best", (F.col("rank") == 1).cast("int"))


@query("eval_model_table")
def eval_model_table(spark, d):
    rows = None
    for name, mult in MODELS:
        r = _model_row(spark, d, name, mult)
        rows = r if rows is None else rows.unionByName(r)
    return r6(_rank_best(rows, "f1_score").drop("rank"))


def _model_table_sql():
    parts, ctes = [], {}
    for name, mult in MODELS:
        view = "scores" if mult == 31 else "scores2"
        ctes[f"c_{name}"] = _prefix_sql(view)["c"]
        ctes[f"p_{name}"] = _prefix_sql()["p"].replace("from c", f"from c_{name}")
        ctes[f"t_{name}"] = _prefix_sql()["t"].replace("from c", f"from c_{name}")
        ctes[f"cm_{name}"] = _cm_sql(view)
        auc = _AUC.replace("from p, t", f"from p_{name}, t_{name}")
        ap = _AP.replace("from p, t", f"from p_{name}, t_{name}")
        parts.append(f"select '{name}' as model, {_BASIC}, {auc} as roc_auc, {ap} as average_precision "
                     f"from cm_{name}")
    return ctes, " union all ".join(parts)


_MT_CTES, _MT_BODY = _model_table_sql()
sql("eval_model_table", f"""
select model, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
       round(f1_score, 6) as f1_score, round(roc_auc, 6) as roc_auc,
       round(average_precision, 6) as average_precision,
       cast(row_number() over (order by f1_score desc, model) = 1 as int) as is_best
from ({_MT_BODY})""", "scores", "scores2", extra=_MT_CTES)


@query("win_rank_model")
def win_rank_model(spark, d):
    rows = None
    for name, mult in MODELS:
        r = _model_row(spark, d, name, mult).select("model", "average_precision")
        rows = r if rows is None else rows.unionByName(r)
    return r6(_rank_best(rows, "average_precision").drop("is_best"))


sql("win_rank_model", f"""
select model, round(average_precision, 6) as average_precision,
       cast(row_number() over (order by average_precision desc, model) as int) as rank
from ({_MT_BODY})""", "scores", "scores2", extra=_MT_CTES)


@query("eval_full")
def eval_full(spark, d):
    sc = _scores(spark, d)
    cm = M.rates_from_confusion(M.basic_from_confusion(M.confusion(sc)))
    c = M.ScoreCurve.of(sc)
    out = (cm.withColumn("_k", F.lit(1))
           .join(c.roc_auc().withColumn("_k", F.lit(1)), "_k")
           .join(c.average_precision().withColumn("_k", F.lit(1)), "_k")
           .drop("_k").withColumn("threshold", F.lit(0.5)))
    return r6(out)


sql("eval_full", f"""
select tn, fp, fn, tp, {_rnd(_BASIC_COLS + _RATE_COLS)}, round({_AUC}, 6) as roc_auc,
       round({_AP}, 6) as average_precision, cast(0.5 as double) as threshold
from (select *, {_BASIC}, {_RATES} from cm)""", "scores", extra={"cm": _cm_sql(), **_prefix_sql()})


@query("thr_summary")
def thr_summary(spark, d):
    rows = None
    for name, mult in MODELS:
        gm = M.grid_metrics(M.grid_counts(_scores(spark, d, mult), GRID))
        r = M.grid_search_min_recall(gm, 0.8).select(F.lit(name).alias("model"), "*")
        rows = r if rows is None else rows.unionByName(r)
    rounded = rows.select("model", *[F.round(c, 4).alias(c) for c in ("threshold", "f1", "recall", "precision")])
    return _rank_best(rounded, "f1").drop("rank")


def _thr_summary_sql():
    parts, ctes = [], {}
    for name, mult in MODELS:
        view = "scores" if mult == 31 else "scores2"
        ctes[f"gm_{name}"] = _grid_metrics_sql(view, GRID)
        best = _grid_best_sql(f"gm_{name}", digits=None)
        parts.append(f"select '{name}' as model, * from ({best})")
    body = " union all ".join(parts)
    return ctes, f"""
select model, round(threshold, 4) as threshold, round(f1, 4) as f1, round(recall, 4) as recall,
       round(precision, 4) as precision,
       cast(row_number() over (order by round(f1, 4) desc, model) = 1 as int) as is_best
from ({body})"""


_TS_CTES, _TS_BODY = _thr_summary_sql()
sql("thr_summary", _TS_BODY, "scores", "scores2", extra=_TS_CTES)
