"""Correlation matrix against pairwise corr, exact quantiles in two scans."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import aggregates as A
from riskloom.operators import quantiles as Q


def test_corr_matrix_equals_pairwise_corr(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a = rng.normal()
        rows.append((1e9 + a, None if i % 3 == 0 else float(a * 2 + rng.normal()), 7.25, None, float(i % 5), 1.0 if i == 9 else None))
    df = spark.createDataFrame(rows, "a double, b double, constant double, empty double, k double, once double").repartition(5)
    cols = df.columns
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in A.corr_matrix(df, cols).collect()}
    assert set(got) == {(x, y) for x in cols for y in cols}
    for x in cols:
        for y in cols:
            v = [(r[cols.index(x)], r[cols.index(y)]) for r in rows if r[cols.index(x)] is not None and r[cols.index(y)] is not None]
            a, b = np.array(v).reshape(-1, 2).T
            want = np.corrcoef(a - a[0], b - b[0])[0, 1] if len(v) > 1 and np.ptp(a) > 0 and np.ptp(b) > 0 else None
            if want is None:
                assert got[x, y] is None, (x, y)
            else:
                assert got[x, y] == pytest.approx(want, abs=1e-7), (x, y)


def test_corr_matrix_of_many_columns(spark):
    """500 columns plan and run: 250,000 cells."""
    df = spark.range(300).select(*[F.randn(i).alias(f"c{i}") for i in range(500)])
    start = time.time()
    out = A.corr_matrix(df, df.columns)
    assert out.count() == 250_000 and time.time() - start < 120
    assert out.where("col_a = col_b and abs(corr - 1) > 1e-9").count() == 0


def test_corr_matrix_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {r["corr"] for r in A.corr_matrix(df, ["a", "b"]).collect()} <= {None}


def _counted(df, spark):
    """``df``, and a counter of the rows that are read from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(count, df.schema), seen


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("window", [1_000_000, 10])
def test_quantiles_in_two_scans(spark, monkeypatch, window):
    monkeypatch.setattr(Q, "WINDOW_ROWS", window)
    n = 60_000
    df = spark.range(n).select(F.rand(1).alias("u"), F.floor(F.rand(2) * 9).cast("double").alias("few"), F.exp(F.randn(3) * 8).alias("wide"),
                               F.when(F.rand(4) < 0.4, 0.0).otherwise(F.randn(5)).alias("hot"), F.when(F.rand(6) < 0.9, F.lit(None)).otherwise(F.randn(7)).alias("gaps"),
                               F.lit(None).cast("double").alias("none"), (F.col("id") % 3).alias("g")).cache()
    rows = df.toPandas()
    counted, seen = _counted(df, spark)
    cols = ["u", "few", "wide", "hot", "gaps", "none"]
    got = Q.exact_quantiles(counted, cols, PROBS, by="g")
    # the sketch's scan and the brackets' scan, no more
    assert seen.value == 2 * n
    for g in range(3):
        for c in cols:
            x = rows[c][rows["g"] == g].dropna().to_numpy()
            if c == "none":
                assert (str(g), c) not in got
            else:
                np.testing.assert_allclose(got[str(g), c], np.quantile(x, PROBS), rtol=1e-12, atol=1e-12)


def test_a_bracket_that_misses_is_found_out(spark, monkeypatch):
    """With a sketch as coarse as this the brackets are off; values are not."""
    df = spark.range(5000).select(F.randn(1).alias("x")).cache()
    x = df.toPandas()["x"].to_numpy()
    real = F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda c, p, a: real(c, [0.01] * len(p), 100))
    assert Q.exact_quantiles(df, ["x"], [0.25, 0.5, 0.9])["", "x"] == pytest.approx(np.quantile(x, [0.25, 0.5, 0.9]).tolist())


def test_quantiles_of_few_rows(spark):
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 9, [float("nan"), None, 4.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        own = [v for v in values if v is not None and v == v]
        got = Q.exact_quantiles(df, ["x"], [0.0, 0.3, 1.0])
        assert got == ({("", "x"): pytest.approx(np.quantile(own, [0.0, 0.3, 1.0]).tolist())} if own else {})
