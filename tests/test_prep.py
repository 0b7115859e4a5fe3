"""Split, imputation, scaling, class weights, oversampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import balance as B
from riskloom.operators import prep as P
from tests.conftest import SF001


def test_split_is_exact_partition(spark):
    from riskloom.sources import fixtures as X
    card = X.card_txn(spark, SF001)
    s = P.stratified_split(card)
    assert s.count() == card.count()
    assert s.select("txn_id").distinct().count() == card.count()
    per = {(r["class"], r["is_test"]): r["n"] for r in s.groupBy("class", "is_test").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for c in (0, 1):
        n = per[(c, 0)] + per[(c, 1)]
        assert per[(c, 1)] == int(np.floor(0.2 * n + 0.5))


def test_split_is_deterministic(spark):
    from riskloom.sources import fixtures as X
    t = X.commerce_txn(spark, SF001)
    a = P.stratified_split(t).where("is_test = 1").select("txn_id").collect()
    b = P.stratified_split(t).where("is_test = 1").select("txn_id").collect()
    assert sorted(a) == sorted(b)


def test_impute_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (5.0,)], "x double")
    st = P.fit_medians(df, ["x"])
    assert st.medians["x"] == 3.0
    assert P.apply_medians(df, st).where("x is null").count() == 0


def test_scaler_moments(spark):
    df = spark.range(1000).select((F.col("id") * 3.0 + 7).alias("a"), F.lit(2.0).alias("b"))
    st = P.fit_scaler(df, ["a", "b"])
    out = P.apply_scaler(df, st).agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert out[0] == pytest.approx(0.0, abs=1e-9) and out[1] == pytest.approx(1.0)
    assert out[2] == 0.0  # zero std divides by 1
    with pytest.raises(RuntimeError):
        P.apply_scaler(df, P.ScaleState())


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "class int")
    w = {r["class"]: r["weight"] for r in P.class_weights(df).collect()}
    assert w[0] == pytest.approx(10 / 18) and w[1] == pytest.approx(5.0)


def test_dense_index(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    out = B.dense_index(df, F.xxhash64("k"), "k")
    idx = sorted(r["_idx"] for r in out.collect())
    assert idx == list(range(5000))


def test_knn_is_exact_with_many_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    rows = [(i, *map(float, x[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    nn = B.knn_within(df, ["a", "b", "c"], "k", k=5, block_rows=40)
    got = {}
    for r in nn.collect():
        got.setdefault(r["qkey"], []).append((r["rank"], r["nkey"]))
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(300):
        want = list(np.argsort(d[i], kind="stable")[:5])
        assert [n for _, n in sorted(got[i])] == want


def _brute_knn(rows, k):
    """{key: [(distance, key) of the k nearest]} row by row; ties by key."""
    out = {}
    for i, x in rows:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in rows if j != i)
        out[i] = d[:k]
    return out


@pytest.mark.parametrize("block_rows", [15, 60, 10_000])
def test_knn_with_copies_ties_and_clusters(spark, block_rows):
    """A third of all rows are one point, others stand on a grid (ties), the
    rest in clusters; -0.0 and 0.0 are one value."""
    rng = np.random.default_rng(2)
    points = [(0.0, -0.0)] * 60 + [(0.0, 0.0)] * 40 + [(float(a), float(b)) for a in range(5, 11) for b in range(6)] + \
        [tuple(map(float, c + rng.normal(0, 0.01, 2))) for c in ([100, 0], [0, 100], [100, 100]) for _ in range(50)]
    keys = rng.permutation(len(points)).tolist()
    rows = list(zip(keys, points))
    df = spark.createDataFrame([(i, *p) for i, p in rows], "k long, a double, b double").repartition(5)
    got, visits = {}, []
    for r in B.knn_within(df, ["a", "b"], "k", k=4, block_rows=block_rows, visits=visits).collect():
        got.setdefault(r["qkey"], []).append((r["rank"], r["nkey"], r["dist"]))
    want = _brute_knn(rows, 4)
    assert {i: [n for _, n, _ in sorted(v)] for i, v in got.items()} == {i: [j for _, j in v] for i, v in want.items()}
    np.testing.assert_allclose([[d for _, _, d in sorted(got[i])] for i in sorted(got)], [[d for d, _ in want[i]] for i in sorted(want)], atol=1e-9)
    assert visits[0] <= visits[1] and (block_rows == 10_000 or visits[0] < 0.6 * visits[1])


def test_knn_visits_few_of_many_cells(spark):
    """On clustered points a neighbourhood touches few cells, whatever their number."""
    n = 20_000
    df = spark.range(n).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64(F.lit(j), F.col("id") % 200), F.lit(1000)).cast("double") + F.randn(j) * 0.5).alias(f"f{j}") for j in range(6)]).cache()
    visits = []
    nn = B.knn_within(df, [f"f{j}" for j in range(6)], "k", k=5, block_rows=200, visits=visits)
    assert nn.count() == 5 * n
    assert visits[0] < 0.05 * visits[1], visits      # the quadratic way: 1.0
    x = np.array(df.select("k", *[f"f{j}" for j in range(6)]).orderBy("k").collect())[:, 1:]
    some = nn.where("qkey % 1000 = 7").collect()
    for i in range(7, n, 1000):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert sorted(r["nkey"] for r in some if r["qkey"] == i) == sorted(np.argsort(d)[:5].tolist())


def test_knn_visits_few_cells_without_clusters(spark):
    """Flags and spread columns, no clusters: boxes keep apart what balls around
    pivots do not (they were visited nearly all), and results stay exact."""
    rng = np.random.default_rng(3)
    n, k = 4000, 5
    x = np.column_stack([rng.integers(0, 2, (n, 6)) * 2.0, rng.normal(size=(n, 4))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"f{j} double" for j in range(10))).repartition(4).cache()
    visits = []
    nn = B.knn_within(df, [f"f{j}" for j in range(10)], "k", k=k, block_rows=50, visits=visits).collect()
    assert visits[0] < 0.3 * visits[1], visits
    got = {}
    for r in nn:
        got.setdefault(r["qkey"], {})[r["rank"]] = r["nkey"]
    for i in range(0, n, 37):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[i][r] for r in range(1, k + 1)] == np.lexsort((np.arange(n), d))[:k].tolist()


def test_knn_of_few_points(spark):
    schema = "k long, a double"
    assert B.knn_within(spark.createDataFrame([], schema), ["a"], "k").collect() == []
    assert B.knn_within(spark.createDataFrame([(1, 2.0)], schema), ["a"], "k").collect() == []
    got = B.knn_within(spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 2.0)], schema), ["a"], "k", k=5).collect()
    assert sorted((r["qkey"], r["rank"], r["nkey"], r["dist"]) for r in got) == [
        (1, 1, 3, 0.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 1, 0.0), (3, 2, 2, 1.0)]


def test_smote_counts_and_segments(spark):
    rows = [(i, float(i % 7), 0) for i in range(80)] + [(100 + i, 50.0 + i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "txn_id long, x double, class int")
    out = B.smote(df, ["x"], ratio=0.5, k=3)
    syn = out.where("is_synthetic = 1")
    assert syn.count() == int(0.5 * 80 - 10)
    assert out.where("is_synthetic = 0").count() == 90
    xs = [r["x"] for r in syn.collect()]
    assert min(xs) >= 50.0 and max(xs) <= 59.0  # on segments between minority rows
    assert syn.where("class = 1").count() == syn.count()


def test_exact_quantiles_match_numpy(spark):
    from riskloom.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.exponential(size=1001)])
    g = rng.integers(0, 3, size=len(a))
    df = spark.createDataFrame([(int(gi), float(x)) for gi, x in zip(g, a)], "g int, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["x"], probs, by="g")
    for gi in range(3):
        want = np.quantile(a[g == gi], probs)
        assert np.allclose(got[(str(gi), "x")], want, rtol=0, atol=1e-12)
