import hashlib
import math

import duckdb
import numpy as np
import pytest

from riskloom.llm import zonemap


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2), (5, 1)])
def test_hilbert_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = zonemap.hilbert_keys(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_and_drop_others():
    rng = np.random.default_rng(0)
    centroids = rng.integers(-500, 500, (8, 64))
    kept = 0
    for _ in range(50):
        v = centroids[rng.integers(8)] + rng.integers(-20, 20, (128, 64))
        which = zonemap.candidates(v.min(0)[None], v.max(0)[None], centroids)[0]
        d = ((v[:, None, :] - centroids) ** 2).sum(2)
        assert set(d.argmin(1)) <= set(which.tolist())
        kept += len(which)
    assert kept < 50 * 2


@pytest.mark.parametrize("high", [1000, (1 << 22) + 5, (1 << 27) - 1])
def test_nearest_is_exact(high):
    rng = np.random.default_rng(1)
    v, c = rng.integers(-high, high, (40, 64)), rng.integers(-high, high, (5, 64))
    c[3] = c[1]     # a tie
    best, d = zonemap.nearest(v, c, high)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert best.tolist() == [w.index(min(w)) for w in want] and d.tolist() == [min(w) for w in want]
    assert 3 not in best


def brute(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted((x for x in kept if x[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, y)) for y in c]
            out.append((i, d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        a = assign()
        for j in range(len(c)):
            own = [v for (_, v), (_, n, _) in zip(kept, a) if n == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own)]
    a = assign()
    total = {j: sum(d for _, n, d in a if n == j) for j in range(len(c))}
    return [(i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in a]


def rows_of(n=400):
    rng = np.random.default_rng(4)
    near = rng.normal(0, 0.3, (5, 64))
    rows = [(i, [float(np.float32(x)) for x in near[i % 5] + rng.normal(0, 0.1, 64)], 1, 2, "x") for i in range(n)]
    rows += [(1000 + i, rows[0][1], 1, 2, "x") for i in range(n // 2)]          # a third are copies
    rows += [rows[7], (7, rows[9][1], 1, 2, "x"), (None, rows[3][1], 1, 2, "x"), (5000, None, 1, 2, "x"), (5001, [0.5] * 63, 1, 2, "x"), (5002, [], 1, 2, "x"),
             (5003, [0.5] * 63 + [None], 1, 2, "x"), (5004, [math.nan] * 64, 1, 2, "x"), (5005, [math.inf] + [0.0] * 63, 1, 2, "x"), (5006, [0.0] * 64, 1, 2, "x")]
    return rows


SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, id string"


def test_query_against_brute_force_and_sql(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, zonemap.op12_centroid_clustering(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(brute([(r[0], r[1]) for r in rows]), key=str)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet' where vec_id is not null and not (vec_id = 7 and embedding[1] = 0)")
    clean = [r for r in rows if r[0] is not None]
    spark.createDataFrame(clean, SCHEMA).write.parquet(str(tmp_path / "clean" / "embeddings.parquet"))
    assert sorted(con.sql(zonemap.SQL).fetchall(), key=str) == sorted(
        map(tuple, zonemap.op12_centroid_clustering(spark, str(tmp_path / "clean")).collect()), key=str)


def test_few_rows_and_none(spark, tmp_path):
    for name, rows in (("few", rows_of()[:3]), ("none", []), ("unusable", [(1, [1.0], 1, 2, "x")]), ("no_id", [(None, [0.5] * 64, 1, 2, "x")])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        got = sorted(map(tuple, zonemap.op12_centroid_clustering(spark, str(tmp_path / name)).collect()), key=str)
        assert got == sorted(brute([(r[0], r[1]) for r in rows]) if name == "few" else [], key=str)


def test_hot_vector_is_spread(spark):
    """Copies of one vector end in many blocks and partitions."""
    df = spark.range(6000).selectExpr("id", "if(id % 3 > 0, array_repeat(7, 64), transform(sequence(0, 63), i -> cast(hash(id, i) % 100 as int))) as v")
    blocks = zonemap.zone_map(df.repartition(4))
    own = blocks.selectExpr("size(ids) as n", "low = high as one").filter("one").groupBy().count().first()[0]
    assert own >= 0.8 * 4000 / zonemap.BLOCK and blocks.selectExpr("sum(size(ids))").first()[0] == 6000
