"""Exact integer k-means over zone maps along a Hilbert curve.

Vectors are scaled to integers, ordered along a Hilbert curve through the
``DIMS`` components that vary most, and packed into blocks of ``BLOCK``
neighbours.  A block knows its box (smallest and largest value of each
component) and the sum of its vectors.  For every centroid the box gives a
lower and an upper bound of the distance of any vector in it; a centroid whose
lower bound is above another's upper bound can't be the nearest of any.  What
remains are the block's candidates.  A block with one candidate adds its sum
as it is; else its vectors are compared with the candidates, exactly.

The block table is written once and read in every round; a task gives one sum
per cluster and component, these are added by Spark, and k rows reach the
driver.  All arithmetic is on integers: float64 matrix products only where
every term stays below 2 ** 53.

Defined cases: vectors that are null, of another length, or with a null, NaN
or infinite component are left out, as are components of LIMIT or more after
scaling (their distances could leave a long); rows that repeat an id are
vectors of their own; equal distances go to the smaller cluster; rows without
an id are clustered, but are no first centroids; fewer vectors than k give
fewer clusters; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import driver_table, table
from riskloom.session import cut_lineage

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LIMIT = 1 << 27       # scaled components stay below, in absolute value
BLOCK = 128           # vectors in a block
DIMS, BITS = 8, 7     # components and bits of each in a Hilbert key
_EXACT = 1 << 22      # components up to which float64 products are exact


# ---------------------------------------------------------------- the curve --

def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the points ``x`` (rows; components of
    ``bits`` bits), by the transpose method."""
    axes = [c.astype(np.uint64) for c in x.T]
    one, zero = np.uint64(1), np.uint64(0)
    for bit in range(bits - 1, 0, -1):
        q, p = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for i in range(len(axes)):
            high = axes[i] & q != 0
            swap = np.where(high, zero, (axes[0] ^ axes[i]) & p)
            axes[0] = np.where(high, axes[0] ^ p, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(x), np.uint64)
    for bit in range(bits - 1, 0, -1):
        q = one << np.uint64(bit)
        turn = np.where(axes[-1] & q != 0, turn ^ (q - one), turn)
    key = np.zeros(len(x), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            key = key << one | ((a ^ turn) >> np.uint64(bit)) & one
    return key.astype(np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _key(comps: list[int], low: np.ndarray, high: np.ndarray, width: int):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), width)[:, comps].astype(np.float64)
            cell = np.clip((v - low) / np.maximum(high - low, 1) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(hilbert_keys(cell, BITS))], ["id", "v", "key"])
    return key


# --------------------------------------------------------------- the blocks --

def _pack(width: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, all_ = b.column("id"), _matrix(b.column("v"), width).astype(np.int32)
            for at in range(0, len(all_), BLOCK):
                v = all_[at:at + BLOCK]
                own = ids.slice(at, len(v))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.concat_arrays([own])), pa.array([np.ascontiguousarray(v).tobytes()]),
                     pa.array([v.min(0)], pa.list_(pa.int32())), pa.array([v.max(0)], pa.list_(pa.int32())),
                     pa.array([v.sum(0, dtype=np.int64)], pa.list_(pa.int64()))], ["ids", "data", "low", "high", "total"])
    return pack


def scaled(df: DataFrame, id_col: str, vec_col: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v) of the usable vectors, v of integers."""
    whole = F.transform(F.col(vec_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = df.select(F.col(id_col).alias("id"), whole.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == width))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float(LIMIT))))
    return rows.filter(F.coalesce(usable, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x).try_cast("int")).alias("v"))


def zone_map(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """The block table of (id, v): ids, data, low, high, total."""
    spread = vectors.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(
        F.variance("x").alias("var"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    best = sorted(spread, key=lambda r: (-(r["var"] or 0.0), r["pos"]))[:DIMS]
    comps, low, high = [r["pos"] for r in best], np.array([r["low"] for r in best], np.float64), np.array([r["high"] for r in best], np.float64)
    if not best:
        comps, low, high = [0], np.zeros(1), np.ones(1)
    kind = dict(vectors.dtypes)["id"]
    keyed = vectors.mapInArrow(_key(comps, low, high, width), f"id {kind}, v array<int>, key long")
    # ties on the curve are split by id and vector, so copies spread over partitions
    dealt = keyed.withColumn("tie", F.xxhash64("id", "v"))
    dealt = dealt.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    return cut_lineage(dealt.select("id", "v").mapInArrow(_pack(width), f"ids array<{kind}>, data binary, low array<int>, high array<int>, total array<long>"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> list[np.ndarray]:
    """Per box the centroids that may be nearest to a vector in it."""
    out = []
    for lo, hi in zip(low, high):
        near = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
        far = np.maximum(np.abs(lo - centroids), np.abs(centroids - hi))
        out.append(np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min()))
    return out


def nearest(v: np.ndarray, centroids: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centroid, ties to the
    smaller; ``bound``: no component is larger in absolute value."""
    if bound < _EXACT:
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    else:
        d = np.stack([((v.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)
    best = d.argmin(1)
    return best, d[np.arange(len(v)), best].astype(np.int64)


def _blocks_of(b: pa.RecordBatch, centroids: np.ndarray):
    """(ids, data, total, candidates, bound) of each block of a batch."""
    width = centroids.shape[1]
    low, high = (_matrix(b.column(c), width).astype(np.int64) for c in ("low", "high"))
    total = _matrix(b.column("total"), width)
    own = int(np.abs(centroids).max())
    for i, which in enumerate(candidates(low, high, centroids)):
        bound = max(own, int(max(-low[i].min(), high[i].max())))
        yield i, np.frombuffer(b.column("data")[i].as_py(), np.int32).reshape(-1, width), total[i], which, bound


def _sums(centroids_bc):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = centroids_bc.value
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for _, v, whole, which, bound in _blocks_of(b, centroids):
                if len(which) == 1:
                    n[which[0]] += len(v)
                    total[which[0]] += whole
                    continue
                best = which[nearest(v, centroids[which], bound)[0]]
                for c in np.unique(best):
                    n[c] += int((best == c).sum())
                    total[c] += v[best == c].sum(0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])
    return sums


def _assign(centroids_bc):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = centroids_bc.value
        for b in batches:
            for i, v, _, which, bound in _blocks_of(b, centroids):
                best, distance = nearest(v, centroids[which], bound)
                yield pa.RecordBatch.from_arrays([b.column("ids")[i].values, pa.array(which[best].astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])
    return assign


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ``seed:id`` has the smallest SHA-256."""
    rows = vectors.filter(F.col("id").isNotNull()).orderBy(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector, and the centroids."""
    spark = df.sparkSession
    vectors = scaled(df, id_col, vec_col, width, scale)
    centroids = first_centroids(vectors, k, seed)
    kind = dict(vectors.dtypes)["id"]
    if not len(centroids):
        return spark.createDataFrame([], f"id {kind}, cluster int, distance long"), np.zeros((0, width), np.int64)
    blocks = zone_map(vectors, width)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centroids)
        parts = blocks.mapInArrow(_sums(sent), "cluster int, n long, total array<long>")
        sums = (parts.select("cluster", "n", F.posexplode("total").alias("pos", "x")).groupBy("cluster", "pos")
                .agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())   # k * width rows
        new = centroids.copy()
        for r in sums:
            new[r["cluster"], r["pos"]] = r["x"] // r["n"]
        if np.array_equal(new, centroids):      # every later round would give the same
            break
        centroids = new
    return blocks.mapInArrow(_assign(spark.sparkContext.broadcast(centroids)), f"id {kind}, cluster int, distance long"), centroids


def op12_centroid_clustering(spark, sf_dir):
    assigned, centroids = cluster(table(spark, sf_dir, "embeddings"))
    assigned = cut_lineage(assigned, "assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest())
            for c, v in enumerate(centroids)]
    known = driver_table(spark, rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(known, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> str:
    """The same rounds, unrolled, for DuckDB."""
    parts = [f"""kept as materialized (select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)""",
             f"""c0 as materialized (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v as c
  from (select * from kept where vec_id is not null order by sha256('{seed}:' || vec_id) limit {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select row_no, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance
  from (select row_no, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept, c{i}) group by row_no)""")
        if i < rounds:
            parts.append(f"""c{i + 1} as materialized (select c{i}.cluster, coalesce(m.c, c{i}.c) as c from c{i} left join (
  select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) as c
  from (select cluster, pos, sum(x) as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as pos from a{i}) group by cluster, pos)
  group by cluster) m using (cluster))""")
    return "with " + ",\n".join(parts) + f"""
select a.vec_id, a.cluster::int as cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia,
       (sum(a.distance) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c using (cluster)"""


SQL = _sql()
