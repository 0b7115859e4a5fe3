"""Minority oversampling (SMOTE) as Spark jobs.

Synthetic rows: ``n_new = int(ratio * n_majority - n_minority)``; each one
takes a minority row ``x``, one of its ``k`` nearest minority neighbours
``z`` (Euclidean, self excluded, ties by key) and a gap ``u`` in [0, 1):
``x + u * (z - x)``.  Randomness is a hash of (synthetic id, seed), so a
re-run - or a recomputed partition after an executor loss - gives the same
rows.

Exact k-NN goes through a tree of cells.  Equal points are one *vector* with the
``k + 1`` smallest of its keys (no more can be among anybody's neighbours), so
copies cost nothing.  A bounded sample of the vectors is cut, one column and
value at a time, where that lowers the squared error most, into
``n / block_rows`` cells; the sample only shapes the cells, every vector falls
into one and each cell has the box that its vectors really fill.  A cell with
more vectors than that is dealt out in parts by hash.

1. In its own cell every vector finds its neighbours; the distance ``u`` of the
   k-th is an upper bound of the true one.
2. A cell can hold a nearer one only if its box comes within ``u``.  A vector is
   sent to these cells alone, and each cell's vectors are there once; a task
   compares one cell with a chunk of the vectors sent to it.

So work follows how many cells a neighbourhood touches, not the square of the
minority: columns with few values (flags, one-hot codes) make the first cuts
and their boxes lie apart, so the more vectors there are the smaller the share
of cells that is visited.  In many dimensions without any structure it is still
most cells, and class weights (``prep.with_class_weight``) are the linear
alternative and the default of the boosted-tree model.  The sample (at most
``SAMPLE_ROWS`` rows) and one box per cell (at most ``MAX_CELLS``) reach the
driver and are broadcast.
"""

from __future__ import annotations

import heapq
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage, drop_scratch

_HASH_BUCKET_BITS = 16
_QUERY_CHUNK = 256
_CANDIDATES = 200_000    # measured exactly at once
MAX_CELLS = 4096
SAMPLE_ROWS = 20_000


def dense_index(df: DataFrame, order_hash, key: str, out: str = "_idx") -> DataFrame:
    """0-based dense index in (order_hash, key) order without a global window.

    Rows are counted per top-16-bit bucket of the hash (<= 65,536 rows),
    bucket offsets are a running sum on that tiny table, and only the rows of
    one bucket share a window partition.
    """
    rows = df.withColumn("_oh", order_hash).withColumn(
        "_ob", F.shiftrightunsigned(F.col("_oh"), 64 - _HASH_BUCKET_BITS))
    cnt = rows.groupBy("_ob").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.select("_ob", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inb = Window.partitionBy("_ob").orderBy("_oh", key)
    out_df = rows.join(F.broadcast(off), "_ob").withColumn(
        out, (F.row_number().over(inb) - 1 + F.col("_off")).cast("bigint"))
    return out_df.drop("_oh", "_ob", "_off")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, 0 or more."""
    d2 = (x * x).sum(axis=1)[:, None] - 2.0 * x @ y.T + (y * y).sum(axis=1)[None, :]
    return np.maximum(d2, 0.0, out=d2)


def _point(features: Sequence[str]):
    return F.array(*[F.col(f).cast("double") + F.lit(0.0) for f in features])     # -0.0 is 0.0


def _vectors(points: DataFrame, features: Sequence[str], key: str, k: int, parts: int) -> DataFrame:
    """(vid, f, keys): each distinct point once, with its k + 1 smallest keys
    in order.  Ranked first inside ``parts`` hash parts of a point's keys, then
    over what is left, so a point that a third of all rows share is no group
    of its own size anywhere."""
    base = points.select(_point(features).alias("f"), F.col(key).cast("bigint").alias("key"))
    base = base.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    small = F.row_number().over(Window.partitionBy("f", "part").orderBy("key"))
    few = base.withColumn("r", small).where(F.col("r") <= k + 1).groupBy("f", "part").agg(F.collect_list("key").alias("keys"))
    return few.groupBy("f").agg(F.flatten(F.collect_list("keys")).alias("keys")).select(
        F.xxhash64("f").alias("vid"), "f", F.slice(F.array_sort("keys"), 1, k + 1).alias("keys"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


@dataclass
class _Tree:
    """Cells by cuts: node -> (column, value, left, right), left if value <=
    the node's; a leaf's column is -1 and its left child the cell's number."""
    nodes: list
    n_cells: int

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            column, value, left, right = self.nodes[node]
            if column < 0:
                out[rows] = left
            elif len(rows):
                go = x[rows, column] <= value
                stack += [(left, rows[go]), (right, rows[~go])]
        return out

    def boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The box of every node from those of the cells."""
        lo, hi = (np.full((len(self.nodes), low.shape[1]), v) for v in (np.inf, -np.inf))
        for i in range(len(self.nodes) - 1, -1, -1):     # children come after their parents
            column, _, left, right = self.nodes[i]
            lo[i], hi[i] = (low[left], high[left]) if column < 0 else (np.minimum(lo[left], lo[right]), np.maximum(hi[left], hi[right]))
        return lo, hi

    def within(self, boxes, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose box comes within ``u`` of the row."""
        lo, hi = boxes
        found, stack = [(np.empty(0, np.int64), np.empty(0, np.int32))], [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not np.all(lo[node] <= hi[node]):
                continue        # nothing fell into it
            gap = np.maximum(np.maximum(lo[node] - x[rows], x[rows] - hi[node]), 0.0)
            d = np.sqrt((np.where(np.isnan(gap), 0.0, gap) ** 2).sum(1))
            # slack for rounding: a cell too many does no harm
            rows = rows[d <= u[rows] + 1e-9 * (1 + d)]
            if not len(rows):
                continue
            column, _, left, right = self.nodes[node]
            if column < 0:
                found.append((rows, np.full(len(rows), left, np.int32)))
            else:
                stack += [(left, rows), (right, rows)]
        return tuple(np.concatenate(c) for c in zip(*found))


def _best_cut(x: np.ndarray):
    """(column, value) whose cut lowers the squared error most; None if all rows are equal."""
    s = np.sort(x, axis=0)
    n, total = np.arange(1, len(x))[:, None], s.sum(0)
    left = np.cumsum(s, axis=0)[:-1]
    drop = left * left / n + (total - left) ** 2 / (len(x) - n)
    drop = np.where(s[1:] > s[:-1], drop - total * total / len(x), -np.inf)
    if not drop.size or drop.max() == -np.inf:
        return None
    at, column = np.unravel_index(drop.argmax(), drop.shape)
    return int(column), float(s[at, column])


def _grow(sample: np.ndarray, cells: int) -> _Tree:
    """Up to ``cells`` cells; the one with most rows is cut next."""
    nodes, heap, n = [(-1, 0.0, 0, 0)], [(-len(sample), 0, np.arange(len(sample)))], 1
    finite = np.nan_to_num(sample)
    while heap and n < cells:
        _, node, rows = heapq.heappop(heap)
        if (cut := _best_cut(finite[rows])) is None:
            continue
        go = finite[rows, cut[0]] <= cut[1]
        left = len(nodes)
        nodes[node] = (*cut, left, left + 1)
        nodes += [(-1, 0.0, 0, 0)] * 2
        for child, own in ((left, rows[go]), (left + 1, rows[~go])):
            heapq.heappush(heap, (-len(own), child, own))
        n += 1
    leaves = [i for i, x in enumerate(nodes) if x[0] < 0]
    for cell, i in enumerate(leaves):
        nodes[i] = (-1, 0.0, cell, 0)
    return _Tree(nodes, len(leaves))


def _into_cells(tree_bc, width: int):
    """Rows of vectors -> the same with the cell they fall into."""
    def run(batches):
        for b in batches:
            cell = tree_bc.value.cell_of(_matrix(b.column("f"), width))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("vid", "f", "keys")], pa.array(cell)], ["vid", "f", "keys", "cell"])
    return run


def _nearest(queries: np.ndarray, y: np.ndarray, keys: pa.Array, k: int, bound: np.ndarray | None = None):
    """(row, distance, key) of the k + 1 nearest keys of every row of
    ``queries`` among the vectors ``y``, in order (ties by key); only those
    within ``bound``, if given."""
    at, value = keys.offsets.to_numpy(), keys.values.to_numpy(zero_copy_only=False)
    first, kk = value[at[:-1]], min(k + 1, len(y))
    far = (y * y).sum(1).max(initial=0.0)
    out = []
    for s in range(0, len(queries), _QUERY_CHUNK):
        q = queries[s:s + _QUERY_CHUNK]
        d2 = _distances(q, y)
        if kk == len(y):
            near = np.ones(d2.shape, bool)
        else:
            # slack for rounding: the few that count are measured exactly below
            slack = 1e-13 * ((q * q).sum(1) + far)
            edge = np.full(len(q), np.inf) if bound is None else bound[s:s + len(q)] ** 2
            near = d2 <= (edge + 1e-9 * (1 + edge) + slack)[:, None]
            many = np.flatnonzero(near.sum(1) > 4 * kk)
            if len(many):
                edge = np.partition(d2[many], kk - 1, axis=1)[:, kk - 1]
                near[many] &= d2[many] <= (edge + 1e-9 * (1 + edge) + slack[many])[:, None]
        # rows together that have so many candidates at most
        group = np.cumsum(near.sum(1)) // _CANDIDATES
        for g in np.unique(group):
            of = np.flatnonzero(group == g)
            row, col = np.nonzero(near[of])
            row = of[row]
            dist = np.sqrt(((q[row] - y[col]) ** 2).sum(1))
            order = np.lexsort((first[col], dist, row))
            row, col, dist = row[order], col[order], dist[order]
            some = _place(row) < kk
            row, col, dist = row[some], col[some], dist[some]
            # every vector's keys
            n = at[col + 1] - at[col]
            key = value[np.repeat(at[col] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row, dist = np.repeat(row, n), np.repeat(dist, n)
            order = np.lexsort((key, dist, row))
            row, dist, key = row[order], dist[order], key[order]
            some = _place(row) <= k
            out.append((row[some] + s, dist[some], key[some]))
    if not out:
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _place(sorted_rows: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal values."""
    new = np.append(True, sorted_rows[1:] != sorted_rows[:-1])[:len(sorted_rows)]
    start = np.flatnonzero(new)
    return np.arange(len(sorted_rows)) - np.repeat(start, np.diff(np.append(start, len(sorted_rows))))


def _listed(row: np.ndarray, n_rows: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=n_rows))).astype(np.int32)), values)


_FOUND = "array<struct<dist: double, nkey: long>>"


def _found(row, dist, key, n_rows: int) -> pa.Array:
    return _listed(row, n_rows, pa.StructArray.from_arrays([pa.array(dist, pa.float64()), pa.array(key, pa.int64())], ["dist", "nkey"]))


def _in_own_cell(tree_bc, boxes_bc, cuts_bc, width: int, k: int):
    """One cell (or part of one): for each vector what it finds there, how far
    that reaches, and the cells that may hold a nearer one."""
    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("f").combine_chunks(), width)
        cell, cuts = group.column("cell")[0].as_py(), cuts_bc.value
        row, dist, key = _nearest(x, x, group.column("keys").combine_chunks(), k)
        u, last = np.full(len(x), np.inf), _place(row) == k
        u[row[last]] = dist[last]
        at, to = tree_bc.value.within(boxes_bc.value, x, u)
        some = (to != cell) | (cuts[to] > 1)
        at, to = at[some], to[some]
        order = np.lexsort((to, at))
        return pa.table([group.column("vid"), group.column("f"), pa.array(u), group.column("cell"), group.column("part"),
                         _listed(at[order], len(x), pa.array(to[order], pa.int32())), _found(row, dist, key, len(x))],
                        ["vid", "f", "u", "cell", "part", "to", "found"])
    return run


def _in_other_cells(width: int, k: int):
    """Vectors sent to a cell (left) and the cell (right): what they find there."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if right.num_rows else 0
        row, dist, key = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        if n:
            row, dist, key = _nearest(_matrix(left.column("f").combine_chunks(), width), _matrix(right.column("f").combine_chunks(), width),
                                      right.column("keys").combine_chunks(), k, left.column("u").to_numpy())
        return pa.table([left.column("vid").slice(0, n), _found(row, dist, key, n)], ["vid", "found"])
    return run


def knn_within(points: DataFrame, features: Sequence[str], key: str, k: int = 5,
               block_rows: int = 10_000, n_points: int | None = None, visits: list | None = None) -> DataFrame:
    """Exact k nearest neighbours of every row among the same rows.

    Returns ``(qkey, rank, nkey, dist)`` with rank 1..k (ties by key).
    ``visits`` receives how many (vector, cell) comparisons were asked for
    beyond the own cell, and how many there could have been.
    """
    spark, width = points.sparkSession, len(features)
    n = n_points if n_points is not None else points.count()
    parts = max(1, math.ceil(n / block_rows))
    vectors = cut_lineage(_vectors(points, features, key, k, parts), "vectors")
    sample = np.array([r["f"] for r in vectors.orderBy(F.xxhash64(F.lit(5), "vid"), "vid").limit(SAMPLE_ROWS).select("f").collect()]).reshape(-1, width)
    if not len(sample):
        return spark.createDataFrame([], "qkey long, rank int, nkey long, dist double")
    share = spark.sparkContext.broadcast
    tree = _grow(sample, min(MAX_CELLS, parts))
    tree_bc = share(tree)
    placed = vectors.mapInArrow(_into_cells(tree_bc, width), "vid long, f array<double>, keys array<long>, cell int")
    ends = [e(F.col("f")[i]).alias(f"{e.__name__}{i}") for e in (F.min, F.max) for i in range(width)]
    low, high, cuts = np.full((tree.n_cells, width), np.inf), np.full((tree.n_cells, width), -np.inf), np.ones(tree.n_cells, np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect():    # one row per cell
        lo, hi = np.array(r[2:2 + width], float), np.array(r[2 + width:], float)
        low[r["cell"]], high[r["cell"]] = np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)
        cuts[r["cell"]] = max(1, math.ceil(r["n"] / (2 * block_rows)))      # cells of a tree differ in size
    cut = F.broadcast(spark.createDataFrame(list(enumerate(cuts.tolist())), "_c int, cuts int"))
    placed = placed.join(cut, F.col("cell") == F.col("_c")).withColumn("part", F.pmod(F.xxhash64(F.lit(9), "vid"), F.col("cuts")).cast("int")).select(
        "vid", "f", "keys", "cell", "part")
    own = cut_lineage(placed.groupBy("cell", "part").applyInArrow(
        _in_own_cell(tree_bc, share(tree.boxes(low, high)), share(cuts), width, k),
        f"vid long, f array<double>, u double, cell int, part int, to array<int>, found {_FOUND}"), "own")
    to = own.select("vid", "f", "u", F.col("cell").alias("_cell"), F.col("part").alias("_part"), F.explode("to").alias("cell"))
    to = to.join(cut, F.col("cell") == F.col("_c")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    to = to.where((F.col("cell") != F.col("_cell")) | (F.col("part") != F.col("_part"))).select("vid", "f", "u", "cell", "part")
    # a cell that many ask for is compared in several tasks, each with a chunk of those that ask
    per_cell = cut_lineage(to.groupBy(F.col("cell").alias("_to"), F.col("part").alias("_into")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("chunks")), "chunks")
    if visits is not None:
        visits += [to.count(), vectors.count() * (int(cuts.sum()) - 1)]
    fresh = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])  # noqa: E731  the sides of a cogroup must not share attributes
    asked_for = (F.col("cell") == F.col("_to")) & (F.col("part") == F.col("_into"))
    sent = to.join(F.broadcast(per_cell), asked_for).withColumn("chunk", F.pmod(F.xxhash64(F.lit(4), "vid"), F.col("chunks")).cast("int"))
    held = placed.join(F.broadcast(per_cell), asked_for).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    other = fresh(sent, "vid", "f", "u", "cell", "part", "chunk").groupBy("cell", "part", "chunk").cogroup(
        fresh(held, "f", "keys", "cell", "part", "chunk").groupBy("cell", "part", "chunk")).applyInArrow(_in_other_cells(width, k), f"vid long, found {_FOUND}")
    # per vector: the k + 1 best (distance, key); its own keys are among them at 0
    top = own.select("vid", "found").unionByName(other).groupBy(F.col("vid").alias("_v")).agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("_nn"))
    rows = points.select(F.col(key).cast("bigint").alias("qkey"), F.xxhash64(_point(features)).alias("vid"))
    near = rows.join(top, F.col("vid") == F.col("_v")).select("qkey", F.slice(F.filter("_nn", lambda c: c["nkey"] != F.col("qkey")), 1, k).alias("_nn"))
    near = cut_lineage(near, "neighbours")
    drop_scratch(vectors, own, per_cell)
    return near.select("qkey", F.posexplode("_nn").alias("_pos", "_c")).select(
        "qkey", (F.col("_pos") + 1).alias("rank"), F.col("_c.nkey").alias("nkey"), F.col("_c.dist").alias("dist"))


def _unit(seed_col) -> F.Column:
    """Uniform [0, 1) from a 64-bit hash (53 random bits)."""
    return (F.col(seed_col).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53))


def smote(df: DataFrame, features: Sequence[str], label: str = "class", key: str = "txn_id",
          ratio: float = 0.5, k: int = 5, seed: int = 42, minority: int = 1,
          synthetic_flag: str | None = "is_synthetic") -> DataFrame:
    """``df`` plus synthetic minority rows (``key`` NULL on synthetic rows)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_min = int(counts.get(minority, 0))
    n_maj = int(sum(v for c, v in counts.items() if c != minority))
    n_new = int(ratio * n_maj - n_min)
    out_cols = list(df.columns)
    flagged = df.withColumn(synthetic_flag, F.lit(0)) if synthetic_flag else df
    if n_new <= 0 or n_min < 2:
        warnings.warn(f"no oversampling: minority {n_min}, majority {n_maj}, ratio {ratio}")
        return flagged
    kk = min(k, n_min - 1)
    mino = df.where(F.col(label) == minority).select(key, *features)
    mino = cut_lineage(dense_index(mino, F.xxhash64(F.col(key), F.lit(seed)), key), "minority")
    # k-NN keyed by the dense index (works for any key type)
    nn = knn_within(mino.select("_idx", *features), features, "_idx", kk, n_points=n_min)

    syn = df.sparkSession.range(n_new).select(
        F.col("id").alias("_sid"),
        F.xxhash64(F.col("id"), F.lit(seed)).alias("_h0"),
        F.xxhash64(F.col("id"), F.lit(seed + 1)).alias("_h1"),
        F.xxhash64(F.col("id"), F.lit(seed + 2)).alias("_h2"))
    syn = syn.select("_sid", F.pmod("_h0", F.lit(n_min)).alias("qkey"),
                     (F.pmod("_h1", F.lit(kk)) + 1).cast("int").alias("rank"), _unit("_h2").alias("_u"))
    base = mino.select(F.col("_idx").alias("qkey"), *[F.col(f).alias(f"_x_{f}") for f in features])
    nbr = mino.select(F.col("_idx").alias("nkey"), *[F.col(f).alias(f"_z_{f}") for f in features])
    s = (syn.join(nn.select("qkey", "rank", "nkey"), ["qkey", "rank"])
         .join(base, "qkey").join(nbr, "nkey"))
    new_vals = {f: F.col(f"_x_{f}") + F.col("_u") * (F.col(f"_z_{f}") - F.col(f"_x_{f}")) for f in features}
    cols = []
    for c in out_cols:
        if c in new_vals:
            cols.append(new_vals[c].alias(c))
        elif c == label:
            cols.append(F.lit(minority).cast(df.schema[label].dataType).alias(c))
        else:
            cols.append(F.lit(None).cast(df.schema[c].dataType).alias(c))
    synthetic = s.select(*cols)
    if synthetic_flag:
        synthetic = synthetic.withColumn(synthetic_flag, F.lit(1))
    return flagged.unionByName(synthetic)
