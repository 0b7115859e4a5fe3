"""Resharding by minimum-cost flow.

Documents lie in old shards, each stored as blocks (one folder per block, a
hash range of the shard's documents).  From the old shards' bytes and the new
capacities a minimum-cost flow says how many bytes go from which shard to
which; staying costs nothing, so it moves the fewest bytes.  Along a shard's
line of blocks the flow marks off intervals: most blocks lie inside one and
stay or move whole, the few that an interval's end cuts are split document by
document.  A second, tiny flow over the documents of the split blocks (and of
one moved block per receiving shard), smallest first, evens out what whole
documents left over.  Only affected
blocks are rewritten; the other files stay as they are.

The driver sees one row per shard.  Windows run within a block or over block
totals, never over the documents of a shard.

Defined cases: null text has size 1 like empty text; repeated rows are placed
alike; an empty table gives an empty layout; input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.llm.common import ROW, driver_table, table, text_or_empty
from riskloom.session import cut_lineage, scratch_path

BLOCK_BYTES = 64 << 20   # a block holds about so many bytes at most,
BLOCKS_PER_SHARD = 16    # and a shard at least so many blocks
RANK_ROWS = 50_000       # rows per numbering window, on average
CODEC = "zstd"           # of the shards' files
OLD_SHARDS, NEW_SHARDS = 12, 16


# ---------------------------------------------------------------- the flow --

def _keep_and_fill(supply: Sequence[int], demand: Sequence[int]) -> list[list[int]]:
    flow = [[0] * len(demand) for _ in supply]
    surplus, deficit = list(supply), list(demand)
    for i in range(min(len(supply), len(demand))):
        flow[i][i] = min(supply[i], demand[i])
        surplus[i] -= flow[i][i]
        deficit[i] -= flow[i][i]
    i = j = 0
    while i < len(surplus) and j < len(deficit):
        moved = min(surplus[i], deficit[j])
        flow[i][j] += moved
        surplus[i] -= moved
        deficit[j] -= moved
        if surplus[i] == 0:
            i += 1
        else:
            j += 1
    return flow


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost=None) -> list[list[int]]:
    """Bytes from each old shard to each new one, at the least total cost.

    ``cost(i, j)``: per byte, 0 or more; 0 for staying and 1 for moving by
    default.  Sends min(sum of supply, sum of demand) bytes.

    By default a shard keeps what it can hold: at most the sum of
    min(supply, demand) bytes can stay at all, so that is the least that moves,
    and any way of filling the deficits from the surpluses completes it; one
    walk along both does.  Other costs go through successive shortest paths
    with potentials on the bipartite graph of shards, whose time grows about
    with the cube of the shards: up to some hundred of them.
    """
    if cost is None:
        return _keep_and_fill(supply, demand)
    n, m = len(supply), len(demand)
    s, t = n + m, n + m + 1
    edges: list[list] = []      # [to, capacity left, cost]; the twin at index ^ 1
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a, b, cap, c):
        at[a].append(len(edges))
        edges.append([b, cap, c])
        at[b].append(len(edges))
        edges.append([a, 0, -c])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, min(x, demand[j]), cost(i, j))
    for j, x in enumerate(demand):
        edge(n + j, t, x, 0)
    price = [0] * (n + m + 2)
    while True:
        dist, back, queue = {s: 0}, {}, [(0, s)]
        while queue:
            d, a = heappop(queue)
            if d > dist[a]:
                continue
            for k in at[a]:
                b, cap, c = edges[k]
                if cap and (new := d + c + price[a] - price[b]) < dist.get(b, float("inf")):
                    dist[b], back[b] = new, k
                    heappush(queue, (new, b))
        if t not in dist:
            break
        for v in range(n + m + 2):
            price[v] += dist.get(v, dist[t])
        path, v = [], t
        while v != s:
            path.append(back[v])
            v = edges[back[v] ^ 1][0]
        amount = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= amount
            edges[k ^ 1][1] += amount
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for k in at[i]:
            if k % 2 == 0:
                flow[i][edges[k][0] - n] += edges[k ^ 1][1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


# -------------------------------------------------------------- the layout --

@dataclass(frozen=True)
class Layout:
    """Where the documents are: folders of whole blocks that are still valid,
    and one folder of rewritten blocks."""

    spark: SparkSession
    row: StructType             # the documents' columns
    blocks: str                 # shard=i/block=k/...: the row, its size and hash
    dropped: DataFrame | None   # (shard, block) no longer valid in ``blocks``
    rewritten: str | None       # shard=j/...
    flow: list[list[int]] | None = None

    def stored(self, path: str, *parts: str) -> DataFrame:
        """The files below ``path``; an empty table has none to take a schema from."""
        schema = StructType().add(ROW, self.row).add("_h", "long").add("_size", "long")
        for p in parts:
            schema = schema.add(p, "integer")
        return self.spark.read.schema(schema).parquet(path)

    def read(self) -> DataFrame:
        """Every row as (``_row``, _h, _size, shard)."""
        old = self.stored(self.blocks, "shard", "block")
        if self.dropped is None:
            return old.select(ROW, "_h", "_size", "shard")
        gone = self.dropped.select(F.col("shard").alias("_gs"), F.col("block").alias("_gb"))
        kept = old.join(gone, (F.col("shard") == F.col("_gs")) & (F.col("block") == F.col("_gb")), "left_anti")
        new = self.stored(self.rewritten, "shard")
        return kept.select(ROW, "_h", "_size", "shard").unionByName(new.select(ROW, "_h", "_size", "shard"))


def write_shards(df: DataFrame, shard: Column, path: str, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES, blocks_per_shard: int = BLOCKS_PER_SHARD) -> Layout:
    """``df`` as blocks below ``path``; ``shard``: an integer column."""
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), shard.cast("int").alias("shard"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("_size"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"))
    per_shard = [(r[0], r[1]) for r in rows.groupBy("shard").agg(F.sum("_size")).collect()]
    each = max(1, min(block_bytes, sum(b for _, b in per_shard) // max(1, len(per_shard) * blocks_per_shard)))
    sizes = driver_table(df.sparkSession, [(s, -(-b // each)) for s, b in per_shard], "_s int, _n long")
    placed = (rows.join(sizes, F.col("shard") == F.col("_s"))
              .withColumn("block", F.pmod(F.shiftright("_h", 8), F.col("_n")).cast("int")).drop("_s", "_n"))
    placed.repartition("shard", "block").write.partitionBy("shard", "block").option("compression", CODEC).parquet(path)
    return Layout(df.sparkSession, rows.schema[ROW].dataType, path, None, None)


def _marks(spark: SparkSession, flow: list[list[int]], moves_first: bool) -> DataFrame:
    """Per old shard: where on its line of bytes an interval ends, and the
    new shard of each interval."""
    rows = []
    for i, out in enumerate(flow):
        parts = sorted(((j, b) for j, b in enumerate(out) if b), key=lambda x: ((x[0] == i) == moves_first, x[0])) or [(i, 0)]
        ends, at = [], 0
        for _, b in parts[:-1]:
            at += b
            ends.append(at)
        rows.append((i, ends, [j for j, _ in parts]))
    return driver_table(spark, rows, "_i int, _ends array<long>, _to array<int>")


def _target(at: str) -> Column:
    return F.expr(f"element_at(_to, size(filter(_ends, e -> e <= {at})) + 1)")


def _assign(rows: DataFrame, block: str, order: list[str], flow: list[list[int]], moves_first: bool = False) -> DataFrame:
    """``rows`` (shard, ``block``, _size, ...) with _new, the shard the flow
    sends each to, and _cut, whether its block is split.

    A shard's line is its blocks in order.  A block that lies inside one of
    the flow's intervals goes whole; in a block that an interval's end cuts, a
    row goes by the middle of its own stretch in ``order``."""
    keep = [*rows.columns, "_new", "_cut"]
    blocks = (rows.groupBy("shard", block).agg(F.sum("_size").alias("_b"))
              .withColumn("_hi", F.sum("_b").over(Window.partitionBy("shard").orderBy(block)))
              .withColumn("_lo", F.col("_hi") - F.col("_b"))
              .join(_marks(rows.sparkSession, flow, moves_first), F.col("shard") == F.col("_i"))
              .select(F.col("shard").alias("_bs"), F.col(block).alias("_bb"), "_lo", "_ends", "_to",
                      _target("_lo").alias("_first"), _target("_hi - 1").alias("_last")))
    on = (F.col("shard") == F.col("_bs")) & (F.col(block) == F.col("_bb"))
    whole = rows.join(blocks.filter("_first = _last"), on).withColumn("_new", F.col("_first")).withColumn("_cut", F.lit(False))
    inside = Window.partitionBy("shard", block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    split = (rows.join(blocks.filter("_first != _last"), on)
             .withColumn("_at", F.col("_lo") + F.sum("_size").over(inside) - F.expr("(_size + 1) div 2"))
             .withColumn("_new", _target("_at")).withColumn("_cut", F.lit(True)))
    return whole.select(*keep).unionByName(split.select(*keep))


def _per_shard(df: DataFrame, shard: str, n: int) -> list[int]:
    out = [0] * n
    for r in df.groupBy(shard).agg(F.sum("_size").alias("b")).collect():
        out[r[0]] = r["b"]
    return out


def reshard(layout: Layout, path: str, shards: int, cost=None) -> Layout:
    """``layout`` dealt to ``shards`` shards of equal capacity; the blocks the
    flow touches are written anew below ``path``."""
    spark = layout.spark
    old = layout.stored(layout.blocks, "shard", "block")
    narrow = old.select("shard", "block", "_size", "_h")
    n_old = max([r[0] for r in narrow.groupBy("shard").count().collect()], default=-1) + 1
    before = _per_shard(narrow, "shard", n_old)
    caps = equal_capacities(sum(before), shards)
    flow = min_cost_flow(before, caps, cost)
    first = cut_lineage(_assign(narrow, "block", ["_h"], flow), "first")
    touched = cut_lineage(first.groupBy("shard", "block").agg(F.max("_cut").alias("cut"), F.max("_new").alias("to"))
                          .filter("cut or to != shard"), "touched")
    # dealt document by document: the split blocks, and of the blocks moved whole one per receiving shard
    loose = touched.filter("not cut").groupBy("to").agg(F.min(F.struct("shard", "block")).alias("b")).select("b.shard", "b.block")
    loose = touched.filter("cut").select("shard", "block").unionByName(loose).select(F.col("shard").alias("_ts"), F.col("block").alias("_tb"))
    loose = cut_lineage(loose, "loose")
    on = (F.col("shard") == F.col("_ts")) & (F.col("block") == F.col("_tb"))
    moved = touched.filter("not cut").join(loose, on, "left_anti").select(F.col("shard").alias("_ts"), F.col("block").alias("_tb"), "to")
    # rows with one hash are copies: they go together
    split = cut_lineage(first.join(loose, on, "left_semi").groupBy("shard", "block", "_h")
                        .agg(F.min("_new").alias("_new"), F.sum("_size").alias("_size")), "split")
    now = [a + b for a, b in zip(_per_shard(first.join(loose, on, "left_anti"), "_new", shards), _per_shard(split, "_new", shards))]
    again = split.select(F.col("_new").alias("shard"), F.col("shard").alias("_s0"), F.col("block").alias("_b0"), "_size", "_h")
    # smallest first: the line's blocks are size classes, split by hash
    fine = max(1, -(-split.count() // (RANK_ROWS * shards)))
    again = again.withColumn("_class", (F.floor(F.log2("_size")) * fine + F.pmod("_h", F.lit(fine))).cast("long"))
    second = _assign(again, "_class", ["_size", "_h"], min_cost_flow(now, caps, cost), moves_first=True)
    final = second.select(F.col("_s0").alias("_fs"), F.col("_b0").alias("_fb"), F.col("_h").alias("_fh"), "_new")
    whole = old.join(moved, on).select(ROW, "_h", "_size", F.col("to").alias("shard"))
    parted = (old.join(loose, on, "left_semi")
              .join(final, (F.col("shard") == F.col("_fs")) & (F.col("block") == F.col("_fb")) & (F.col("_h") == F.col("_fh")))
              .select(ROW, "_h", "_size", F.col("_new").alias("shard")))
    whole.unionByName(parted).write.partitionBy("shard").option("compression", CODEC).parquet(path)
    return Layout(spark, layout.row, layout.blocks, touched.select("shard", "block"), path, flow)


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, _h, ...) with slot, gapless from 0 in each shard:
    ranks inside hash buckets plus the rows of the buckets before."""
    n = max(1, -(-max([r["count"] for r in rows.groupBy("shard").count().collect()], default=0) // RANK_ROWS))
    rows = rows.withColumn("_k", F.pmod(F.shiftright("_h", 20), F.lit(n)))
    before = (rows.groupBy("shard", "_k").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_off", F.sum("_c").over(Window.partitionBy("shard").orderBy("_k")) - F.col("_c"))
              .select(F.col("shard").alias("_ps"), F.col("_k").alias("_pk"), "_off"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("shard", "_k").orderBy("_h")))
    return (ranked.join(before, (F.col("shard") == F.col("_ps")) & (F.col("_k") == F.col("_pk")))
            .withColumn("slot", (F.col("_off") + F.col("_r") - 1).cast("long")).drop("_k", "_ps", "_pk", "_off", "_r"))


def op4_sharding(spark, sf_dir):
    """All documents, stored in 12 shards by source, dealt to 16 of near equal
    bytes; the result is read back from the files."""
    docs = table(spark, sf_dir, "documents")
    by_source = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    layout = reshard(write_shards(docs, by_source, scratch_path(spark, "shards")), scratch_path(spark, "reshard"), NEW_SHARDS)
    text = text_or_empty(F.col(ROW)["text"])
    rows = cut_lineage(layout.read().select(
        F.col(ROW)["doc_id"].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "_h"), "placed")
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
