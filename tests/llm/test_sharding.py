import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskloom.llm import sharding
from riskloom.llm.common import ROW
from riskloom.session import scratch_path


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(30):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        supply = [rng.randint(0, 40) for _ in range(n)]
        caps = sharding.equal_capacities(sum(supply), m)
        flow = sharding.min_cost_flow(supply, caps)
        assert [sum(r) for r in flow] == supply
        assert [sum(r[j] for r in flow) for j in range(m)] == caps
        moved = sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j)
        assert moved == sum(max(0, s - (caps[i] if i < m else 0)) for i, s in enumerate(supply))


def test_default_flow_costs_what_the_general_solver_finds():
    rng = random.Random(8)
    for _ in range(30):
        supply, demand = ([rng.randint(0, 30) for _ in range(rng.randint(1, 7))] for _ in range(2))
        cost = lambda i, j: int(i != j)
        total = lambda flow: sum(cost(i, j) * x for i, r in enumerate(flow) for j, x in enumerate(r))  # noqa: E731,B023
        a, b = sharding.min_cost_flow(supply, demand), sharding.min_cost_flow(supply, demand, cost)
        assert sum(map(sum, a)) == sum(map(sum, b)) == min(sum(supply), sum(demand))
        assert total(a) <= total(b) and all(sum(r) <= s for r, s in zip(a, supply)) and all(sum(c) <= d for c, d in zip(zip(*a), demand))


def test_many_shards_at_once():
    import time

    rng = random.Random(1)
    start = time.time()
    supply = [rng.randint(0, 10 ** 12) for _ in range(1000)]
    caps = sharding.equal_capacities(sum(supply), 1250)
    flow = sharding.min_cost_flow(supply, caps)
    assert time.time() - start < 5 and [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == caps
    assert sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j) == sum(max(0, s - c) for s, c in zip(supply, caps))


def test_flow_with_other_costs_is_optimal():
    rng = random.Random(3)
    for _ in range(20):
        cost = [[rng.randint(0, 9) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow([1, 1, 1], [1, 1, 1], lambda i, j: cost[i][j])
        got = sum(cost[i][j] * flow[i][j] for i in range(3) for j in range(3))
        assert got == min(sum(cost[i][p[i]] for i in range(3)) for p in itertools.permutations(range(3)))


def placed(df, spark, shards=4):
    layout = sharding.write_shards(df, F.pmod(F.xxhash64("source"), F.lit(3)), scratch_path(spark, "s"))
    layout = sharding.reshard(layout, scratch_path(spark, "r"), shards)
    return sharding.with_slots(layout.read())


@pytest.mark.parametrize("longest", [10_000, 10_000_000])
def test_shards_hold_every_row_and_are_even(spark, odd, odd_rows, longest):
    odd_rows = [r for r in odd_rows if len(r[1] or "") <= longest]
    rows = placed(odd.filter(F.coalesce(F.length("text"), F.lit(0)) <= longest), spark).collect()
    key = lambda i, t: (i is None, i, t is None, t)
    assert sorted(key(r[ROW]["doc_id"], r[ROW]["text"]) for r in rows) == sorted(key(i, t) for i, t, _, _ in odd_rows)
    sizes = [0] * 4
    for r in rows:
        assert r["_size"] == len((r[ROW]["text"] or "").encode()) + 1
        assert r[ROW]["shard"] == 3      # the input's own column is untouched
        sizes[r["shard"]] += r["_size"]
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    big = max(r["_size"] for r in rows)
    if big < sum(sizes) / 4:    # else one text alone is more than a shard's share
        assert max(sizes) - min(sizes) <= big


def test_untouched_blocks_stay(spark, odd):
    layout = sharding.write_shards(odd, F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)), scratch_path(spark, "s"))
    again = sharding.reshard(layout, scratch_path(spark, "r"), 4)
    assert again.dropped.count() < spark.read.parquet(layout.blocks).select("shard", "block").distinct().count()
    assert again.read().count() == odd.count()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_query_on_documents(spark, small):
    rows = sharding.op4_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in small.collect()}
    assert len(rows) == len(texts)
    sizes = [0] * 16
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        sizes[r["shard"]] += r["size"]
    assert max(sizes) <= 1.35 * min(sizes)


def test_empty(spark, empty):
    assert placed(empty, spark).count() == 0
