import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from riskloom.llm import mixing


def naive_sainte_lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(20))
def test_sainte_lague_equals_highest_quotients(seed):
    rng = random.Random(seed)
    weights = [rng.randint(0, 50) for _ in range(rng.randint(1, 9))]
    seats = rng.randint(0, 300)
    if not sum(weights):
        assert mixing.sainte_lague(weights, seats) == [0] * len(weights)
    else:
        assert mixing.sainte_lague(weights, seats) == naive_sainte_lague(weights, seats)


def test_targets_share_all_sizes_and_stop_at_three_times():
    t = mixing.source_targets([100, 1, 10], [1.0, 2.0, 3.0])
    assert t[1] == 3 and t[2] == 30 and t[0] == pytest.approx(78)
    assert mixing.source_targets([], []) == []
    assert mixing.source_targets([0, 0], [1.0, 2.0]) == [0.0, 0.0]


def brute_targets(rows):
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, total = {}, sum(size.values())
    while True:
        left = total - sum(target.values())
        free = [s for s in sources if s not in target]
        share = {s: Fraction(left * weights[s], sum(weights[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return size, {**target, **share}
        for s in over:
            target[s] = Fraction(3 * size[s])


def test_mix_meets_targets(odd, odd_rows):
    got = mixing.mix(odd, keep=["doc_id", "source"]).collect()
    assert len(got) == len(odd_rows)
    size, target = brute_targets(odd_rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(float(target[r["source"]]))
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - float(t)) <= max(20, 0.02 * float(t))
    again = mixing.mix(odd.repartition(5), keep=["doc_id", "source"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("bucket_rows", [2, 7, 20_000])
def test_whole_documents_against_the_line_itself(odd, monkeypatch, bucket_rows):
    """Copies by walking along each source's line, document by document."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rows = odd.selectExpr("doc_id", "text", "source", "xxhash64(7, doc_id, text) as h", "pmod(xxhash64(7, doc_id, text), 16) as shard").collect()
    rows = [(r, len([w for w in re.split("[\x20\x09-\x0d]+", r["text"] or "") if w])) for r in rows]
    line = Counter()
    for r, n in rows:
        line[r["source"], r["shard"]] += n
    count = Counter((r["source"], r["shard"]) for r, _ in rows)
    plan = mixing.quota_plan([(*k, n, count[k]) for k, n in line.items()])
    quota = {p[0]: p[-1] for p in plan}
    size, _ = brute_targets([(0, r["text"], 0, r["source"]) for r, _ in rows])
    n_buckets = max(1, -(-max(count.values()) // bucket_rows))
    want, at = Counter(), Counter()
    for r, n in sorted(rows, key=lambda x: (x[0]["shard"], (x[0]["h"] >> 16) % n_buckets, x[0]["h"], x[0]["doc_id"] or -1, x[1])):
        s = r["source"]
        if n:
            want[r["doc_id"], r["text"]] += quota[s] // size[s] + (2 * at[s] + n <= 2 * (quota[s] % size[s]))
        else:
            want[r["doc_id"], r["text"]] += 1
        at[s] += n
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +want


@pytest.mark.parametrize("n_blocks", [4, 100, mixing.N_BLOCKS])
def test_small_sources_meet_their_targets_whatever_the_block(n_blocks):
    rng = random.Random(n_blocks)
    size = {"a": 12_000, "b": 50_000, "c": 100_000, "d": 200_000, "e": 5_000_000_000, "f": 7, "g": 0}
    rows = []
    for s, n in size.items():
        cuts = sorted(rng.randint(0, n) for _ in range(15))
        rows += [(s, k, b - a, 10) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n]))]
    target = dict(zip(size, mixing.source_targets(list(size.values()), [1.0, 2.0, 3.0] * 2 + [1.0])))
    taken, before = Counter(), Counter()
    for src, _, _, source_size, t, block, passes, picked, blocks, start, at, quota in mixing.quota_plan(rows, n_blocks):
        n = [r[2] for r in rows if r[0] == src][sum(1 for x in before.elements() if x == src)]
        before[src] += 1
        assert t == target[src] and source_size == size[src] and (blocks + start) * picked < 2 ** 63
        taken[src] += passes * n + min(n, picked * block)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(16, 0.01 * t), (s, taken[s], t)


def test_more_sources_than_blocks(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(50, 90), "en", f"s{i % 60:02}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = Counter()
    for r in mixing.mix(df, keep=["doc_id", "source"], n_blocks=10).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in brute_targets(rows)[1].items():
        assert abs(taken[s] - float(t)) <= max(20, 0.02 * float(t))


def test_what_a_shard_cannot_take_goes_to_the_others():
    assert mixing.capped_seats([1, 1, 1], [1, 5, 5], 9) == [1, 4, 4]
    assert mixing.capped_seats([5, 1], [9, 9], 30) == [9, 9]
    assert mixing.capped_seats([], [], 3) == []


def test_pipeline_places_whole_documents(spark):
    import corpus_pipeline

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(rng.randint(20, 600))), "en", f"s{min(i % 10, 3)}") for i in range(400)]
    rows += [(400, "one two three four five", "en", "tiny"), (401, "", "en", "s0"), (402, None, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    texts = {i: t for i, t, *_ in rows}
    assert all(r.text == texts[r.doc_id] for r in got)
    assert all(n <= 3 for n in Counter(r.doc_id for r in got).values())
    assert [sum(r.doc_id == i for r in got) for i in (401, 402)] == [1, 1]
    size, target = brute_targets(rows)
    words = Counter()
    for r in got:
        words[r.source] += len((r.text or "").split())
    longest = max(len((t or "").split()) for t in texts.values())
    for s, t in target.items():
        assert abs(words[s] - float(t)) <= longest / 2 + 2, s
    again = corpus_pipeline.mix_sources(spark, df.repartition(7), "").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
