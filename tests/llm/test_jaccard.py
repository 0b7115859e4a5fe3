import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest

from riskloom.llm import jaccard, textvec
from riskloom.llm.components import components
from riskloom.llm.keyfilter import KeyFilter
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def brute(rows):
    """(id, set size, component id) per row, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t, *_ in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k
    for k, s in enumerate(sets):
        common = Counter(o for x in s for o in holders[x] if o < k)
        for o, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                a, b = find(k), find(o)
                top[max(a, b)] = min(a, b)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, *_) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.link_documents(df).collect()), key=str)


def test_chunks_give_the_same_sets():
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(60)] + ["", None, "a", "a b", " a\x0bb\tc ", "É é Z z x y", "w " * 400]
    column = pa.array(texts, pa.string()).slice(3)
    for size in (1, 100, 1 << 20):
        got = []
        for _, _, data, offsets in textvec.chunks(column, size):
            s, at = jaccard.shingle_sets(data, offsets)
            got += [s[at[i]:at[i + 1]].tolist() for i in range(len(at) - 1)]
        assert [len(g) for g in got] == [len(shingles(t)) for t in texts[3:]]
        if size == 1:
            first = got
        assert got == first


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_rule_out_a_link(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        keep = rng.random(len(a)) < rng.uniform(0.7, 1)
        b = np.unique(np.concatenate((a[keep], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, n // 5))), dtype=np.uint64))))
        common, na, nb = len(np.intersect1d(a, b)), len(a), len(b)
        linked = len(b) and 100 * common >= 75 * (na + nb - common)
        if not linked:
            continue
        maps = [jaccard.bitmap(a), jaccard.bitmap(b)]
        size = min(map(len, maps))
        x, y = (jaccard.as_words([m], size) for m in maps)
        assert jaccard.possible(x, y, np.array([na]), np.array([nb]))[0]
        assert abs(int(jaccard.band_of(np.array([na]))[0]) - int(jaccard.band_of(np.array([nb]))[0])) <= 1
        small, large = sorted((a, b), key=len)
        order = np.random.default_rng(seed + 9).permutation(np.union1d(a, b))
        rank = {int(v): k for k, v in enumerate(order)}
        first = lambda s, k: set(sorted((int(v) for v in s), key=rank.get)[:k])
        assert first(small, jaccard.short_prefix_length(len(small))) & first(large, jaccard.prefix_length(len(large)))


def test_groups_do_not_depend_on_batches():
    rng = random.Random(3)
    rows = sorted({(rng.randint(0, 30), n := rng.choice([4, 5, 40, 41, 300]), n * 100 + rng.randint(0, 3)) for _ in range(300)})
    rows = sorted(rows + rng.choices(rows, k=60))
    tok, n, cid = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(tok), pa.array([-1] * len(rows)), pa.array(cid), pa.array(n, pa.int32()), pa.array([True] * len(rows))],
                                       ["token", "part", "cid", "n", "short"])
    want = []
    for t in sorted(set(tok)):
        own = sorted({(k, c) for x, k, c in rows if x == t})
        if len(own) > 1:
            lead = {}
            for k, c in own:
                b = int(jaccard.band_of(np.array([k]))[0])
                want.append((t, b, c, k, lead.setdefault(b, c)))
    for step in (1, 2, 7, 1000):
        out = jaccard._groups(batch.slice(i, step) for i in range(0, len(rows), step))
        got = [r for b in out for r in zip(*(b.column(c).to_pylist() for c in ("token", "band", "cid", "n", "lead")))]
        assert got == want


def test_parts_of_a_hot_shingle_keep_single_classes():
    rows = [(1, 0, 10, 100), (1, 0, 11, 101), (1, 2, 10, 102), (2, -1, 9, 103), (3, 1, 9, 104)]
    tok, part, n, cid = zip(*rows)
    batch = pa.RecordBatch.from_arrays([pa.array(tok), pa.array(part), pa.array(cid), pa.array(n, pa.int32()), pa.array([True] * 5)], ["token", "part", "cid", "n", "short"])
    for step in (1, 2, 5):
        out = jaccard._groups(batch.slice(i, step) for i in range(0, 5, step))
        got = [r for b in out for r in zip(*(b.column(c).to_pylist() for c in ("token", "cid", "lead")))]
        assert got == [(1, 100, 100), (1, 101, 100), (1, 102, 102), (3, 104, 104)]


def test_key_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(30_000).selectExpr("xxhash64(id) as k")
    f = KeyFilter(keys)
    got = f.flagged(spark.range(60_000), F.xxhash64("id"), "hit").groupBy(F.expr("id < 30000").alias("own"), "hit").count().collect()
    n = {(r["own"], r["hit"]): r["count"] for r in got}
    assert n[True, True] == 30_000 and (True, False) not in n and n.get((False, True), 0) < 600
    none = KeyFilter(keys.limit(0)).flagged(spark.range(10), F.xxhash64("id"), "hit")
    assert none.filter("hit").count() == 0 and none.count() == 10


def test_superseded_tables_are_deleted(odd, tmp_path, monkeypatch):
    from riskloom import session

    monkeypatch.setattr(session, "checkpoint_root", lambda spark: str(tmp_path))
    jaccard.link_documents(odd).collect()
    assert {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()} == {"linked"}
    jaccard.keep_one(odd).collect()
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["judged", "linked"]


def test_equals_brute_force(odd, odd_rows):
    assert result(odd) == brute(odd_rows)


def test_one_of_each_group_stays(odd, odd_rows):
    got = jaccard.keep_one(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    want = brute(odd_rows)
    groups = {c for i, n, c in want if n}
    sets = [shingles(r.text) for r in rows]
    # two documents of one id are groups of their own
    assert sum(bool(s) for s in sets) == len(groups) + 1
    assert sum(not s for s in sets) == sum(not shingles(t) for _, t, *_ in odd_rows)
    assert {r.doc_id for r, s in zip(rows, sets) if s} == groups


@pytest.mark.parametrize("rounds,tile", [(2, 4), (0, 3)])
def test_large_group_of_near_copies(spark, monkeypatch, rounds, tile):
    """Links near the threshold, also when tiles are tiny and stars are off."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rng = random.Random(11)
    base, shared = prose(rng, 150).split(), prose(rng, 60).split()
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 5)}"
        cut = rng.randint(0, 25)
        rows.append((k, " ".join(w[cut:]), None, None))
    rows += [(100 + k, prose(rng, rng.randint(5, 60)) + " " + " ".join(shared) + " " + prose(rng, rng.randint(1, 60)), None, None) for k in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    got = result(df)
    assert got == brute(rows)
    assert 2 < len({c for _, _, c in got}) < len(rows)


def test_twins_agree_in_their_short_prefixes(spark):
    rows = [(t, 0, c, 5, s) for t, flags in ((1, "tf"), (2, "ft"), (3, "tf"), (4, "tt")) for c, s in zip((7, 8), (x == "t" for x in flags))]
    df = spark.createDataFrame(rows, "token long, band int, cid long, n int, short boolean")
    assert sorted({r.token for r in jaccard._without_twins(df).collect()}) == [1, 2, 4]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(40)]
    top = {}

    def find(k):
        while top.setdefault(k, k) != k:
            k = top[k]
        return k
    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in top if find(k) != k}


def test_empty(empty):
    assert jaccard.link_documents(empty).count() == 0
    assert jaccard.keep_one(empty).count() == 0
