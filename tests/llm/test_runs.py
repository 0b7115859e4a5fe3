import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import runs
from tests.llm.conftest import DOC_SCHEMA, doc_rows

WORD = r"[^\x20\x09-\x0D]+"


def brute(w):
    """Every run by comparing each word with the one q on, for every q."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q):
                out.setdefault((s, i + q), q)     # the smallest period comes first
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(w, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def odd_text(rng):
    """Words with nested, broken, touching and Sturmian repetitions."""
    w = []
    while len(w) < rng.choice([10, 60, 200, 400]):
        alphabet = "ab" if rng.random() < 0.6 else "abcdefghij"
        kind = rng.random()
        if kind < 0.3:
            w += rng.choices(alphabet, k=rng.randint(1, 30))
        elif kind < 0.9:
            u = rng.choices(alphabet, k=rng.randint(1, 40))
            if rng.random() < 0.4:
                u = u[:rng.randint(1, 5)] * rng.randint(1, 8) + u
            t = u * rng.randint(3, 8)
            w += t[rng.randint(0, 5):len(t) - rng.randint(0, 5)]
        else:
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randint(4, 9)):
                a, b = b, b + a
            w += b
    return w


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_odd_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [odd_text(rng) for _ in range(rng.randint(1, 4))]
        got, kept = runs._runs_of([" ".join(t).encode() for t in texts])
        for t, g, k in zip(texts, got, kept):
            want = brute(t)
            assert [(x["start"], x["length"], x["period"]) for x in g] == want
            assert k.decode() == collapsed(t, want)


@pytest.mark.parametrize("n", [23, 24, 25, 71, 72, 73])
def test_limits(n):
    for q in (1, 7, 8, 9, 23, 24, 25):
        w = [f"w{i % q}" for i in range(n)]
        got, _ = runs._runs_of([" ".join(w).encode()])
        assert [(x["start"], x["length"], x["period"]) for x in got[0]] == ([(0, n, q)] if n >= max(24, 3 * q) else [])


def test_wavelet_matrix_against_sorting():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)
    m = runs.WaveletMatrix(values, 10)
    for left, right, x in rng.integers(0, 1001, (200, 3)):
        left, right = min(left, right), max(left, right)
        part = np.sort(values[left:right])
        q = lambda f, v: f(np.array([left]), np.array([right]), np.array([v]))[0]  # noqa: E731,B023
        assert q(m.below, min(x, 1000)) == np.searchsorted(part, min(x, 1000))
        if len(part):
            k = int(x) % len(part)
            assert q(m.nth, k) == part[k]


def test_long_texts_in_time_and_whole():
    """A million words of one run, and of prose with a run at its end."""
    start = time.time()
    got, kept = runs._runs_of([b" ".join([b"x", b"y", b"z"] * 330_000)])
    assert got == [[{"start": 0, "length": 990_000, "period": 3}]] and kept == [b"x y z"]
    rng = random.Random(1)
    prose = [str(rng.getrandbits(40)) for _ in range(300_000)]
    tail = [f"t{i}" for i in range(1000)]
    got, kept = runs._runs_of([" ".join(prose + tail * 3).encode()])
    assert got == [[{"start": 300_000, "length": 3000, "period": 1000}]] and kept == [" ".join(prose + tail).encode()]
    assert time.time() - start < 60


def expected(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(WORD, text or "")
        n = len(w)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w) if n < 5000 else None
        out.append((doc_id, w, found))
    return out


def test_query_against_brute_force(spark, odd_rows, tmp_path):
    rng = random.Random(2)
    more = [(1000 + i, " ".join(odd_text(rng)), "en", "s1") for i in range(120)]
    rows = odd_rows + more
    spark.createDataFrame(doc_rows(rows), DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, runs.op11_periodic_run_detection(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, w, found in expected([(r[0], r[1]) for r in rows]):
        if found is None:       # very long and not periodic
            found = []
        top = max(found, key=lambda z: (Fraction(z[1], z[2]), -z[0], -z[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                     digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(collapsed(w, found))))
    assert got == sorted(want, key=str)


def test_columns_and_empty_table(spark, odd, empty):
    clash = odd.withColumn("runs", odd["th"]).withColumn("_text", odd["source"])
    out = runs.periodic_runs(clash)
    assert out.columns == [c for c in clash.columns if c != "runs"] + ["runs", "collapsed"]
    assert out.count() == odd.count()
    assert {r["collapsed"] for r in out.filter("text is null or trim(text) = ''").collect()} == {""}
    assert runs.periodic_runs(empty).collect() == []
