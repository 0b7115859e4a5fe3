import re

import pytest

from riskloom.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), rep, n < 20 or 100 * rep > 30 * n)


def key(t):
    return (t is None, t or "")


def test_measures_equal_brute_force(spark, odd, odd_rows):
    more = spark.createDataFrame([(900, "a b c d e f g h i a b c d e f g h x\n" * 3), (901, "w " * 50), (902, "# * $$ <b> | é\n\n é")], "doc_id long, text string")
    for df, rows in ((odd, odd_rows), (more, [(r.doc_id, r.text) for r in more.collect()])):
        got = quality.judge(df, keep=["doc_id", "text"]).collect()
        a = sorted((key(r.text), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got)
        assert a == sorted((key(r[1]), brute(r[1])) for r in rows)
        assert all(not (r.kept and r.base_failed) and 0 <= r.quality <= 1 for r in got)


def test_estimates_find_the_bad_documents(spark):
    """Rules of known accuracy on documents of known quality."""
    import random

    rng = random.Random(4)
    names, rows = ["a", "b", "c", "d"], []
    for i in range(4000):
        good = rng.random() < 0.85
        votes = []
        for _ in names:
            if rng.random() < 0.2:
                votes.append(0)
            else:
                votes.append((1 if rng.random() < 0.992 else -1) if good else (-1 if rng.random() < 0.6 else 1))
        rows.append((good, *votes))
    df = spark.createDataFrame(rows, "good boolean, v_a int, v_b int, v_c int, v_d int")
    est = quality.estimate(df, names)
    assert abs(est.good - 0.85) < 0.05
    assert all(abs(est.on_good[r] - 0.992) < 0.01 and abs(est.on_bad[r] - 0.6) < 0.15 for r in names)
    kept = df.withColumn("p", est.posterior()).collect()
    assert sum((r.p >= 0.5) == r.good for r in kept) > 0.95 * len(kept)


@pytest.mark.parametrize("n_rules,right", [(4, 0.97), (8, 0.97), (8, 0.9)])
def test_rules_that_blame_good_documents_are_found_out(spark, n_rules, right):
    import random

    rng = random.Random(4)
    names, rows = [f"r{k}" for k in range(n_rules)], []
    for _ in range(4000):
        good = rng.random() < 0.85
        votes = [0 if rng.random() < 0.2 else (1 if rng.random() < right else -1) if good else (-1 if rng.random() < 0.6 else 1) for _ in names]
        rows.append((good, *votes))
    df = spark.createDataFrame(rows, "good boolean, " + ", ".join(f"v_{r} int" for r in names))
    est = quality.estimate(df, names)
    assert abs(est.good - 0.85) < 0.05
    assert all(abs(est.on_good[r] - right) < 0.03 and abs(est.on_bad[r] - 0.6) < 0.15 for r in names)
    clean = df.withColumn("p", est.posterior()).filter("good").collect()
    assert sum(r.p >= 0.5 for r in clean) > 0.97 * len(clean)


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    clean = [r for r in got if r.label == 1 and r.toxic == 0 and not r.base_failed]
    bad = [r for r in got if r.label == 0]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_empty(empty):
    assert quality.judge(empty).count() == 0
