import random

import numpy as np
import pytest

from riskloom.llm import ranking
from tests.conftest import SF001
from tests.llm.conftest import DOC_SCHEMA, doc_rows, prose


def junk(rng, n):
    kind = rng.randrange(4)
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join([words[0]] * n) if kind == 2 else " | ".join(words)


def corpus(n=600):
    rng = random.Random(11)
    good = [rng.random() < 0.8 for _ in range(n)]
    rows = [(i, prose(rng, rng.randint(30, 200)) if g else junk(rng, rng.randint(30, 200)), "en", "s") for i, g in enumerate(good)]
    return rows, [(i, int(g), 0, "x") for i, g in enumerate(good)]


def brute_features(text):
    """The features of one text, character by character."""
    data = (text or "").encode()
    w = data.split()
    out = np.zeros(ranking.N_FEATURES)
    letter = lambda b: chr(b).isalpha() and b < 128 or b >= 128
    out[0] = np.log1p(len(w)) / 10
    if w:
        out[1] = np.log(len(set(w))) / np.log(len(w)) if len(w) > 1 else 1
        out[2] = max(w.count(x) for x in set(w)) / len(w) if len(w) >= 10 else 0
        out[3] = sum(a == b for a, b in zip(w, w[1:])) / len(w)
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[4] = 1 - len(set(lines)) / len(lines)
        out[5] = np.log1p(sum(map(len, w)) / len(w)) / 4
        out[6] = sum(not any(map(letter, x)) for x in w) / len(w)
        out[7] = sum(any(map(letter, x)) and all(65 <= b <= 90 for b in x if letter(b)) for x in w) / len(w)
        out[8] = sum(len(x) <= 2 for x in w) / len(w)
        out[9] = sum(len(x) > 24 for x in w) / len(w)
    c = [int(ranking._CLASS[b]) for b in data]
    pairs = np.zeros(64)
    for a, b in zip(c, c[1:]):
        pairs[a * 8 + b] += 1
    out[10:] = np.sqrt(pairs / max(pairs.sum(), 1))
    return out


def test_features_one_by_one():
    rng = random.Random(3)
    texts = ["", "a", " \n", "AB cd\nAB cd\n!! 12", "Ü ß 中文 #&|", "x" * 60, *(prose(rng, 50) for _ in range(5)), *(junk(rng, 40) for _ in range(8))]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    got = ranking.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, g in zip(texts, got):
        np.testing.assert_allclose(g, brute_features(t), atol=1e-12, err_msg=t[:40])


def test_weights_minimise_the_pairwise_loss(spark):
    """At the solution the gradient of the loss over the same pairs is 0."""
    rows, labels = corpus(200)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "id long, text string")
    known = spark.createDataFrame([(i, g) for i, g, _, _ in labels], "id long, good int")
    w = ranking.preference_weights(docs, known, sample=1000, rivals=4)
    f = np.array([brute_features(r[1]) for r in rows])
    good = np.array([g for _, g, _, _ in labels]) == 1
    worth = f @ w
    assert (worth[good][:, None] > worth[~good][None, :]).mean() > 0.99
    ids = ranking._sampled(known, 1000)
    a, b = ids[1], ids[0]
    n_pairs = 4 * max(len(a), len(b))
    hashed = {r["id"]: r["h"] for r in spark.range(n_pairs).selectExpr("id", f"pmod(xxhash64(id), {min(len(a), len(b))}) as h").collect()}
    big, small = (a, b) if len(a) >= len(b) else (b, a)
    pairs = [(big[i % len(big)], small[hashed[i]]) for i in range(n_pairs)]
    pairs = [(x, y) if big is a else (y, x) for x, y in pairs]
    spread = f.std(0, ddof=1)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
    d = np.array([(f[x] - f[y]) * scale for x, y in pairs])
    v = np.divide(w, scale, out=np.zeros_like(w), where=scale > 0)
    gradient = -(d / (1 + np.exp(d @ v))[:, None]).mean(0) + ranking.REGULARISATION * v
    assert np.abs(gradient).max() < 2e-3


def test_held_out_labels(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(doc_rows(rows), DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in ranking.op13_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["predicted"], g) for i, g, _, _ in labels if got[i]["held_out"]]
    assert len(held) > 80 and np.mean([p == g for p, g in held]) > 0.97


def test_given_tables(spark):
    got = {r["doc_id"]: r for r in ranking.op13_quality_classifier(spark, SF001).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    held = [(got[i]["predicted"], q) for i, q in labels.items() if got[i]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert {r["doc_id"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id").collect()} == set(got)


def test_held_out_labels_are_not_seen(spark, tmp_path):
    """Turning the held-out labels round changes no score."""
    rows, labels = corpus(150)
    df = spark.createDataFrame(doc_rows(rows), DOC_SCHEMA)
    scores = []
    for turned in (False, True):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
        out = "crc32(cast(doc_id as string)) % 5 = 0"
        if turned:
            known = known.selectExpr("doc_id", f"if({out}, 1 - quality, quality) as quality")
        from pyspark.sql import functions as F
        scores.append(sorted(map(tuple, ranking.rank(df, known, ~F.expr(out), keep=["doc_id"]).collect())))
    np.testing.assert_allclose([x[1] for x in scores[0]], [x[1] for x in scores[1]], atol=1e-9)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(None, 1), (3, None)], 0.5), ([(10 ** 9, 1)], 0.5)])
def test_too_few_labels(spark, odd, labels, score):
    from pyspark.sql import functions as F
    out = ranking.rank(odd, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in out.collect()} == {score} and out.count() == odd.count()


def test_odd_rows_and_empty_table(spark, odd, empty):
    from pyspark.sql import functions as F
    labels = odd.selectExpr("doc_id", "if(doc_id % 3 = 0, 0, 1) as quality", "text", "lang").unionAll(odd.selectExpr("doc_id", "null", "text", "lang"))
    out = ranking.rank(odd, labels, F.lit(True))
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"]
    got = out.collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert ranking.rank(empty, labels, F.lit(True)).collect() == []
