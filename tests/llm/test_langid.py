import itertools
import random

import numpy as np

from riskloom.llm import langid
from riskloom.llm.textvec import chunks
from tests.llm.conftest import SYLLABLES, prose

import pyarrow as pa


def best_path(s, switch):
    n, m = s.shape
    score = lambda p: sum(s[i, l] for i, l in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return max(score(p) for p in itertools.product(range(m), repeat=n))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s, switch = -rng.random((int(rng.integers(1, 7)), 3)) * 6, float(rng.uniform(0, 8))
        p = langid.viterbi(s, switch)
        got = s[np.arange(len(p)), p].sum() - switch * (p[1:] != p[:-1]).sum()
        assert abs(got - best_path(s, switch)) < 1e-9


def test_texts_that_cannot_switch_are_constant():
    """The test that spares the recursion never spares a text that switches."""
    rng = np.random.default_rng(2)
    spared = 0
    for _ in range(300):
        sizes = rng.integers(1, 30, int(rng.integers(1, 6)))
        s = -rng.random((sizes.sum(), 3)) * rng.choice([2.0, 6.0])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        base = np.add.reduceat(s, first, axis=0).argmax(1)
        may = langid._may_switch(s, doc, first, np.repeat(base, sizes), 9.0)
        for k, (a, n) in enumerate(zip(first, sizes)):
            if not may[k]:
                spared += 1
                p = langid.viterbi(s[a:a + n], 9.0)
                assert abs(s[a:a + n, base[k]].sum() - (s[a + np.arange(n), p].sum() - 9.0 * (p[1:] != p[:-1]).sum())) < 1e-9
    assert spared > 100


def test_words_and_scripts():
    texts = ["Das läuft, ok?", None, "", "1 2 3", "привет мир", "γειά 中文 한글", "x" * 9]
    found = []
    for first, _to, data, offsets in chunks(pa.array(texts), 10):
        w = langid.words_in(data, offsets, 12)
        for d, a, b, sc in zip(w.doc, w.start, w.end, w.script):
            found.append((first + int(d), bytes(data[a:b]).decode(), langid.SCRIPT_NAMES[sc]))
        assert len(w.tri) == (w.end - w.start).sum()
    assert found == [(0, "Das", "latin"), (0, "läuft", "latin"), (0, "ok", "latin"), (4, "привет", "cyrillic"), (4, "мир", "cyrillic"),
                     (5, "γειά", "greek"), (5, "中文", "han"), (5, "한글", "hangul"), (6, "x" * 9, "latin")]


def test_chunk_size_does_not_matter():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 60), lang) for lang in SYLLABLES for _ in range(5)]
    rows = []
    for size in (1, 1 << 20):
        got = []
        for _, _, data, offsets in chunks(pa.array(texts), size):
            w = langid.words_in(data, offsets, 12)
            got.append((w.word, w.tri, w.script))
        rows.append([np.concatenate(x) for x in zip(*got)])
    assert all(np.array_equal(a, b) for a, b in zip(*rows))


def corpus(spark, n=40, seed=6):
    rng = random.Random(seed)
    rows = [(prose(rng, rng.randint(20, 120), lang), lang) for lang in SYLLABLES for _ in range(n)]
    rows += [("это простой русский текст о погоде и людях " * 3, "ru")] * 3
    return spark.createDataFrame(rows, "text string, lang string")


def test_spans_of_mixed_text(spark):
    rng = random.Random(8)
    model = langid.learn(corpus(spark))
    assert model.langs == ["de", "en", "es", "fr", "ru"]
    parts = [prose(rng, 60, "en").replace("\n", " "), prose(rng, 40, "fr").replace("\n", " "), "погода и люди в городе", prose(rng, 70, "de").replace("\n", " ")]
    text = " ".join(parts)
    [r] = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, with_spans=True).collect()
    assert [s.lang for s in r.spans] == ["en", "fr", "ru", "de"] and r.n_spans == 4
    raw, at = text.encode(), 0
    for s, p in zip(r.spans, parts):
        # a border may be a few words off, where they suit both languages
        assert abs(s.start - at) < 40
        at += len(p.encode()) + 1
        raw[s.start:s.end].decode()
    assert r.lang_pred in ("en", "de") and 0 < r.score < 1


def test_defined_cases(spark, odd, odd_rows, empty):
    model = langid.learn(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add((r.lang_pred, r.score))
        assert 0 <= float(r.score) <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert all(len(v) == 1 for v in by.values())
    right = [r.lang_pred == r.lang for r in got if r.lang and len((r.text or "").split()) > 25]
    assert sum(right) >= 0.98 * len(right)
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_held_out_accuracy(spark):
    import zlib

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op7_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
