import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import lzprint
from riskloom.llm.lzprint import as_string, fingerprint, from_string, likeness


def naive_phrases(text):
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé中🙂 \n", max_size=300))
def test_phrases_are_those_of_the_plain_parse(text):
    ends = []
    lzprint.phrase_ends(text, 0, set(), ends, len(text))
    starts = [0, *ends[:-1]]
    assert {text[s:e] for s, e in zip(starts, ends)} == naive_phrases(text)
    assert len(lzprint.smallest_hashes(text, ends, 10_000)) == len(naive_phrases(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ", max_size=120), st.text(alphabet="ab ", max_size=120))
def test_edited_text_goes_on_from_the_middle(a, b):
    k = len(a) // 2
    edited = a[:len(a) - k] + b[:k]
    p = lzprint._Parsed(a, 16)
    assert np.array_equal(p.print, fingerprint(a, 16))
    text, fp = p.edited(b)
    assert text == edited and np.array_equal(fp, fingerprint(edited, 16))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_likeness_is_the_jaccard_index_of_the_smallest(a, b):
    k = 20
    x, y = (np.array(sorted(s)[:k], np.uint32) for s in (a, b))
    union = sorted(set(x.tolist()) | set(y.tolist()))[:k]
    want = float(not a and not b) if not a or not b else sum(u in a and u in b for u in union) / len(union)
    assert likeness(x, y, k) == want
    assert np.array_equal(from_string(as_string(x)), x)


def order(r):
    return (r[0] is None, r[0] if r[0] is not None else 0)


def check(got, rows):
    want, texts = [], [(i, t or "") for i, t, *_ in sorted(rows, key=order)]
    for n, (i, t) in enumerate(texts):
        other = texts[(n + 1) % len(texts)][1]
        k = len(t) // 2
        e = t[:len(t) - k] + other[:k]
        a, b, c = fingerprint(t), fingerprint(e), fingerprint(other)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_string(a), as_string(b), likeness(a, b), likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_next_document_over_ranges(spark, odd, odd_rows):
    ids = [r[0] for r in odd_rows]
    single = [r for r in odd_rows if ids.count(r[0]) == 1]   # order among equal ids is by hash
    repeated = {i for i in ids if ids.count(i) > 1}
    df = odd.filter(~odd.doc_id.isin([i for i in repeated]) | odd.doc_id.isNull())
    for ranges in (1, 3, 200):
        check(lzprint.compare_with_next(df, ranges=ranges).collect(), single)


def test_repeated_ids_keep_their_rows(odd, odd_rows):
    got = lzprint.compare_with_next(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t, *_ in odd_rows)


def test_single_and_empty(spark, empty):
    [r] = lzprint.compare_with_next(spark.createDataFrame([(4, "abcabc")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.n_chars == 6
    assert lzprint.compare_with_next(empty).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lzprint.op1_document_fingerprints(spark, sf).collect()
    check(got, rows)
    long = [r for r in got if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)
