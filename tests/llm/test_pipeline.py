import hashlib
import random

import pytest

import __spark_entry__ as E
import corpus_pipeline
from riskloom.llm import bpe, lines
from riskloom.session import cut_lineage
from tests.llm.conftest import prose
from tests.llm.test_jaccard import brute, shingles
from tests.llm.test_lines import brute as brute_lines

OPS = [f"op{n}_" for n in range(1, 14)]


def test_every_operator_and_the_pipeline_are_registered():
    names = list(E.queries())
    assert "pipeline" in names and all(sum(x.startswith(p) for x in names) == 1 for p in OPS)
    assert set(E.oracle_sql()) <= set(names)


def test_stages_one_by_one(spark, odd, odd_rows):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "mixing", "bpe"]
    docs = odd
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, before, ""), name)
        out[name] = docs
        if name != "bpe":
            assert docs.columns == odd.columns and docs.dtypes == odd.dtypes
    # 1: texts without a letter go, all prose stays
    kept = out["language_id"].collect()
    assert sorted(str(r.doc_id) + str(r.text) for r in kept) == sorted(
        str(i) + str(t) for i, t, *_ in odd_rows if any(c.isalpha() for c in t or ""))
    assert all(r.lang for r in kept)
    # 2: as the lines operator's brute force says, without the emptied
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept]
    want = [(i, t) for i, t, _, gone in brute_lines(rows, lines.threshold(len({s for *_, s in rows if s is not None}))) if not gone or t.strip(" \t\n\x0b\x0c\r")]
    second = out["line_dedup"].collect()
    assert sorted(((r.doc_id, r.text) for r in second), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in second)
    # 3: one of each group
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in second]
    third = out["ngram_jaccard"].collect()
    assert {r.doc_id for r in third if shingles(r.text)} == {c for _, n, c in brute(rows) if n}
    # 4 and 5: words as taken; ids of the texts of stage 4
    fourth = out["mixing"].collect()
    assert {r.doc_id for r in fourth} <= {r.doc_id for r in third}
    own = bpe.Bpe(bpe.default_vocabulary())
    want = []
    for r in fourth:
        ids = own.encode(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n_langs", [3, 7])
def test_texts_of_many_languages_stay_and_unknown_scripts_go(spark, n_langs):
    import random
    import string

    rng = random.Random(6)
    letters = [string.ascii_lowercase[3 * k:3 * k + 3] for k in range(n_langs)]

    def words(k, n):
        return " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(n))
    rows = [(100 * k + i, words(k, 60), f"l{k}", "s") for k in range(n_langs) for i in range(20)]
    rows += [(9000 + i, " ".join(words(k, 40) for k in range(n_langs)), None, "s") for i in range(5)]
    rows += [(9100, "\u4e2d\u6587 " * 50, None, "s"), (9101, "1234 !!!", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.language_id(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(r[0] for r in rows if r[0] < 9100)
    assert all(r.lang for r in kept)


def test_texts_mostly_in_unknown_scripts_go(spark):
    """Known is counted in letters: one known word saves no foreign text, and
    a foreign quotation condemns no known one."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 60), "en", "s") for i in range(30)] + [(100 + i, prose(rng, 60, "fr"), "fr", "s") for i in range(30)]
    foreign = "\u4e2d\u6587"
    rows += [(200, "word " + f"{foreign} " * 50, None, "s"), (201, prose(rng, 5) + f" {foreign}" * 95, None, "s"),
             (202, prose(rng, 95) + f" {foreign}" * 5, None, "s"), (203, prose(rng, 60) + f" {foreign}" * 40, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()) == [*range(30), *range(100, 130), 202, 203]


def test_empty_table(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, ""), name)
        assert docs.count() == 0


@pytest.mark.parametrize("name", ["op3_warc", "op5_line_dedup", "op12_centroid_clustering"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = E.queries()[name](spark, sf)
    cur = con.execute(E.oracle_sql()[name])
    cols = sorted(got.columns)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want
