import random
import re
from collections import defaultdict

from riskloom.llm import lines
from tests.llm.conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]")


def brute(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, t, _, s in rows:
        for pos, x in enumerate((t or "").split("\n") if t is not None else []):
            if WORD.search(x):
                if s is not None:
                    sites[x].add(s)
                k = (i is not None, i if i is not None else 0, pos)   # nulls come first
                first[x] = min(first.get(x, k), k)
    out = []
    for i, t, _, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        ls = t.split("\n")
        gone = {p for p, x in enumerate(ls) if WORD.search(x) and len(sites[x]) >= min_sites and first[x] != (i is not None, i if i is not None else 0, p)}
        out.append((i, "\n".join(x for p, x in enumerate(ls) if p not in gone), sum(bool(WORD.search(x)) for x in ls), len(gone)))
    return sorted(out, key=str)


def test_equals_brute_force(odd, odd_rows):
    for min_sites in (2, 10, 12):
        got = lines.remove_boilerplate(odd, min_sites=min_sites)
        assert got.columns[:5] == ["doc_id", "lang", "source", "n_chars", "size"]
        assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()], key=str) == brute(odd_rows, min_sites)


def test_something_is_removed_and_once_kept(odd):
    got = lines.remove_boilerplate(odd).collect()
    line = "this line of boilerplate stands on every site"
    assert sum(line in (r.text or "") for r in got) == 1


def test_exact_count_decides_near_the_threshold(spark):
    rows = [(k * 100 + s, f"line {k}", None, f"site{s}") for k in (7, 8, 9, 10, 11, 12) for s in range(k)]
    df = spark.createDataFrame([(i, t, s) for i, t, _, s in rows], "doc_id long, text string, source string")
    b = lines.boilerplate(lines._lines(df, "doc_id", "text", "source"), 10)
    assert b.count() == 3


def test_threshold_follows_the_sites_there_are():
    assert [lines.threshold(n) for n in (0, 1, 6, 12, 13, 20, 37, 40, 10 ** 6)] == [3, 3, 3, 3, 4, 5, 10, 10, 10]


def _shared(rows, line):
    return sum(line in t for _, t, _, _ in rows)


def test_few_sites_and_one_that_holds_a_third(spark):
    rng = random.Random(4)
    line = "a passage that documents of many sites have in common"
    six = [(i, prose(rng, 20) + (f"\n{line}" if i % 4 == 0 else ""), "en", f"s{i % 6}") for i in range(120)]
    # a third of all rows from one site, the passage in 25 documents drawn over all
    hot = [(i, prose(rng, 20), "en", "hot" if rng.random() < 1 / 3 else f"s{rng.randint(1, 19)}") for i in range(600)]
    own = set(rng.sample(range(600), 25))
    hot = [(i, t + f"\n{line}" if i in own else t, la, s) for i, t, la, s in hot]
    for rows in (six, hot):
        assert _shared(rows, line) >= 25
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        got = [tuple(r) for r in lines.remove_boilerplate(df).select("doc_id", "text", "n_lines", "n_removed").collect()]
        assert sorted(got, key=str) == brute(rows, lines.threshold(len({r[3] for r in rows})))
        assert sum(line in t for _, t, _, _ in got) == 1


def test_empty(empty):
    assert lines.remove_boilerplate(empty).count() == 0
