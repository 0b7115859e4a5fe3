import random

import pytest

SYLLABLES = {
    "en": "the and ing tion er on th in ed re".split(), "fr": "é eau tion le que oi ch ré pa vi".split(),
    "de": "sch ich ung ü ß der pf keit ä ein".split(), "es": "ción mente ado que ll ñ í os de ra".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in words).strip()


DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, taken string, score string, shard int, ids string, "
              "_row string, th int, cid int, n int, spans string, kept boolean, n_lines int")


def doc_rows(rows):
    """(doc_id, text, lang, source) rows with extra columns of clashing names."""
    return [(i, t, la, s, None if t is None else len(t), 1, "x", None, 3, "y", "z", 4, 5, 6, "w", None, 7) for i, t, la, s in rows]


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls in every column, blank and very long texts, copies,
    near copies, repeated rows and shared lines."""
    rng = random.Random(5)
    rows, i = [], 0
    for lang in SYLLABLES:
        for k in range(12):
            rows.append((i, prose(rng, rng.randint(30, 200), lang), lang, f"s{k % 12}"))
            i += 1
    base = prose(rng, 120)
    words = base.split(" ")
    for k in range(14):     # near copies: one word changed
        w = list(words)
        w[rng.randrange(len(w))] = "CHANGED"
        rows.append((i, " ".join(w), "en", f"s{k % 12}"))
        i += 1
    for k in range(5):      # exact copies
        rows.append((i, base, "en", "s0"))
        i += 1
    line = "this line of boilerplate stands on every site"
    for k in range(12):
        rows.append((i, prose(rng, 40) + "\n" + line + "\n" + prose(rng, 10), "en", f"s{k}"))
        i += 1
    rows += [
        (i, None, "en", "s1"), (i + 1, "", "en", "s1"), (i + 2, " \t\n\x0b\x0c\r ", "fr", "s2"), (i + 3, "one two", "en", None),
        (i + 4, "one two", None, None), (i + 5, prose(rng, 40_000), "en", "s3"), (i + 6, "x" * 30_000, "en", "s3"), (i + 7, "1234 !!! ###", None, "s4"),
        (None, prose(rng, 50), "en", "s5"), (i + 8, "Ünïcode 中文 текст 🙂 <|endoftext|> Ελληνικά", None, "s6"),
        (i + 9, prose(rng, 60), "en", "s7"), (i + 9, "same id, another text of some words here", "en", "s7"),
        (i + 10, "mail a.b+c@mail.example.org or +1 (212) 555-0100, host 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111.", "en", "s8"),
    ]
    rows += [rows[3], rows[3]]   # repeated rows
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(doc_rows(odd_rows), DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
