"""Planted examples for the personal-data trees, made in SQL.

What the base rules miss (addresses written out, numbers without a plus, spaced
quads, cards in odd groups or followed by another number) can't be learnt from
the base rules' own verdicts.  So the trees also see values made from hashes in
such forms, and look-alikes that are nobody's data (versions, dates, decimals,
prices, serial numbers, sentences that happen to hold "at" and a full stop),
each set between pieces of text taken from the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import driver_table

PLANTED = 8000      # texts made
CONTEXTS = 500      # pieces of text from the corpus (smallest hashes) they are set in
PIECE = 24          # code points on either side


def _n(k: int, digits: int) -> str:
    """SQL: a number of so many digits from the row's hash."""
    return f"lpad(cast(pmod(xxhash64(id, {k}), {10 ** digits}) as string), {digits}, '0')"


def _upto(k: int, low: int, high: int) -> str:
    return f"cast({low} + pmod(xxhash64(id, {k}), {high - low + 1}) as string)"


def _word(k: int, letters: int = 6) -> str:
    return f"translate({_n(k, letters)}, '0123456789', 'aeinorstlm')"


def _one_of(k: int, *values: str) -> str:
    return f"element_at(array({', '.join(values)}), cast(1 + pmod(xxhash64(id, {k}), {len(values)}) as int))"


def _text(*values: str) -> list[str]:
    return ["'" + v + "'" for v in values]


def _sum(d: str) -> str:
    """SQL: the Luhn sum of the digits ``d``."""
    v = f"cast(substring({d}, -i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, {v}, if({v} > 4, 2 * {v} - 9, 2 * {v})))"


def _card(k: int, digits: int = 16, valid: bool = True) -> str:
    body = f"concat('4', {_n(k, digits - 2)})"
    check = f"(10 - {_sum(f'concat({body}, 0)')} % 10) % 10"
    return f"concat({body}, cast(({check} + {0 if valid else f'1 + pmod(xxhash64(id, {k + 1}), 9)'}) % 10 as string))"


def _grouped(d: str, sep: str, *sizes: int) -> str:
    at, parts = 1, []
    for n in sizes:
        parts.append(f"substring({d}, {at}, {n})")
        at += n
    return f"concat_ws({sep}, {', '.join(parts)})"


def _cat(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


_local = _one_of(1, _word(2, 7), _cat(_word(2, 4), "'.'", _upto(3, 1, 99)), _cat(_word(2, 5), "'.'", _word(3, 7)), _cat(_word(2, 3), "'_'", _word(3, 5)))
_host = _one_of(4, _word(5, 6), _cat(_word(5, 4), _upto(6, 1, 99)), _cat("'mail'", _upto(6, 1, 9)), _cat(_word(5, 4), "'-'", _word(6, 4)))
_top = _one_of(7, *_text("com", "org", "net", "de", "io", "fr", "info", "example"))
_ip = [_upto(k, 0, 255) for k in (10, 11, 12, 13)]
_a, _b, _c = _upto(20, 200, 999), _n(21, 3), _n(22, 4)

#: (kind, left of it or null, value) of what is personal data ...
POSITIVE = {
    0: [_cat(_local, at, _host, dot, _top) for at, dot in (
        ("' (at) '", "' (dot) '"), ("'(at)'", "'(dot)'"), ("'[at]'", "'[dot]'"), ("' [at] '", "' [dot] '"), ("' at '", "' dot '"), ("'(at)'", "'.'"),
        ("' (at) '", "'.'"), ("' [at] '", "'.'"), ("'[at]'", "'.'"), ("' @ '", "'.'"), ("'@'", "' (dot) '"), ("'@'", "'[dot]'"), ("'@'", "' dot '"))],
    1: [f"concat_ws({sep}, {', '.join(_ip)})" for sep in _text(".", " . ", " .", ". ", " . ")],
    2: [_grouped(_card(30), sep, 4, 4, 4, 4) for sep in _text(".", "/", " ", "-", ".")] + [
        _grouped(_card(32, 15), sep, 4, 6, 5) for sep in _text(" ", "-", ".")] + [_card(32, 15), _card(34, 13), _card(30)],
    3: [_cat(_a, sep, _b, sep, _c) for sep in _text("-", ".", " ")] + [
        _cat("'('", _a, "') '", _b, "'-'", _c), _cat("'1 ('", _a, "') '", _b, "'-'", _c), _cat("'1-'", _a, "'-'", _b, "'-'", _c),
        _cat("'+1 ('", _a, "') '", _b, "'-'", _c), _cat("'00'", _upto(23, 30, 49), "' '", _a, "' '", _n(24, 7)),
        _cat("'0'", _upto(23, 20, 99), "'/'", _n(24, 7)), _cat("'0'", _upto(23, 20, 99), "' '", _n(24, 3), "' '", _n(25, 4))],
}
#: ... and of what only looks like it.
NEGATIVE = {
    0: [_cat(_word(2), "' at '", _word(3, 5), "'.'", f"initcap({_word(4, 5)})"), _cat(_word(2), "' at '", _upto(3, 1, 99), "'.'", _n(4, 2)),
        _cat(_upto(2, 1, 99), "' @ '", _upto(3, 1, 99), "'.'", _n(4, 2)), _cat(_word(2), "' at '", _word(3, 4), "'.'", _word(4, 9)),
        _cat(_word(2), "' at '", _word(3, 5), "'.'", f"initcap({_word(4, 3)})"), _cat(_word(2, 3), "' at '", _upto(3, 1, 12), "'.'", _n(4, 2), "'.'", _n(5, 2))],
    1: [_cat(_upto(10, 256, 999), "'.'", _ip[1], "'.'", _ip[2], "'.'", _ip[3]), _cat(_ip[0], "' . '", _ip[1], "' . '", _upto(12, 256, 999), "' . '", _ip[3]),
        f"concat_ws('. ', {', '.join(f'cast({k} + pmod(xxhash64(id, 14), 9) as string)' for k in range(1, 5))})",
        _cat(_upto(10, 0, 9), "'. '", _upto(11, 0, 9), "'.'", _upto(12, 256, 999), "'.'", _upto(13, 0, 99))],
    2: [_card(30, 16, False), _grouped(_card(30, 16, False), "' '", 4, 4, 4, 4), _grouped(_card(30, 16, False), "'.'", 4, 4, 4, 4),
        _card(32, 15, False), _card(34, 13, False), _grouped(_card(30, 16, False), "'-'", 4, 4, 4, 4), _grouped(_card(32, 15, False), "' '", 4, 6, 5)],
    3: [_n(20, 7), _n(20, 9), _cat("'1'", _n(20, 10)), _cat(_upto(20, 0, 9), "'.'", _n(21, 8)), _cat(_upto(20, 1, 28), "'.'", _upto(21, 1, 12), "'.20'", _n(22, 2)),
        _cat("'20'", _n(20, 2), "'-'", _n(21, 2), "'-'", _n(22, 2)), _cat("'19'", _n(20, 2), "'-20'", _n(21, 2)), _cat("'978-3-16-'", _n(20, 6), "'-'", _n(21, 1)),
        _cat("'20'", _n(20, 2), "'-0'", _upto(21, 1, 9), "'-'", _n(22, 2), "' '", _n(23, 2)), _cat(_upto(20, 1, 9), "'.'", _n(21, 3), "'.'", _n(22, 3)),
        _cat(_n(20, 10), "'-'", _n(21, 3)), _cat("'#'", _n(20, 8)), _n(20, 16)],
}
HINTS = {0: _text("mail ", "contact ", "write to ", "reach me: "), 1: _text("host ", "ip ", "server ", "login from "),
         2: _text("card ", "visa ", "payment ", "pay with "), 3: _text("call ", "tel. ", "phone ", "mobile: ")}
DECOYS = {0: _text("look ", "met ", "priced ", "was "), 1: _text("version ", "v", "section ", "steps "),
          2: _text("serial ", "order ", "tracking no. ", "id "), 3: _text("order no. ", "since ", "id ", "on ")}


def contexts(texts: DataFrame, n: int = CONTEXTS) -> list[tuple[str, str]]:
    """Pieces of the texts (_t) with the smallest hashes, without digits and signs."""
    h = F.xxhash64("_t")
    at = F.pmod(F.xxhash64(F.lit(1), h), F.greatest(F.length("_t") - 2 * PIECE, F.lit(1))).cast("int")
    rows = texts.filter(F.col("_t") != "").select(h.alias("h"), *[F.regexp_replace(F.substring("_t", at + 1 + k * PIECE, F.lit(PIECE)), r"[0-9@+\[\]()]", "").alias(c)
                                                                          for k, c in enumerate(("l", "r"))])
    return [(r["l"], r["r"]) for r in rows.orderBy("h", "l", "r").limit(n).collect()]


def planted(pieces: list[tuple[str, str]], spark, n: int = PLANTED) -> DataFrame:
    """(id, _t, kind, good, s, e): a text, the value set in it (code points),
    its kind, and whether it is personal data."""
    known = driver_table(spark, [(i, a, b) for i, (a, b) in enumerate(pieces)], "no long, l string, r string")
    rows = spark.range(n).selectExpr("id", "cast(id % 4 as int) as kind", "pmod(xxhash64(id, 90), 2) = 0 as good", "pmod(xxhash64(id, 91), 100) as dice",
                                     f"pmod(xxhash64(id, 92), {len(pieces)}) as _no")

    def by_kind(table, k):
        return "case kind " + " ".join(f"when {kind} then {_one_of(k, *values)}" for kind, values in table.items()) + " end"
    rows = rows.withColumn("value", F.expr(f"if(good, {by_kind(POSITIVE, 93)}, {by_kind(NEGATIVE, 93)})"))
    lead = f"case when dice < 40 then '' when good then {by_kind(HINTS, 94)} when dice < 85 then {by_kind(DECOYS, 95)} else {by_kind(HINTS, 94)} end"
    # some values are followed by a number of another kind
    tail = _one_of(96, *_text(" ", " ", ". ", ", ", " ", ") "), f"concat(' ', {_card(40)}, ' ')", f"concat(' ', {_n(42, 4)}, ' ')")
    rows = rows.join(known, F.col("_no") == F.col("no")).withColumn("left", F.expr(f"concat(l, ' ', {lead})")).withColumn("right", F.expr(f"concat({tail}, r)"))
    return rows.select("id", F.concat("left", "value", "right").alias("_t"), "kind", "good", F.length("left").alias("s"), (F.length("left") + F.length("value")).alias("e"))
