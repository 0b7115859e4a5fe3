"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) on a document or abstains (0).  How often
a rule is right on good and on bad documents is not given: expectation
maximisation finds it, together with the share of good documents, from how the
rules agree.  The posterior probability of "good" then decides, instead of
letting every rule veto.

Only the vote patterns (at most 3 ** rules, counted over all documents) enter
the iterations; each of them is one aggregate with the present estimates as
literals, and one row comes to the driver.

Defined cases: null text is empty text; a text without words fails the base
rules and every rule but length abstains; repeated rows are judged alike; an
empty table gives an empty result and leaves the estimates at their priors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, pack, table, text_or_empty, unpack
from riskloom.session import cut_lineage

WINDOW = 8               # words in a window that may be repeated
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5          # posterior from which a document is kept
ITERATIONS = 25
PRIOR_ROWS = 20.0        # weight of the starting values, in documents
START = {"good": 0.9, "on_good": 0.99, "on_bad": 0.35}   # rules blame few good documents, and miss many bad ones
BOUNDS = {"good": (0.5, 0.99), "on_good": (0.6, 0.999), "on_bad": (0.1, 0.9)}   # only keep the logarithms finite and the sides apart


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad: Column, good: Column, when: Column) -> Column:
    return F.when(~when, 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """The votes, over the measures of ``measured``."""
    some, more = F.col("n_words") >= 1, F.col("n_words") >= MIN_WORDS
    word, symbols = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words")
    dup, rep = _ratio("n_dup_lines", "_n_lines"), _ratio("n_repeat_words", "n_words")
    marks, bare = _ratio("_n_marks", "n_words"), _ratio("_n_bare", "n_words")
    kinds, letters = _ratio("_n_kinds", "n_words"), _ratio("_n_letters", "word_chars")
    upper, stops = _ratio("_n_upper", "_n_letters"), _ratio("_n_stops", "n_words")
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 40, F.lit(True)),
        "word_length": _vote((word < 2.5) | (word > 12), word.between(3.5, 9), some),
        "symbols": _vote(symbols > 0.2, symbols < 0.05, some),
        "marks": _vote(marks > 0.1, marks < 0.02, some),
        "bare_marks": _vote(bare > 0.1, bare < 0.02, some),
        "dup_lines": _vote(dup > 0.5, dup <= 0.2, some & (F.col("_n_lines") >= 3)),
        "repeats": _vote(rep > 0.3, rep < 0.1, more),
        "variety": _vote(kinds < 0.15, kinds > 0.3, F.col("n_words").between(50, 5000)),
        "letters": _vote(letters < 0.6, letters > 0.8, some),
        "upper": _vote(upper > 0.4, upper < 0.15, F.col("_n_letters") >= 20),
        "stops": _vote(stops < 0.004, stops.between(0.01, 0.35), F.col("n_words") >= 50),
    }


def measured(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the measures of ``text`` (contract's and rules')."""
    count = lambda cls: F.length(F.regexp_replace("_t", cls, ""))
    df = df.withColumn("_t", text_or_empty(text)).withColumn("_w", F.expr(f"regexp_extract_all(_t, r'{WORD}', 0)"))
    df = df.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w))) \
           .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    df = df.select(
        *[c for c in df.columns if c not in ("_t", "_w", "_wh", "_lines")], "_wh",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        F.size(F.array_distinct("_wh")).alias("_n_kinds"),
        count(r"\P{L}+").alias("_n_letters"), count(r"\P{Lu}+").alias("_n_upper"), count(r"[^.!?]+").alias("_n_stops"),
        F.regexp_count("_t", F.lit(r"[!#*$%&|<>]{2,}")).alias("_n_marks"),
        F.regexp_count("_t", F.lit(r"(?<![^\x20\x09-\x0D])[#*$%&|<>]++(?![^\x20\x09-\x0D])")).alias("_n_bare"))
    spots = ", ".join(f"_wh[i + {k}]" for k in range(WINDOW))
    df = df.withColumn("_win", F.expr(f"if(size(_wh) >= {WINDOW}, transform(sequence(0, size(_wh) - {WINDOW}), i -> xxhash64({spots})), array())"))
    df = df.withColumn("_again", F.expr("size(array_distinct(_win)) < size(_win)"))
    # equal windows stand side by side once sorted; each marks its words
    df = df.withColumn("_sorted", F.expr(
        "if(_again, array_sort(transform(_win, (h, i) -> named_struct('h', h, 'i', i))), array())"))
    df = df.withColumn("_at", F.expr(
        "array_sort(transform(filter(transform(_sorted, (x, k) -> named_struct('i', x.i, 'twice', "
        "coalesce(get(_sorted, k - 1).h = x.h, false) or coalesce(get(_sorted, k + 1).h = x.h, false))), y -> y.twice), y -> y.i))"))
    covered = F.expr(
        f"aggregate(transform(_at, (p, k) -> least({WINDOW}, coalesce(get(_at, k + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)")
    return df.withColumn("n_repeat_words", covered).drop("_wh", "_win", "_again", "_sorted", "_at")


@dataclass(frozen=True)
class Accuracies:
    """Share of good documents; per rule, how often a vote is right on good
    and on bad documents."""

    good: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def posterior(self) -> Column:
        """Probability of "good" given the vote columns ``v_<rule>``."""
        from math import log

        score: Column = F.lit(log(self.good / (1 - self.good)))
        for r in self.on_good:
            a, b = self.on_good[r], self.on_bad[r]
            score = score + F.when(F.col(f"v_{r}") > 0, F.lit(log(a / (1 - b)))).when(F.col(f"v_{r}") < 0, F.lit(log((1 - a) / b))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def _smoothed(what: str, right: float, of: float) -> float:
    """``right / of``, drawn to the starting value and held within bounds."""
    low, high = BOUNDS[what]
    return min(max((right + PRIOR_ROWS * START[what]) / (of + PRIOR_ROWS), low), high)


def estimate(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> Accuracies:
    """Expectation maximisation over the vote patterns of ``votes``."""
    cols = [f"v_{r}" for r in names]
    patterns = cut_lineage(votes.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "votes")
    now = Accuracies(START["good"], dict.fromkeys(names, START["on_good"]), dict.fromkeys(names, START["on_bad"]))
    for _ in range(iterations):
        p = patterns.withColumn("g", F.col("n") * now.posterior()).withColumn("b", F.col("n") - F.col("g"))
        total = lambda x, cond: F.coalesce(F.sum(F.when(cond, F.col(x))), F.lit(0.0))
        aggs = [F.coalesce(F.sum("g"), F.lit(0.0)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
        for r in names:
            v = F.col(f"v_{r}")
            aggs += [total("g", v > 0).alias(f"gr_{r}"), total("g", v != 0).alias(f"ga_{r}"),
                     total("b", v < 0).alias(f"br_{r}"), total("b", v != 0).alias(f"ba_{r}")]
        m = p.agg(*aggs).first()
        new = Accuracies(_smoothed("good", m["g"], m["n"]),
                         {r: _smoothed("on_good", m[f"gr_{r}"], m[f"ga_{r}"]) for r in names},
                         {r: _smoothed("on_bad", m[f"br_{r}"], m[f"ba_{r}"]) for r in names})
        moved = max(abs(new.good - now.good), *(abs(getattr(new, k)[r] - getattr(now, k)[r]) for k in ("on_good", "on_bad") for r in names))
        now = new
        if moved < 1e-3:
            break
    return now


def judge(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """``df`` (its columns, or ``keep`` of them) with the measures,
    base_failed, quality (posterior) and kept."""
    cols = df.columns if keep is None else keep
    own = list(rules())
    packed = pack(df.select(*[f"`{c}`" for c in dict.fromkeys([*cols, text_col])]))
    narrow = measured(packed, F.col("_row")[text_col])
    votes = narrow.select("_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          *[v.alias(f"v_{r}") for r, v in rules().items()])
    if text_col not in cols:
        votes = cut_lineage(votes.withColumn("_row", F.struct(*[F.col("_row")[c].alias(c) for c in cols])), "votes")
    now = estimate(votes, own)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = votes.withColumn("base_failed", failed).withColumn("quality", now.posterior())
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
    return unpack(out, list(cols), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality",
                  F.concat_ws("", *[F.when(F.col(f"v_{r}") > 0, "+").when(F.col(f"v_{r}") < 0, "-").otherwise("0") for r in own]).alias("votes"))


def op9_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
