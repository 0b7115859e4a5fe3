"""Quality by Bradley-Terry ranking of labelled documents.

A document's worth is a weighted sum of its features; in a pair of a good and
a bad document the good one wins with probability sigmoid(difference of their
worths).  The weights minimise that logistic loss over pairs, which is a
logistic regression without intercept on the differences of the features
(``pyspark.ml``).  Differences say nothing about where good begins: that is
the quantile of the worths, over all labelled training documents, below which
lies the share that is labelled bad.

Features are read off the text alone: measures of its words and lines, and how
often each pair of character classes (lower, upper, digit, blank, line end,
sentence mark, symbol, other) stands side by side.

The pairs come from at most ``SAMPLE`` documents of each label (smallest hash
of the id), each meeting up to ``RIVALS`` of the other label; threshold and
scale come from all training documents.

Defined cases: null text is empty text, and an empty text has features (all 0)
and a score; null labels and ids teach nothing; an id that repeats is scored
row by row and enters the sample once; without labels of both kinds every
score is the share of good labels, 0.5 without labels; texts of any length are
read whole, a chunk at a time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import driver_table, small_batches, table
from riskloom.llm.textvec import IS_SPACE, chunks, runs
from riskloom.session import cut_lineage

SAMPLE = 4000        # documents of each label that pairs are made of, at most
RIVALS = 8           # pairs for each document of the larger side
REGULARISATION = 1e-3
CUT_SCORE = 0.3      # score of a document at the threshold
NEAR = 0.002         # quantiles this far to both sides of the share are averaged

# fixed values: classes of bytes
_CLASS = np.full(256, 7, np.uint8)
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[*b"0123456789"]] = 2
_CLASS[[*b" \t\x0b\x0c\r"]] = 3
_CLASS[[*b"\n"]] = 4
_CLASS[[*b".,;:?!'\"()-"]] = 5
_CLASS[[*b"#*$%&|<>@~^_=+/\\{}[]`"]] = 6
_LETTER = (_CLASS < 2) | (np.arange(256) >= 0x80)

MEASURES = ["words", "kinds", "top_word", "same_as_last", "same_lines", "word_length", "bare_words", "upper_words", "short_words", "long_words"]
N_FEATURES = len(MEASURES) + 64


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of the texts of a chunk, a row each."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    start, end, doc = runs(~IS_SPACE[data], offsets)
    words = np.bincount(doc, minlength=n).astype(np.float64)
    per_word = np.maximum(words, 1)
    out[:, 0] = np.log1p(words) / 10
    if len(start):
        letters = np.add.reduceat(np.append(_LETTER[data], False).astype(np.int64), np.stack((start, end), 1).ravel())[::2]
        upper = np.add.reduceat(np.append(_CLASS[data] == 1, False).astype(np.int64), np.stack((start, end), 1).ravel())[::2]
        length = end - start
        out[:, 5] = np.log1p(np.bincount(doc, length, n) / per_word) / 4
        for k, flag in ((6, letters == 0), (7, (letters > 0) & (upper == letters)), (8, length <= 2), (9, length > 24)):
            out[:, k] = np.bincount(doc, flag, n) / per_word
    cut = offsets.tolist()
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        text = data[a:b].tobytes()
        w = text.split()
        if not w:
            continue
        seen = Counter(w)
        out[i, 1] = log(len(seen)) / log(len(w)) if len(w) > 1 else 1.0
        out[i, 2] = max(seen.values()) / len(w) if len(w) >= 10 else 0.0
        out[i, 3] = sum(map(bytes.__eq__, w, w[1:])) / len(w)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[i, 4] = 1 - len(set(lines)) / len(lines)
    if len(data) > 1:
        c = _CLASS[data].astype(np.int64)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inside = owner[1:] == owner[:-1]
        pairs = np.bincount((owner[:-1] * 64 + c[:-1] * 8 + c[1:])[inside], minlength=64 * n).reshape(n, 64)
        out[:, len(MEASURES):] = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, to, data, offsets in chunks(b.column("_text")):
            f = features(data, offsets)
            yield pa.RecordBatch.from_arrays([b.column("_row").slice(first, to - first), pa.array(list(f), pa.list_(pa.float64()))], ["_row", "f"])


def _worth(weights: np.ndarray):
    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, to, data, offsets in chunks(b.column("_text")):
                yield pa.RecordBatch.from_arrays([b.column("_row").slice(first, to - first), pa.array(features(data, offsets) @ weights)], ["_row", "worth"])
    return worth


def _through(rows: DataFrame, text_col: str, keep: list[str], job, added: str, kind: str) -> DataFrame:
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(job, rows.select("_row", F.lit(None).cast(kind).alias(added)).schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in keep if c.lower() != added], added)


# ----------------------------------------------------------------- learning --

@dataclass(frozen=True)
class Ranking:
    """Weights of the features; threshold and scale of the worths; the score
    given where there is nothing to learn from."""

    weights: np.ndarray
    cut: float = 0.0
    scale: float = 1.0
    constant: float | None = None

    def score(self, worth: Column) -> Column:
        if self.constant is not None:
            return F.lit(float(self.constant))
        z = (worth - F.lit(self.cut)) / F.lit(self.scale) + F.lit(log(CUT_SCORE / (1 - CUT_SCORE)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _sampled(labels: DataFrame, n: int) -> dict[int, list]:
    """Ids of at most ``n`` documents of each label, by hash."""
    return {q: [r["id"] for r in labels.filter(F.col("good") == q).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(n).collect()] for q in (0, 1)}


def preference_weights(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rivals: int = RIVALS) -> np.ndarray | None:
    """Weights learnt from pairs of ``docs`` (id, text) by ``labels`` (id,
    good); None without labels of both kinds."""
    spark = docs.sparkSession
    ids = _sampled(labels, sample)
    if not ids[0] or not ids[1]:
        return None
    kind = dict(labels.dtypes)["id"]
    places = driver_table(spark, [(i, q, no) for q in (0, 1) for no, i in enumerate(ids[q])], f"_id {kind}, good int, no long")
    chosen = docs.join(places, F.col("id") == F.col("_id")).select("good", "no", "text")
    found = _through(chosen, "text", ["good", "no"], _featured, "f", "array<double>")
    examples = cut_lineage(found.groupBy("good", "no").agg(F.min("f").alias("f")), "examples")
    spread = {r["pos"]: r["s"] or 0.0 for r in examples.select(F.posexplode("f").alias("pos", "x")).groupBy("pos").agg(F.stddev("x").alias("s")).collect()}
    scale = np.array([1 / spread[i] if spread.get(i, 0.0) > 1e-9 else 0.0 for i in range(N_FEATURES)])
    # every document of the larger side meets rivals of the other, by hash
    n_bad, n_good = len(ids[0]), len(ids[1])
    meet = spark.range(rivals * max(n_bad, n_good)).select(
        "id", *[(F.col("id") % n if n == max(n_bad, n_good) else F.pmod(F.xxhash64("id"), F.lit(n))).alias(c) for c, n in (("lost", n_bad), ("won", n_good))])
    side = lambda q, c: F.broadcast(examples.filter(F.col("good") == q).select(F.col("no").alias(c), F.col("f").alias(f"f_{c}")))  # noqa: E731  at most `sample` rows
    pairs = meet.join(side(0, "lost"), "lost").join(side(1, "won"), "won")
    factors = F.array(*[F.lit(float(x)) for x in scale])
    turned = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)      # both outcomes, as the regression wants two classes
    gap = F.zip_with(F.zip_with("f_won", "f_lost", lambda a, b: a - b), factors, lambda d, s: d * s * F.col("turn"))
    rows = cut_lineage(pairs.withColumn("turn", turned).select(gap.alias("gap"), (F.col("turn") > 0).cast("double").alias("label")), "pairs")
    fit = LogisticRegression(fitIntercept=False, standardization=False, regParam=REGULARISATION, maxIter=100).fit(
        rows.select(array_to_vector("gap").alias("features"), "label"))
    return fit.coefficients.toArray() * scale


def worths(df: DataFrame, weights: np.ndarray, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``df``, and the worth of each text."""
    small_batches(df.sparkSession)
    return _through(df, text_col, keep, _worth(weights), "worth", "double")


def threshold(judged: DataFrame, weights: np.ndarray) -> Ranking:
    """Threshold by quantile: below it lies the share of ``judged`` (worth,
    good) that is labelled bad."""
    m = judged.agg(F.avg((F.col("good") == 0).cast("double")).alias("bad"), F.stddev("worth").alias("s")).first()
    at = [min(max(m["bad"] + d, 0.0), 1.0) for d in (-NEAR, NEAR)]
    low, high = judged.agg(F.percentile_approx("worth", at, 100_000)).first()[0]
    return Ranking(weights, (low + high) / 2, m["s"] or 1.0)


def rank(df: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
         keep: list[str] | None = None, sample: int = SAMPLE, rivals: int = RIVALS) -> DataFrame:
    """``keep`` of ``df`` with a score of quality (0 to 1; CUT_SCORE at the
    threshold), learnt from those ``labels`` for which ``teaches``, a condition
    on a column named as ``id_col``, holds."""
    spark = small_batches(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & teaches).select(
        F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("good"))
    known = cut_lineage(known.join(rows.select("id"), "id", "left_semi"), "labels")
    weights = preference_weights(rows.select("id", "text"), known, sample, rivals)
    if weights is None:
        share = known.agg(F.avg("good")).first()[0]
        return df.select(*keep).withColumn("score", F.lit(0.5 if share is None else float(share)))
    out = cut_lineage(worths(rows, weights, "text", ["_kept", "id"]), "worths")
    model = threshold(out.join(known, "id").select("worth", "good"), weights)
    return out.select(*[F.col("_kept")[c].alias(c) for c in keep if c.lower() != "score"], model.score(F.col("worth")).alias("score"))


def op13_quality_classifier(spark, sf_dir):
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
