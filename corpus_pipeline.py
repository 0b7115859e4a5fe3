"""The corpus pipeline: ``documents`` through five of the operators, in order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of docs.

1. language_id     texts of which less than ``KNOWN_SHARE`` of the letters is in
                   scripts of learnt languages go; a missing ``lang`` is filled
                   with the prediction.
2. line_dedup      boilerplate lines of many sites are taken out; a text that
                   has no words left goes.
3. ngram_jaccard   of each group of near copies one document stays.
4. mixing          sources are brought to their target weights: whole documents
                   are dropped or repeated.
5. bpe             token ids of each text, and the digest of the text decoded
                   from them.

Defined cases follow the operators': null or empty texts go in stage 1; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import bpe, jaccard, langid, lines, mixing
from riskloom.llm.common import WORD
from riskloom.session import cut_lineage, drop_scratch


KNOWN_SHARE = 0.2   # of a text's letters (bytes of UTF-8) in words of a script that some learnt language is written in


def _recount(df: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    if "n_chars" not in df.columns:
        return df
    kind = dict(df.dtypes)["n_chars"]
    return df.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    cols = docs.columns
    model = langid.learn(docs.filter(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    found = langid.predict(rows, model, "row.text", with_known=True).filter(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") >= KNOWN_SHARE))
    lang = F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang")
    return found.select(*[lang if c == "lang" else F.col("row")[c].alias(c) for c in cols])


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    kept = lines.remove_boilerplate(rows).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return _recount(kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))


def ngram_jaccard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(mixing.mixed_documents(docs))


def bpe_encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.default_vocabulary(), with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mixing", mix_sources),
    ("bpe", bpe_encode),
]

#: Fitted models, similarity components and subword merges are no SQL; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs, before = cut_lineage(stage(spark, docs, sf_dir), name), docs
        drop_scratch(before)
    return docs
