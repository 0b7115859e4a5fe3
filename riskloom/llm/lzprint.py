"""Lempel-Ziv phrase fingerprints.

A text is parsed once from left to right: each phrase is the shortest run of
code points not yet in the dictionary, and joins it (LZ78).  Texts that would
compress well together have many phrases in common.  The set of phrases is
hashed and its ``k`` smallest hashes are the fingerprint (sets of fewer phrases
are kept whole); the likeness of two fingerprints is the share of the smallest
hashes of their union that both hold, an estimate of the Jaccard index of the
phrase sets.

Phrase hashes come from prefix sums of a polynomial over the code points, so
once the ends of the phrases are known numpy hashes all of them together.

Comparing each document with its successor needs neighbours in order of id.
Ids are cut into many ranges (Bucketizer over approximate quantiles); the
first document of a range is sent to the range before it as well, and tasks
walk their sorted ranges holding two documents at a time.

Defined cases: null text is empty; the empty text has an empty fingerprint,
like itself (1) and unlike any other (0); documents without id come last;
equal ids are ordered by a hash of their texts; a single document is its own
successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import driver_table, small_batches, table, text_or_empty
from riskloom.llm.textvec import mix64, run_hashes

K = 128                    # hashes in a fingerprint
RANGES_PER_PARTITION = 8   # id ranges per shuffle partition
BATCH_ROWS = 256


def phrase_ends(text: str, start: int, known: set[str], ends: list[int], stop: int) -> int:
    """Parse ``text`` from ``start``, adding phrases to ``known`` and their
    ends to ``ends``; ends after the first phrase that ends beyond ``stop``.
    Returns where the next phrase starts."""
    add, end, phrase, at = known.add, ends.append, "", start
    for c in text[start:] if start else text:
        phrase += c
        at += 1
        if phrase not in known:
            add(phrase)
            end(at)
            phrase, start = "", at
            if at > stop:
                break
    return start


def smallest_hashes(text: str, ends: list[int], k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct 32-bit hashes of the phrases of ``text``."""
    if not ends:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text[:ends[-1]].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    to = np.array(ends)
    hashes = run_hashes(mix64(codes + np.uint64(1)), np.concatenate(([0], to[:-1])), to)
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index of two sets from their smallest hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    first = np.empty(len(both), bool)
    first[0] = True
    np.not_equal(both[1:], both[:-1], out=first[1:])
    union = np.flatnonzero(first)[:k + 1]
    n = min(len(union), k)
    used = union[k] if len(union) > k else len(both)
    return float(used - n) / n


def as_string(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u4").astype(np.uint32)


def fingerprint(text: str | None, k: int = K) -> np.ndarray:
    ends: list[int] = []
    phrase_ends(text or "", 0, set(), ends, len(text or ""))
    return smallest_hashes(text or "", ends, k)


class _Parsed:
    """A text, its fingerprint, and the parse's state at its middle, from
    which a text that shares the first half goes on."""

    def __init__(self, text: str, k: int):
        self.text, self.half, self.k = text, len(text) - len(text) // 2, k
        known, ends = set(), []
        at = phrase_ends(text, 0, known, ends, self.half)
        crossed = bool(ends) and ends[-1] > self.half
        self.ends = ends[:-1] if crossed else list(ends)
        self.known = known.copy()
        if crossed:
            self.known.discard(text[self.ends[-1] if self.ends else 0:ends[-1]])
            phrase_ends(text, at, known, ends, len(text))
        self.print = smallest_hashes(text, ends, k)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its second half replaced by the start of ``other``,
        and its fingerprint."""
        text = self.text[:self.half] + other[:len(self.text) - self.half]
        ends, known = self.ends, self.known
        phrase_ends(text, ends[-1] if ends else 0, known, ends, len(text))
        out = smallest_hashes(text, ends, self.k)
        self.ends, self.known = [], set()
        return text, out


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(k: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _OUT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, part, out = None, None, []
        for b in batches:
            for r_part, r_role, r_id, r_text in zip(*(b.column(c) for c in ("_part", "_role", "_id", "_t"))):
                p, follower = r_part.as_py(), r_role.as_py()
                if p != part:
                    held, part = None, p
                if follower and held is None:   # a second copy of the range's successor
                    continue
                now = _Parsed(r_text.as_py(), k)
                if held is not None:
                    text, fp = held[1].edited(now.text)
                    out.append((held[0], len(held[1].text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                                as_string(held[1].print), as_string(fp), likeness(held[1].print, fp, k), likeness(held[1].print, now.print, k)))
                held = None if follower else (r_id.as_py(), now)
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return walk


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text (second half from
    the next document), and how like they and the next document's are."""
    spark = small_batches(df.sparkSession)
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_t"))
    cuts = rows.agg(F.percentile_approx(F.col("_id").cast("double"), [i / ranges for i in range(1, ranges)] or [0.5], 10 * max(ranges, 1000))).first()[0]
    splits = [-float("inf"), *sorted(set(cuts or [0.0])), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(
        rows.withColumn("_x", F.col("_id").cast("double"))).select(
        "_id", "_t", F.coalesce(F.col("_b").cast("int"), F.lit(len(splits))).alias("_part"))   # without id: a last range
    # one row per range: its first id, and the range it follows (the last one's successor is the first)
    firsts = sorted(tuple(r) for r in ranged.groupBy("_part").agg(F.min("_id").alias("_id")).collect())
    before = [(first, part, firsts[i - 1][0]) for i, (part, first) in enumerate(firsts)]
    heads = driver_table(spark, before, "_hid long, _hpart int, _before int")
    sent = (ranged.join(heads, (F.col("_part") == F.col("_hpart")) & F.col("_id").eqNullSafe(F.col("_hid")), "left")
            .withColumn("_to", F.when(F.col("_hpart").isNull(), F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("r"))))
                        .otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("r")), F.struct(F.col("_before").alias("p"), F.lit(1).alias("r")))))
            .select("_id", "_t", F.explode("_to").alias("_d")).select(F.col("_d.p").alias("_part"), F.col("_d.r").alias("_role"), "_id", "_t"))
    walked = sent.repartition("_part").sortWithinPartitions("_part", "_role", F.col("_id").asc_nulls_last(), F.xxhash64("_t"))
    return walked.mapInArrow(_walk(k), _OUT)


def op1_document_fingerprints(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
