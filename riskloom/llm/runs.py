"""Periodic runs in the words of a text, by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(MIN_LENGTH, MIN_POWER * q)`` that can't be extended with that
period.  A run of period q >= 8 holds a block of b words, b the power of two
with b <= q < 2b, that begins at a multiple of b and occurs again q words on,
that is among the b positions from b words on (for q < 8: blocks of 8 words,
and the 7 positions that follow the block's own).  So

1. prefix doubling sorts the suffixes of every text; after the step for
   factors of b words, equal factors are an interval of the suffix array, and
   the ranks of all steps answer longest common extensions exactly;
2. each block that occurs more than once in its text asks a wavelet matrix
   over the suffix array for its occurrences in the neighbouring window:
   counts and range successors;
3. occurrences of b words in a window of 2b form one progression.  One or two
   of them are candidates as they stand; of a longer progression (its
   difference is the block's own period) only the shift that aligns the ends
   of the two periodic stretches can be the period of a run that they don't
   already fill;
4. a candidate is extended to both sides and kept if it is long enough; of the
   periods found for one stretch the smallest is the run's.

Work is O(n log n) numpy steps a text, memory about 4 bytes a word for each
power of two up to the longest repeated passage.  Texts are handled a chunk at
a time, and no text meets another.

Defined cases: null text has no words, no runs and an empty collapsed text, as
has a blank one; a text of any length is taken whole (a text longer than a
chunk is one of its own); repeated rows and ids are worked on one by one; ties
are settled by start, then period; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WORD, small_batches, table
from riskloom.llm.textvec import chunks

MIN_LENGTH = 24      # words in a run at least
MIN_POWER = 3        # periods in a run at least; the windows rely on 3
BLOCK = 8            # words in the smallest block: 2 * BLOCK - 1 + BLOCK <= MIN_LENGTH
CHUNK = 1 << 18      # bytes of text worked on at once


class Factors:
    """Suffix array of texts laid one behind the other, sorted by (text,
    suffix), and the ranks of the factors of 1, 2, 4, ... words.

    ``symbols`` holds word numbers from 1, each text closed by a 0; equal ranks
    of two positions of a text mean equal factors."""

    def __init__(self, symbols: np.ndarray, text_no: np.ndarray):
        n = self.n = len(symbols)
        key = text_no.astype(np.int64) * (int(symbols.max()) + 1) + symbols
        self.sa = np.argsort(key, kind="stable").astype(np.int32)
        self.rank = np.empty(n, np.int32)
        self.ranks: list[np.ndarray] = []
        self._classes(np.arange(n), key[self.sa])

    def _classes(self, slots: np.ndarray, keys: np.ndarray) -> None:
        """Ranks after a step that left ``slots`` of the suffix array sorted
        by ``keys``; slots whose factor is not alone stay open."""
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        head = np.flatnonzero(first)
        size = np.diff(np.append(head, len(keys)))
        own = np.repeat(slots[head], size)
        self.rank[self.sa[slots]] = own
        self.ranks.append(self.rank.copy())
        shared = np.repeat(size, size) > 1
        self.open, self.open_from, self.open_size = slots[shared], own[shared], np.repeat(size, size)[shared]

    def double(self) -> None:
        """From factors of w words to those of 2w."""
        step, at = 1 << (len(self.ranks) - 1), self.sa[self.open].astype(np.int64)
        after = at + step
        then = np.where(after < self.n, self.rank[np.minimum(after, self.n - 1)].astype(np.int64) + 1, 0)
        key = self.open_from.astype(np.int64) * (self.n + 1) + then
        order = np.argsort(key, kind="stable")
        self.sa[self.open] = at[order]
        self._classes(self.open, key[order])

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the longest common extension of positions a < b of one
        text: to the right from them, or to the left of them."""
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, width = self.ranks[k], 1 << k
            todo = np.arange(len(a))
            while len(todo):
                x, y = (a[todo] - width, b[todo] - width) if back else (a[todo], b[todo])
                inside = (x >= 0) & (y < self.n)
                same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
                todo = todo[same]
                total[todo] += width
                a[todo] += -width if back else width
                b[todo] += -width if back else width
                if k < len(self.ranks) - 1:
                    break
        return total

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the longest stretch around ``at`` with the period."""
        return at - self.common(at, at + period, back=True), at + period + self.common(at, at + period)


class WaveletMatrix:
    """Values of an array bit by bit; counts and order statistics of any
    interval, for many queries at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            words = np.zeros(len(one) // 64 + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self.levels.append((bit, words, before, len(one) - int(one.sum())))
            values = np.concatenate((values[~one], values[one]))

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        _, words, before, _ = level
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [left, right) are smaller than x."""
        out = np.zeros(len(left), np.int64)
        for level in self.levels:
            bit, zeros = level[0], level[3]
            l1, r1 = self._ones(level, left), self._ones(level, right)
            one = (x >> bit) & 1 == 1
            out += np.where(one, (right - r1) - (left - l1), 0)
            left, right = np.where(one, zeros + l1, left - l1), np.where(one, zeros + r1, right - r1)
        return out

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value (from 0) in [left, right)."""
        out, n = np.zeros(len(left), np.int64), n.copy()
        for level in self.levels:
            bit, zeros = level[0], level[3]
            l1, r1 = self._ones(level, left), self._ones(level, right)
            small = (right - r1) - (left - l1)
            one = n >= small
            out += one.astype(np.int64) << bit
            n -= np.where(one, small, 0)
            left, right = np.where(one, zeros + l1, left - l1), np.where(one, zeros + r1, right - r1)
        return out


def _blocks(f: Factors, start: np.ndarray, length: np.ndarray, text_no: np.ndarray):
    """(position, width, interval of the suffix array) of the aligned blocks
    that occur more than once in their text; and the open slots for the
    smallest width, among which all intervals lie."""
    found, base, longest = [], None, int(length.max())
    while len(f.open):
        width = 1 << (len(f.ranks) - 1)
        if MIN_POWER * width > longest and width > BLOCK:
            break
        if width >= BLOCK:
            if base is None:
                base = f.open
            at = f.sa[f.open].astype(np.int64)
            t = text_no[at]
            ok = ((at - start[t]) % width == 0) & (length[t] >= max(MIN_LENGTH, MIN_POWER * width))
            found.append((at[ok], np.full(int(ok.sum()), width), f.open_from[ok].astype(np.int64), f.open_size[ok]))
        f.double()
    if not found:
        return None
    at, width, left, size = (np.concatenate(x) for x in zip(*found))
    return at, width, np.searchsorted(base, left), np.searchsorted(base, left + size), base


def find_runs(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of texts given as word
    numbers from 1, each closed by a 0 that ``lengths`` doesn't count; sorted
    by text, start and period."""
    none = (np.empty(0, np.int64),) * 4
    if not len(lengths) or lengths.max() < MIN_LENGTH:
        return none
    start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    text_no = np.repeat(np.arange(len(lengths)), lengths + 1)
    f = Factors(symbols, text_no)
    blocks = _blocks(f, start, lengths, text_no)
    if blocks is None or not len(blocks[0]):
        return none
    at, width, left, right, base = blocks
    matrix = WaveletMatrix(f.sa[base].astype(np.int64), int(f.n + 1).bit_length())
    cand_at, cand_q = [], []

    def offer(pos, period):
        ok = (period > 0) & (pos + period < (start + lengths)[text_no[pos]])
        cand_at.append(pos[ok])
        cand_q.append(period[ok])

    # the window of a block's own progression (periods under BLOCK) ...
    s = np.flatnonzero(width == BLOCK)
    low = matrix.below(left[s], right[s], at[s] + 1)
    many = matrix.below(left[s], right[s], np.minimum(at[s] + BLOCK, f.n)) - low
    hit = s[many > 0]
    offer(at[hit], matrix.nth(left[hit], right[hit], low[many > 0]) - at[hit])
    # ... and the neighbouring one (periods from the width to its double)
    low = matrix.below(left, right, np.minimum(at + width, f.n))
    many = matrix.below(left, right, np.minimum(at + 2 * width, f.n)) - low
    for least, most in ((1, 1), (2, 2), (3, None)):
        s = np.flatnonzero((many >= least) & (many <= most if most else True))
        if not len(s):
            continue
        one = matrix.nth(left[s], right[s], low[s])
        if least == 1:
            offer(at[s], one - at[s])
            continue
        two = matrix.nth(left[s], right[s], low[s] + 1)
        if least == 2:
            offer(at[s], one - at[s])
            offer(at[s], two - at[s])
            continue
        x, y = f.stretch(at[s], two - one)
        x2, y2 = f.stretch(one, two - one)
        apart = x != x2
        offer(at[s][apart], (x2 - x)[apart])
        offer(at[s][apart], (y2 - y)[apart])
    at, q = np.concatenate(cand_at), np.concatenate(cand_q)
    if not len(at):
        return none
    at, q = np.divmod(np.unique(at * (f.n + 1) + q), f.n + 1)
    a, b = f.stretch(at, q)
    ok = b - a >= np.maximum(MIN_LENGTH, MIN_POWER * q)
    a, b, q = a[ok], b[ok], q[ok]
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    smallest = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
    a, b, q = a[smallest], b[smallest], q[smallest]
    order = np.lexsort((q, a))
    a, b, q = a[order], b[order], q[order]
    t = text_no[a]
    return t, a - start[t], b - a, q


def _runs_of(texts: list[bytes]) -> tuple[list, list]:
    """Per text its runs and the words that are kept, joined by one blank."""
    words = [t.split() for t in texts]      # bytes.split(): blank, \t \n \v \f \r
    numbers: dict[bytes, int] = {}
    long = [i for i, w in enumerate(words) if len(w) >= MIN_LENGTH]
    flat: list[int] = []
    for i in long:
        flat += [numbers.setdefault(w, len(numbers) + 1) for w in words[i]]
        flat.append(0)
    runs: list[list] = [[] for _ in texts]
    found = find_runs(np.array(flat, np.int64), np.array([len(words[i]) for i in long], np.int64))
    for t, a, length, q in zip(*(x.tolist() for x in found)):
        runs[long[t]].append({"start": a, "length": length, "period": q})
    kept = []
    for w, r in zip(words, runs):
        if r:
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, [x["start"] + x["period"] for x in r], 1)
            np.add.at(change, [x["start"] + x["length"] for x in r], -1)
            w = compress(w, (np.cumsum(change[:-1]) == 0).tolist())
        kept.append(b" ".join(w))
    return runs, kept


_RUNS = "runs array<struct<start:long,length:long,period:long>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("_text")
        for first, to, data, offsets in chunks(texts, CHUNK):
            cut = offsets.tolist()
            runs, kept = _runs_of([data[x:y].tobytes() for x, y in zip(cut, cut[1:])])
            yield pa.RecordBatch.from_arrays(
                [b.column("_row").slice(first, to - first), pa.array(runs, _ARROW_RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                ["_row", "runs", "collapsed"])


def periodic_runs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns, or ``keep`` of them) with the runs of ``text_col``
    (word number, words, period; by start, then period) and ``collapsed``, the
    text without the words that a run repeats, joined by single blanks."""
    small_batches(df.sparkSession)
    cols = list(df.columns if keep is None else keep)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(text_col).alias("_text"))
    schema = rows.select("_row", F.lit(None).cast(_RUNS.split(" ", 1)[1]).alias("runs"), F.lit("").alias("collapsed")).schema
    out = rows.mapInArrow(_label, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in cols if c.lower() not in ("runs", "collapsed")], "runs", "collapsed")


def _with_periods(docs: DataFrame) -> DataFrame:
    """The query's texts: in every tenth document (by hash) the words from
    word ``_a`` on repeat with period ``_p``; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})")))).withColumn("_n", F.size("_w"))
    docs = docs.withColumn("_g", F.floor(h / 10)).withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)"))
    docs = docs.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    words = F.expr("transform(sequence(0L, _n - 1L), i -> get(_w, cast(if(i < _a, i, _a + (i - _a) % _p) as int)))")
    return docs.select("doc_id", F.when(F.col("_n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_run_detection(spark, sf_dir):
    docs = _with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs, keep=["doc_id"])
    best = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (m, x) -> "
                  "if(m is null or x.length * m.period > m.length * x.period, x, m))")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.expr(r"sha2(array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), ''), 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
