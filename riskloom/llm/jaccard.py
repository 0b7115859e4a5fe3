"""N-gram Jaccard join of documents.

A document's set is its distinct shingles of five words, as 64-bit hashes.
Two documents link when their sets' Jaccard index is at least 0.75.

Candidates.  In any common order of shingles, two linked sets share one among
the first seventh of the smaller and the first quarter of the larger.  The order puts shingles by how often they
occur (a sketch of fixed size counts all of them, hashed), then by hash: the
lines and passages that many documents share come last, so they bring nobody
together who has more to offer.  Equal sets are one class from the start.

Sizes.  Linked sets differ in size by at most 4 : 3, so classes are banded by
size; links run within a band or to the next one.  Each class has a bitmap of
its shingles' hashes, at least eight bits per shingle.  A bit set on one side
only is a shingle the other side lacks, so bit counts bound the overlap from
above; pairs that the bound leaves possible are settled by intersecting the
sorted arrays.

Rounds.  First every class is compared with one class of its band under the
same shingle: as many pairs as there are rows, however large the group.
Components are formed, and under the shingles that still hold several of them
the classes are compared with one of them, chosen by hash, a few times over.
That joins up groups of near copies without
listing their pairs.  What is left goes through tiles of at most ``TILE``
classes a side (band against band, hash block against hash block), which
compare the bitmaps of all classes in different components.  So no link
between components is lost, and no pair inside one is looked at again.

Texts are never shuffled to be intersected: a filter of bounded size
(``keyfilter``) finds the rows that are wanted while the texts are scanned, and
only their shingle arrays leave the task.  Links, classes and components stay
in tables, which are deleted when what follows has been written.

Hot shingles.  A shingle that by the sketch's count more than ``TILE`` classes
may begin with is dealt out in parts by class hash; parts meet in the rounds.

Defined cases: null or blank texts have an empty set and link with nothing; a
text of fewer than five words is one shingle; repeated rows fall in one class;
documents without id have no say in a component's id; an empty table gives an
empty result.  Sets are told apart by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, sum_slices, table
from riskloom.llm.components import FILE_ROWS, components
from riskloom.llm.keyfilter import KeyFilter
from riskloom.llm.textvec import BYTE_VALUE, IS_SPACE, LOWER, chunks, mix64, run_hashes, runs
from riskloom.session import cut_lineage, drop_scratch

WORDS = 5
MIN_JACCARD = (75, 100)     # as a fraction, so that the test is exact
SKETCH_BITS = 20            # counters of the frequency sketch: 2 ** SKETCH_BITS
SLICE = 1 << 14
TILE = 1024                 # classes per side of a tile,
TILE_SHINGLES = 4_000_000   # and shingles they have at most
STAR_ROUNDS = 2             # rounds against single classes before the tiles
BITS_PER_SHINGLE = 8
MIN_BITS, MAX_BITS = 64, 1 << 16

_PLACE = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SHORT = mix64(np.arange(101, 101 + WORDS, dtype=np.uint64))


# ----------------------------------------------------------------- shingles --

def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a chunk's texts, text after text, and
    where each text's begin (one more at the end)."""
    start, end, doc = runs(~IS_SPACE[data], offsets)
    n_docs = len(offsets) - 1
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    h = run_hashes(BYTE_VALUE[LOWER[data]], start, end)
    whole = np.empty(0, np.int64)
    parts, owners = [], []
    if len(h) >= WORDS:
        whole = np.flatnonzero(doc[:len(h) - WORDS + 1] == doc[WORDS - 1:])
        s = np.zeros(len(whole), np.uint64)
        for k in range(WORDS):
            s += h[whole + k] * _PLACE[k]
        parts.append(mix64(s))
        owners.append(doc[whole])
    n_words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    for d in np.flatnonzero((n_words > 0) & (n_words < WORDS)):
        own = h[first[d]:first[d] + n_words[d]]
        parts.append(mix64((own * _PLACE[:len(own)]).sum(keepdims=True, dtype=np.uint64) + _SHORT[len(own)]))
        owners.append(np.array([d]))
    s, d = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(n_docs + 1))


def class_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each text's set (0 for empty sets)."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(s ^ np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)))
    n = np.diff(at).astype(np.uint64)
    out = mix64(sums[at[1:]] - sums[at[:-1]] + n * np.uint64(0x9FB21C651E98DF25))
    out[n == 0] = 0
    return out.view(np.int64)


def bitmap_bits(n: int) -> int:
    return int(min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_SHINGLE * max(int(n), 1) - 1).bit_length())))


def bitmap(s: np.ndarray) -> bytes:
    """Bit (hash mod size) set for each shingle; half as large a bitmap is the
    two halves laid over each other."""
    bits = np.zeros(bitmap_bits(len(s)), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def prefix_length(n):
    """Shingles of which the larger of two linked sets must share one:
    n - ceil(0.75 n) + 1."""
    p, q = MIN_JACCARD
    return n - (n * p + q - 1) // q + 1


def short_prefix_length(n):
    """The same for the smaller set: the overlap is 2 t / (1 + t) of its size
    at least, so n - ceil(6 n / 7) + 1."""
    p, q = MIN_JACCARD
    return n - (n * 2 * p + p + q - 1) // (p + q) + 1


def band_of(n: np.ndarray) -> np.ndarray:
    """Sizes that differ by 4 : 3 at most are in one band or in neighbours."""
    p, q = MIN_JACCARD
    return np.floor(np.log(np.maximum(n, 1)) / np.log(q / p)).astype(np.int32)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether bitmaps (uint64 words on the last axis) leave a link possible."""
    most = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    p, q = MIN_JACCARD
    return q * most >= p * (na + nb - most)


def as_words(maps: list[bytes], n_bytes: int) -> np.ndarray:
    """Bitmaps folded to ``n_bytes`` each, as 64-bit words."""
    out = np.empty((len(maps), n_bytes), np.uint8)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint8)
        out[i] = x if len(x) == n_bytes else np.bitwise_or.reduce(x.reshape(-1, n_bytes), 0)
    return out.view(np.uint64)


# ----------------------------------------------------------- scans of texts --

def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class, size and bitmap of each text; at the end what the task counts
    for the sketch (each class it has seen once)."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    seen: set[int] = set()
    names = ["id", "th", "n", "cid", "bits", "slice", "counts"]
    id_type, held, n_held = None, [], 0

    def count():
        nonlocal counts, held, n_held
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        held, n_held = [], 0
    for b in batches:
        id_type = b.schema.field("id").type
        for first, to, data, offsets in chunks(b.column("text")):
            s, at = shingle_sets(data, offsets)
            ids = class_ids(s, at)
            n = np.diff(at)
            fresh = np.zeros(to - first, bool)
            for i, c in enumerate(ids.tolist()):
                if n[i] and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            bucket = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            held.append(bucket[np.repeat(fresh, n)].astype(np.int32))
            n_held += len(held[-1])
            if n_held > 1_000_000:
                count()
            # a class's bitmap is needed once; every task gives it with the first text it sees of the class
            maps = [bitmap(s[at[i]:at[i + 1]]) if fresh[i] else None for i in range(to - first)]
            rows = to - first
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(first, rows), b.column("th").slice(first, rows), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(maps, pa.binary()),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int64()))], names)
    count()
    for no in range(0, len(counts) if id_type is not None else 0, SLICE):
        part = counts[no:no + SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([no // SLICE], pa.int32()), pa.array([part], pa.list_(pa.int64()))], names)


def _prefixes(level_bc):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = level_bc.value
        seen: set[int] = set()
        for b in batches:
            for _first, _to, data, offsets in chunks(b.column("text")):
                s, at = shingle_sets(data, offsets)
                ids, n = class_ids(s, at), np.diff(at)
                fresh = np.zeros(len(n), bool)
                for i, c in enumerate(ids.tolist()):
                    if n[i] and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                own = np.repeat(fresh, n)
                s, d = s[own], np.repeat(np.arange(len(n)), n)[own]
                if not len(s):
                    continue
                rank = (level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                order = np.lexsort((rank, d))
                s, d = s[order], d[order]
                begin = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                size = np.diff(np.append(begin, len(d)))
                place = np.arange(len(d)) - np.repeat(begin, size)
                head = place < np.repeat(prefix_length(size), size)
                short = (place < np.repeat(short_prefix_length(size), size))[head]
                # a shingle counted more than TILE times is dealt out by class
                often = np.exp2(level[(s[head] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] / 4.0)
                parts = np.ceil(often / TILE).astype(np.int64)
                part = np.where(parts > 1, (ids[d[head]] >> 8) % parts, -1)
                yield pa.RecordBatch.from_arrays([pa.array(s[head].view(np.int64)), pa.array(part, pa.int64()), pa.array(ids[d[head]]), pa.array(n[d[head]], pa.int32()), pa.array(short)],
                                                 ["token", "part", "cid", "n", "short"])
    return prefixes


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _first, _to, data, offsets in chunks(b.column("text")):
            s, at = shingle_sets(data, offsets)
            ids = class_ids(s, at)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s[at[i]:at[i + 1]].tobytes() for i in range(len(ids))], pa.binary())], ["cid", "shingles"])


# --------------------------------------------------------------- candidates --

def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, part, n, cid): the classes of every token that
    has two or more (of a token in parts: all), each with the smallest class of
    its band under that token and part."""
    names = ["token", "band", "cid", "n", "short", "lead"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
    # what the batches before left open: the last row, its token's first row if that is still alone, its band's leader
    last = held = None
    lead_key, lead_cid = None, 0
    for b in batches:
        tok, part, cid, n, short = (b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "part", "cid", "n", "short"))
        if not len(tok):
            continue
        band = band_of(n)
        same = np.zeros(len(tok), bool)         # the row before has this token and part
        same[1:] = (tok[1:] == tok[:-1]) & (part[1:] == part[:-1])
        copy = np.zeros(len(tok), bool)         # the row before is this very class
        copy[1:] = same[1:] & (cid[1:] == cid[:-1])
        if last is not None:
            same[0] = (tok[0], part[0]) == last[:2]
            copy[0] = same[0] and cid[0] == last[2]
        keep = np.flatnonzero(~copy)
        last = (tok[-1], part[-1], cid[-1])
        if not len(keep):
            continue
        tok, part, cid, n, band, short = tok[keep], part[keep], cid[keep], n[keep], band[keep], short[keep]
        same = np.zeros(len(tok), bool)
        same[1:] = (tok[1:] == tok[:-1]) & (part[1:] == part[:-1])
        same[0] = lead_key is not None and (tok[0], part[0]) == lead_key[:2]
        new_band = ~same
        new_band[1:] |= band[1:] != band[:-1]
        if same[0]:
            new_band[0] = band[0] != lead_key[2]
        idx = np.maximum.accumulate(np.where(new_band, np.arange(len(tok)), -1))
        lead = np.where(idx >= 0, cid[np.maximum(idx, 0)], lead_cid)
        paired = same | (part >= 0)             # has a neighbour under its token
        paired[:-1] |= same[1:]
        out = [[] for _ in names]
        if same[0] and held is not None:
            for o, x in zip(out, held):
                o.append(np.array([x]))
        held = None
        if not paired[-1]:
            held = (tok[-1], band[-1], cid[-1], n[-1], short[-1], lead[-1])
        for o, x in zip(out, (tok, band, cid, n, short, lead)):
            o.append(x[paired])
        lead_key, lead_cid = (tok[-1], part[-1], band[-1]), lead[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, types)], names)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their bitmaps leave possible."""
    for b in batches:
        maps = b.column("a_bits").to_pylist(), b.column("b_bits").to_pylist()
        na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("a_n", "b_n"))
        size = np.array([min(len(x), len(y)) for x, y in zip(*maps)], np.int64)
        ok = np.zeros(b.num_rows, bool)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            a, c = (as_words([m[i] for i in at], int(k)) for m in maps)
            ok[at] = possible(a, c, na[at], nb[at])
        at = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("a", "b")], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sorted arrays overlap enough."""
    p, q = MIN_JACCARD
    for b in batches:
        ok = []
        for x, y in zip(b.column("a_set").to_pylist(), b.column("b_set").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
            ok.append(q * common >= p * (len(x) + len(y) - common))
        at = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([b.column(c).take(at) for c in ("a", "b")], ["u", "v"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile: pairs of a tile (its two sides, or all if it has
    one) in different components that the bitmaps leave possible.  Holds one
    tile at a time."""
    def pairs(rows):
        left = [r for r in rows if r[1] != 2]
        right = [r for r in rows if r[1] != 1] if rows[0][1] == 0 else [r for r in rows if r[1] == 2]
        if not left or not right:
            return
        size = min(min(len(r[5]) for r in left), min(len(r[5]) for r in right))
        side = [(np.array([r[2] for r in x]), np.array([r[3] for r in x], np.int64), np.array([r[4] for r in x]), as_words([r[5] for r in x], size), np.array([r[6] for r in x]))
                for x in (left, right)]
        (ac, an, ak, am, ash), (bc, bn, bk, bm, bsh) = side
        for i in range(len(ac)):
            # the smaller set has the token in its short prefix
            apart = (ak[i] != bk) & (((an[i] <= bn) & ash[i]) | ((bn <= an[i]) & bsh))
            if rows[0][1] == 0:
                apart &= bc > ac[i]
            at = np.flatnonzero(apart)
            at = at[possible(am[i], bm[at], an[i], bn[at])]
            if len(at):
                yield np.full(len(at), ac[i]), bc[at]

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (list(zip(*found)) or ([], []))], ["a", "b"])

    tile, rows = None, []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("tile", "side", "cid", "n", "comp", "bits", "short")]
        found = []
        for r in zip(*cols):
            if r[0] != tile:
                if len(rows) > 1:
                    found += pairs(rows)
                tile, rows = r[0], []
            rows.append(r)
        if found:
            yield batch(found)
    if len(rows) > 1 and (found := list(pairs(rows))):
        yield batch(found)


# ----------------------------------------------------------------- the join --

def _frequency_levels(base: DataFrame) -> np.ndarray:
    """The sketch as one byte per counter: how often, in steps of 2 ** 0.25."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    slices = base.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(sum_slices, "slice int, counts array<long>")
    for r in slices.toLocalIterator():
        counts[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = r["counts"]
    return np.minimum(255, np.floor(4 * np.log2(counts + 1))).astype(np.uint8)


class _Verifier:
    """Exact comparison of candidate pairs of classes."""

    def __init__(self, texts: DataFrame, classes: DataFrame):
        self.texts, self.classes = texts, classes

    def bounded(self, pairs: DataFrame) -> DataFrame:
        c = self.classes
        a = c.select(F.col("cid").alias("_ac"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"))
        b = c.select(F.col("cid").alias("_bc"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"))
        rows = pairs.join(a, F.col("a") == F.col("_ac")).join(b, F.col("b") == F.col("_bc")).select("a", "b", "a_n", "b_n", "a_bits", "b_bits")
        return rows.mapInArrow(_bounded, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Distinct ``pairs`` (a, b) of classes -> those that link, as (u, v)."""
        pairs = cut_lineage(self.bounded(pairs), "pairs")
        wanted = pairs.select(F.col("a").alias("_w")).unionByName(pairs.select(F.col("b").alias("_w"))).distinct()
        reps = cut_lineage(self.classes.join(wanted, F.col("cid") == F.col("_w"), "left_semi")
                           .select("cid", F.xxhash64("th", "id").alias("k")), "reps")
        own = KeyFilter(reps.select("k").distinct()).flagged(self.texts, F.xxhash64("th", "id"), "_hit").filter("_hit").select("text")
        sets = own.mapInArrow(_sets, "cid long, shingles binary").join(reps.select(F.col("cid").alias("_w")), F.col("cid") == F.col("_w"), "left_semi")
        sets = cut_lineage(sets.dropDuplicates(["cid"]), "sets")
        a = sets.select(F.col("cid").alias("_ac"), F.col("shingles").alias("a_set"))
        b = sets.select(F.col("cid").alias("_bc"), F.col("shingles").alias("b_set"))
        rows = pairs.join(a, F.col("a") == F.col("_ac")).join(b, F.col("b") == F.col("_bc")).select("a", "b", "a_set", "b_set")
        found = cut_lineage(rows.mapInArrow(_linked, "u long, v long"), "links")
        drop_scratch(pairs, reps, sets)
        return found


def _relabelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` (token, band, cid, n, short) with comp, of the tokens that hold
    several components and that some set has in its short prefix."""
    c = comp.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    files = rows.count() // FILE_ROWS + 2
    rows = rows.join(c, F.col("cid") == F.col("_u"), "left").select(
        "token", "band", "cid", "n", "short", F.coalesce("_v", "cid").alias("comp"))
    rows = cut_lineage(rows.coalesce(files), "labelled")
    several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bool_or("short").alias("s")).filter("s and lo != hi").select(F.col("token").alias("_t"))
    still = cut_lineage(rows.join(several, F.col("token") == F.col("_t"), "left_semi").coalesce(files), "open")
    drop_scratch(rows)
    return still


def _without_twins(rows: DataFrame) -> DataFrame:
    """``rows`` (token, cid, short, ...) with one token for each set of classes
    and of those that have it in their short prefix."""
    h = F.xxhash64("cid", "short")
    sets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("s"), F.bit_xor(h).alias("x"))
    picked = sets.groupBy("c", "s", "x").agg(F.min("token").alias("_t")).select("_t")
    return rows.join(picked, F.col("token") == F.col("_t"), "left_semi")


def _star_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """Under each token and in each band, one class chosen by hash, with every
    class of another component: no more pairs than rows."""
    mark = F.struct(F.xxhash64(F.lit(seed), "token", "cid").alias("h"), F.col("cid").alias("c"), F.col("comp").alias("p"))
    lead = rows.groupBy(F.col("token").alias("_t"), F.col("band").alias("_b")).agg(F.min(mark).alias("lead"))
    pairs = rows.join(lead, (F.col("token") == F.col("_t")) & (F.col("band") == F.col("_b"))).filter(F.col("comp") != F.col("lead.p"))
    return pairs.select(F.least("cid", "lead.c").alias("a"), F.greatest("cid", "lead.c").alias("b")).distinct()


def _tile_rows(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (token, band, cid, n, short, comp) dealt to tiles: (tile, side,
    cid, n, short, comp, bits).  A tile is two blocks of classes of a token, of
    one band or of neighbouring ones; two blocks that are all of one component
    make none, and no row is copied for them.  Also the table they need."""
    blocks = rows.groupBy(F.col("token").alias("_t")).agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum(F.col("n").cast("long")) / TILE_SHINGLES)).cast("int").alias("nb"))
    rows = rows.join(blocks, F.col("token") == F.col("_t")).withColumn("i", F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("nb")).cast("int"))
    spans = cut_lineage(rows.groupBy("token", "band", "i").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "spans")
    x = spans.select("token", F.col("band").alias("low"), F.col("i").alias("x"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    y = spans.select(F.col("token").alias("_t"), F.col("band").alias("_b"), F.col("i").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = x.join(y, (F.col("token") == F.col("_t")) & F.expr("(_b = low and x <= y) or _b = low + 1")).filter("lo1 != hi1 or lo2 != hi2 or lo1 != lo2")
    sides = F.expr("if(_b = low and x = y, array(named_struct('b', low, 'i', x, 'side', 0)), "
                   "array(named_struct('b', low, 'i', x, 'side', 1), named_struct('b', _b, 'i', y, 'side', 2)))")
    deals = pairs.select("token", F.xxhash64("token", "low", "_b", "x", "y").alias("tile"), F.explode(sides).alias("to")).select(
        F.col("token").alias("_t"), "tile", F.col("to.b").alias("_b"), F.col("to.i").alias("_i"), F.col("to.side").alias("side"))
    bits = classes.select(F.col("cid").alias("_bc"), "bits")
    tiles = (rows.drop("_t").join(deals, (F.col("token") == F.col("_t")) & (F.col("band") == F.col("_b")) & (F.col("i") == F.col("_i")))
             .select("tile", "side", "cid", "n", "short", "comp").join(bits, F.col("cid") == F.col("_bc")).drop("_bc"))
    return tiles, spans


def link_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, th (hash of the text), n_shingles, cid (class of
    equal sets), comp (component, null for empty sets), component_id (smallest
    id in it)."""
    spark = small_batches(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = texts.select("id", "th", F.lit(0).alias("n"), F.lit(0).cast("long").alias("cid"), F.lit(None).cast("binary").alias("bits"),
                          F.lit(None).cast("int").alias("slice"), F.lit(None).cast("array<long>").alias("counts")).schema
    for f in schema.fields:
        f.nullable = True
    base = cut_lineage(texts.mapInArrow(_describe, schema), "shingled")
    docs = base.filter("slice is null").select("id", "th", "n", "cid", "bits")
    classes = cut_lineage(docs.filter("n > 0").groupBy("cid").agg(
        F.first("n").alias("n"), F.max("bits").alias("bits"), F.min(F.struct("th", "id")).alias("_r")).select("cid", "n", "bits", "_r.th", "_r.id"), "classes")
    level = spark.sparkContext.broadcast(_frequency_levels(base))
    narrow = cut_lineage(docs.select("id", "th", "n", "cid"), "docs")
    drop_scratch(base)
    tokens = texts.select("text").mapInArrow(_prefixes(level), "token long, part long, cid long, n int, short boolean")
    groups = cut_lineage(tokens.repartition("token", "part").sortWithinPartitions("token", "part", "n", "cid")
                         .mapInArrow(_groups, "token long, band int, cid long, n int, short boolean, lead long"), "groups")
    verify = _Verifier(texts, classes)
    comp = _joined(verify.links(groups.filter("cid != lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()))
    first = _relabelled(groups, comp)
    drop_scratch(groups)
    rows = cut_lineage(_without_twins(first), "open")
    drop_scratch(first)
    for seed in range(STAR_ROUNDS):
        links = verify.links(_star_pairs(rows, seed))
        if links.isEmpty():
            drop_scratch(links)
            break
        comp, old = _joined(links, comp), rows
        rows = _relabelled(old, comp)
        drop_scratch(old)
    tiles, spans = _tile_rows(rows, classes)
    rest = verify.links(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "a long, b long").distinct())
    comp = _joined(rest, comp)
    c = comp.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    placed = narrow.join(c, F.col("cid") == F.col("_u"), "left").select(
        "id", "th", F.col("n").cast("long").alias("n_shingles"), "cid", F.when(F.col("n") > 0, F.coalesce("_v", "cid")).alias("comp"))
    smallest = placed.filter("comp is not null").groupBy(F.col("comp").alias("_k")).agg(F.min("id").alias("_low"))
    out = cut_lineage(placed.join(smallest, F.col("comp") == F.col("_k"), "left").select(
        "id", "th", "n_shingles", "cid", "comp", F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("_low")).alias("component_id")), "linked")
    drop_scratch(narrow, classes, rows, spans, comp)
    return out


def _joined(links: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """The components of ``links`` and of the stars ``comp``; both are deleted."""
    out = components(links if comp is None else comp.unionByName(links))
    drop_scratch(*[t for t in (links, comp) if t is not None])
    return out


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: that of the smallest id (then of
    the smallest text hash).  Rows with empty sets all stay.

    What goes is settled on (id, text hash) alone; a filter over these keys
    passes the other rows as they are, so only rows that may go are shuffled."""
    cols = df.columns
    linked = link_documents(df, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("th").alias("th"))
    first = linked.filter("comp is not null").groupBy(F.col("comp").alias("_k")).agg(F.min(order).alias("_f"))
    keys = linked.filter("comp is not null").groupBy("id", "th", "comp").agg(F.count(F.lit(1)).alias("copies"))
    gone = ~(F.col("id").eqNullSafe(F.col("_f.id")) & (F.col("th") == F.col("_f.th")))
    judged = keys.join(first, F.col("comp") == F.col("_k")).select(F.col("id").alias("_ji"), F.col("th").alias("_jt"), gone.alias("gone"), "copies")
    # rows to look at: those that go, and those that repeat an id and text
    judged = cut_lineage(judged.filter("gone or copies > 1"), "judged")
    drop_scratch(linked)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th"))
    rows = KeyFilter(judged.select(F.xxhash64("_jt", "_ji").alias("k")).distinct()).flagged(rows, F.xxhash64("_th", "_id"), "_hit")
    seen = rows.filter("_hit").join(judged, F.col("_id").eqNullSafe(F.col("_ji")) & (F.col("_th") == F.col("_jt")), "left").filter("gone is null or not gone")
    once = seen.filter("copies is not null").dropDuplicates(["_id", "_th"])
    return rows.filter("not _hit").select("_row.*").unionByName(seen.filter("copies is null").select("_row.*")).unionByName(once.select("_row.*"))


def op2_ngram_jaccard_join(spark, sf_dir):
    out = link_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
