"""Mixing sources to target weights by Sainte-Lague apportionment.

The corpus is cut into equal-token blocks, small enough for the smallest
source to have many.  Blocks are allocated to sources by highest quotients
``weight / (2k + 1)``, then each source's blocks to its shards in the same way
(what a shard can't take goes to the others), which gives an integer quota per
(source, shard) before any document is chosen.  Within a (source, shard) the documents lie on
a line in seeded order; the quota takes whole passes over that line and, for
the rest, a seeded systematic choice of its blocks (every ``n/m``-th block
from a seeded start), so a document's share is closed-form arithmetic on its
position and needs no ranking of blocks.

``mix`` counts words, so a document may be taken in part; ``mixed_documents``
places whole documents: a source's quotas add up to whole passes over all its
lines, one behind the other, and for the rest the documents whose middle lies
before its end, which is within half a document of the quota.

Only one row per source and (source, shard) reaches the driver.  Positions
are two-level prefix sums: windows run inside hash buckets of bounded size,
never over a whole source.

Defined cases: null or empty text has size 0 and takes 0; a null source is a
source of its own, ordered last; repeated rows count each; an empty table
gives an empty result; input columns named like a result column are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ROW, WORD, driver_table, pack, table, unpack, word_count
from riskloom.session import cut_lineage, drop_scratch

N_BLOCKS = 65_536       # blocks the corpus is cut into at least
OWN_BLOCKS = 4_096      # blocks of the smallest source, or of a line, at least (unless it has fewer words)
N_SHARDS = 16           # shards that get quotas of their own
MAX_REPEAT = 3          # no source or document is taken more often
BUCKET_ROWS = 20_000    # rows per prefix-sum window, on average
WEIGHT_CYCLE = (1, 2, 3)


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients ``w / (2k + 1)``; ties go to the earlier entry.

    The bulk comes from the divisor form: at a price d of which no more seats
    are sold than there are, every entry has won its round(w / d).  The heap
    then hands out the rest one by one, about two per entry.
    """
    got = [0] * len(weights)
    total, n = float(sum(weights)), sum(w > 0 for w in weights)
    if seats <= 0 or total <= 0:
        return got
    if 2 * seats > n:
        price = total / (seats - n / 2)
        got = [max(0, int(w / price + 0.5) - 1) for w in weights]
    heap = [(-w / (2 * got[i] + 1), i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def capped_seats(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """``sainte_lague`` with at most ``caps`` seats each; what is over goes to
    the others in the same way, as long as there is room."""
    full: dict[int, int] = {}
    while True:
        got = sainte_lague([0 if i in full else w for i, w in enumerate(weights)], seats - sum(full.values()))
        got = [full.get(i, g) for i, g in enumerate(got)]
        over = [i for i, g in enumerate(got) if g > caps[i]]
        if not over:
            return got
        full.update((i, caps[i]) for i in over)


def source_targets(sizes: Sequence[int], weights: Sequence[float], max_repeat: float = MAX_REPEAT) -> list[float]:
    """Targets that share the sum of ``sizes`` by weight; none above
    ``max_repeat`` times its size, the excess shared again by weight."""
    total = sum(sizes)
    target: list[float | None] = [None] * len(sizes)
    while True:
        left = total - sum(t for t in target if t is not None)
        w_sum = sum(w for w, t in zip(weights, target) if t is None)
        share = [left * w / w_sum if t is None else t for w, t in zip(weights, target)]
        over = [i for i, t in enumerate(target) if t is None and share[i] > max_repeat * sizes[i]]
        if not over:
            return [float(x) for x in share]
        for i in over:
            target[i] = float(max_repeat * sizes[i])


def _seeded(seed: int, *what) -> int:
    return zlib.crc32(repr((seed, *what)).encode())


def quota_plan(rows: Sequence[tuple], n_blocks: int = N_BLOCKS, max_repeat: int = MAX_REPEAT, seed: int = 7) -> list[tuple]:
    """``rows``: (source, shard, size, documents) for each (source, shard).

    Returns (source, shard, sidx, source_size, target, block, passes, picked,
    blocks, start, before, quota) for each: ``passes`` whole passes over the
    line and ``picked`` of its ``blocks`` blocks, systematic from ``start``;
    the words of the source's lines before it and of all the source's quotas.
    """
    sources = sorted({r[0] for r in rows}, key=lambda s: (s is None, s or ""))
    by_source = dict.fromkeys(sources, 0)
    for r in rows:
        by_source[r[0]] += r[2]
    sizes = [by_source[s] for s in sources]
    total = sum(sizes)
    weights = [float(WEIGHT_CYCLE[i % len(WEIGHT_CYCLE)]) for i in range(len(sources))]
    target = source_targets(sizes, weights, max_repeat)
    least = min((min(z, int(t)) for z, t in zip(sizes, target) if z > 0), default=0)
    block = max(1, min(total // n_blocks, least // OWN_BLOCKS))
    quota = sainte_lague(target, round(total / block))
    shards: dict = {}
    for r in sorted(rows, key=lambda r: r[1]):
        shards.setdefault(r[0], []).append(r)
    out = []
    for i, s in enumerate(sources):
        own = shards[s]
        seats = capped_seats([x[2] for x in own], [-(-max_repeat * x[2] // block) for x in own], quota[i])
        each, before = [min(q * block, max_repeat * x[2]) for x, q in zip(own, seats)], 0
        for r, words in zip(own, each):
            size = r[2]
            passes = words // size if size else 0
            # a long line is picked in larger blocks, so documents are mostly taken or left whole
            mine = block * max(1, size // (block * OWN_BLOCKS))
            blocks = -(-size // mine)
            picked = min(blocks, round((words - passes * size) / mine))
            start = _seeded(seed, s, r[1]) % blocks if blocks else 0
            out.append((s, r[1], i, sizes[i], target[i], mine, passes, picked, blocks, start, before, sum(each)))
            before += size
    return out


_PLAN = ("_src string, _shard int, _sidx int, source_size long, target double, _block long, "
         "_passes long, _picked long, _blocks long, _start long, _before long, _quota long")


def _picked_before(x: str) -> str:
    """SQL for the words of picked blocks among the first ``x`` words of the
    line: block k is picked when (k + start) * picked / blocks passes a whole
    number between k and k + 1."""
    def passed(k: str) -> str:
        return f"((({k}) + _start) * _picked div greatest(_blocks, 1L))"
    k = f"({x} div _block)"
    return f"(_block * ({passed(k)} - {passed('0L')}) + ({x} % _block) * ({passed(k + ' + 1L')} - {passed(k)}))"


def _narrow(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, n_shards: int) -> DataFrame:
    """(_src, _id, _h, _shard) of each row."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))).withColumns({
        "_shard": F.pmod(F.col("_h"), F.lit(n_shards)).cast("int"), "_src": F.col(source_col), "_id": F.col(id_col)})


def _on_lines(base: DataFrame, n_blocks: int, max_repeat: int, seed: int) -> tuple[DataFrame, DataFrame, int, list[tuple]]:
    """``base`` (with _src, _shard, _h and size) with its line's plan and a
    _bucket of the line; the words before each bucket; the number of buckets;
    the plan."""
    spark = base.sparkSession
    stats = base.groupBy("_src", "_shard").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    plan = quota_plan([tuple(r) for r in stats], n_blocks, max_repeat, seed)
    plan_df = driver_table(spark, plan, _PLAN)
    n_buckets = max(1, -(-max([r["n"] for r in stats], default=0) // BUCKET_ROWS))
    placed = (base.withColumnRenamed("_src", "_s").withColumnRenamed("_shard", "_sh")
              .join(plan_df, F.col("_s").eqNullSafe(F.col("_src")) & (F.col("_sh") == F.col("_shard")))
              .withColumn("_bucket", _bucket(n_buckets)))
    offsets = (placed.groupBy("_sidx", "_shard", "_bucket").agg(F.sum("size").alias("_words"), F.first("_before").alias("_b4"),
                                                                F.first("_quota").alias("_q"), F.first("source_size").alias("_all"))
               .withColumn("_off", F.sum("_words").over(Window.partitionBy("_sidx", "_shard").orderBy("_bucket")) - F.col("_words"))
               .withColumnsRenamed({"_sidx": "_i", "_shard": "_j", "_bucket": "_b"}))
    return placed, offsets, n_buckets, plan


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.shiftright("_h", 16), F.lit(n_buckets)).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        keep: Sequence[str] | None = None, n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """``df`` (its columns, or ``keep`` of them) with size, source_size,
    target and taken: the words the mix takes of each document."""
    cols = list(df.columns if keep is None else keep)
    base = _narrow(pack(df.select(*[f"`{c}`" for c in dict.fromkeys([*cols, id_col, text_col, source_col])])).withColumns(
        {"_mi": F.col(ROW)[id_col], "_mt": F.col(ROW)[text_col], "_ms": F.col(ROW)[source_col]}), "_mi", "_mt", "_ms", seed, n_shards)
    own = F.struct(*[F.col(ROW)[c].alias(c) for c in cols]).alias(ROW)
    base = base.select(own, "_src", "_id", "_h", "_shard", word_count(F.col("_mt")).alias("size"))
    if text_col not in cols:  # narrow: count the words once; else a second scan is cheaper than a copy of the texts
        base = cut_lineage(base, "mix")
    placed, offsets, _, _ = _on_lines(base, n_blocks, max_repeat, seed)
    offsets = offsets.select("_i", "_j", "_b", "_off")
    inside = Window.partitionBy("_sidx", "_shard", "_bucket").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    line = (placed.withColumn("_in", F.sum("size").over(inside) - F.col("size"))
            .join(offsets, (F.col("_sidx") == F.col("_i")) & (F.col("_shard") == F.col("_j")) & (F.col("_bucket") == F.col("_b")))
            .withColumn("_at", F.col("_off") + F.col("_in")).withColumn("_to", F.col("_at") + F.col("size")))
    taken = F.expr(f"cast(_passes * size + {_picked_before('_to')} - {_picked_before('_at')} as bigint)")
    return unpack(line.withColumn("taken", taken), cols, "size", "source_size", "target", "taken")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
                    n_blocks: int = N_BLOCKS, n_shards: int = N_SHARDS, max_repeat: int = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """The mix in whole documents, with the columns of ``df``: each source is
    within half a document of its quota and no text is cut.  Documents without
    words have nothing to weigh and pass once.

    A source's documents up to some place on its line are taken once more than
    the others.  The place lies in one bucket; all other buckets are decided
    from one row per source, so only the texts of that bucket are shuffled."""
    cols, spark = df.columns, df.sparkSession
    rows = _narrow(pack(df).withColumns({"_mi": F.col(ROW)[id_col], "_mt": F.col(ROW)[text_col], "_ms": F.col(ROW)[source_col]}), "_mi", "_mt", "_ms", seed, n_shards)
    narrow = cut_lineage(rows.select("_src", "_id", "_h", "_shard", word_count(F.col("_mt")).alias("size")), "mix")
    _, offsets, n_buckets, plan = _on_lines(narrow, n_blocks, max_repeat, seed)
    key = F.col("_j") * F.lit(n_buckets) + F.col("_b")
    rest = F.expr("_q % greatest(_all, 1L)")
    at = F.col("_b4") + F.col("_off")
    ends = offsets.groupBy("_i").agg(F.min(F.when(at + F.col("_words") > rest, F.struct(key.alias("k"), at.alias("at")))).alias("e"),
                                     F.first("_q").alias("_q"), F.first("_all").alias("_all"))
    names = {p[2]: p[0] for p in plan}
    found = [(names[r["_i"]], r["_q"] // max(1, r["_all"]), r["_q"] % max(1, r["_all"]), *(tuple(r["e"]) if r["e"] else (1 << 60, 0))) for r in ends.collect()]
    drop_scratch(narrow)
    cuts = driver_table(spark, found, "_of string, _each long, _rest long, _end long, _from long")
    rows = rows.join(cuts, F.col("_src").eqNullSafe(F.col("_of"))).withColumn("_key", F.col("_shard") * F.lit(n_buckets) + _bucket(n_buckets))
    some = F.coalesce(F.col("_mt").rlike(WORD), F.lit(False))
    cut = some & (F.col("_key") == F.col("_end"))
    copies = F.when(~some, 1).otherwise(F.col("_each") + (F.col("_key") < F.col("_end")).cast("int"))
    whole = rows.filter(~cut).select(ROW, copies.cast("int").alias("_n"))
    inside = Window.partitionBy("_src").orderBy("_h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.filter(cut).withColumn("size", word_count(F.col("_mt"))).withColumn("_at", F.col("_from") + F.sum("size").over(inside) - F.col("size"))
    part = near.select(ROW, (F.col("_each") + F.when(2 * F.col("_at") + F.col("size") <= 2 * F.col("_rest"), 1).otherwise(0)).cast("int").alias("_n"))
    return unpack(whole.unionByName(part).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_n")))), cols)


def op10_mixing_sources_to_target_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix(docs, keep=["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken", "source")
