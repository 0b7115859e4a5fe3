"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate, however often; a line that
one site repeats is not.  Many is ``SITE_SHARE`` of the sites there are, but
``FEW_SITES`` at least and no more than ``MANY_SITES``: where sites are few a
quarter of them is, and where they are thousands ten unrelated sites are.  Per line hash a HyperLogLog sketch of the sites is
aggregated (partial sketches merge in the shuffle, so a line that fills a
third of the corpus costs one sketch per task).  Lines whose estimate is clear
of the threshold are decided by it; for those within ``NEAR`` of it the sites
are counted exactly.  Of a boilerplate line the first occurrence (smallest id,
then position) stays, the others are removed.

Lines are handled as (hash, length); only texts that lose a line are matched
with their removals again.

Defined cases: null text stays null and has no lines; blank lines are neither
counted nor removed; a null site is no site; rows that repeat an id are first
together; a text keeps its other lines and its line ends; texts
and lines of any length are whole; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ROW, WORD, pack, table, unpack
from riskloom.session import cut_lineage

SITE_SHARE = 0.25  # of all sites: a line on so many is boilerplate,
FEW_SITES = 3      # on no fewer than these,
MANY_SITES = 10    # and on so many always
NEAR = 0.15        # relative distance to the threshold within which sites are counted exactly
LG_K = 12          # 2 ** LG_K registers: standard error 1.6 %, exact for few sites


def _lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, th, site, pos, h, len) of every line with a word."""
    parts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(site_col).alias("site"),
                      F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return parts.filter(F.col("line").rlike(WORD)).select(
        "id", "th", "site", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("len"))


def threshold(n_sites: int) -> int:
    """Sites from which a line is boilerplate, where there are ``n_sites``."""
    return max(FEW_SITES, min(MANY_SITES, ceil(SITE_SHARE * n_sites)))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h, len, first) of the lines on at least ``min_sites`` sites."""
    spread = lines.groupBy("h", "len").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count(F.lit(1)).alias("n"),
        F.min(F.struct("id", "pos")).alias("first")).filter(F.col("n") > 1)
    spread = cut_lineage(spread.filter(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.filter(F.col("sites") <= min_sites * (1 + NEAR)).select(F.col("h").alias("_h"), F.col("len").alias("_l"))
    exact = (lines.join(near, (F.col("h") == F.col("_h")) & (F.col("len") == F.col("_l")), "left_semi")
             .select("h", "len", "site").distinct().groupBy(F.col("h").alias("_h"), F.col("len").alias("_l"))
             .agg(F.count("site").alias("_exact")).filter(F.col("_exact") >= min_sites))
    sure = spread.filter(F.col("sites") > min_sites * (1 + NEAR)).select("h", "len", "first")
    return sure.unionByName(spread.join(exact, (F.col("h") == F.col("_h")) & (F.col("len") == F.col("_l"))).select("h", "len", "first"))


def remove_boilerplate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int | None = None) -> DataFrame:
    """``df`` with boilerplate lines removed from ``text_col``, and n_lines
    (with a word, before) and n_removed.  ``min_sites`` is by default the
    ``threshold`` for the distinct sites of all rows."""
    if min_sites is None:
        min_sites = threshold(df.select(F.col(site_col).alias("s")).distinct().agg(F.count("s")).first()[0])
    lines = cut_lineage(_lines(df, id_col, text_col, site_col), "lines")
    spread = cut_lineage(boilerplate(lines, min_sites), "boilerplate")
    b = spread.select(F.col("h").alias("_h"), F.col("len").alias("_l"), "first")
    hits = lines.join(b, (F.col("h") == F.col("_h")) & (F.col("len") == F.col("_l"))).filter(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
    removed = cut_lineage(hits.groupBy(F.col("id").alias("_ri"), F.col("th").alias("_rt")).agg(F.collect_set("pos").alias("_gone")), "removed")
    rows = pack(df).withColumn("_id", F.col(ROW)[id_col]).withColumn("_th", F.xxhash64(F.col(ROW)[text_col]))
    rows = rows.join(removed, F.col("_id").eqNullSafe(F.col("_ri")) & (F.col("_th") == F.col("_rt")), "left")
    rows = rows.withColumn("_all", F.split(F.col(ROW)[text_col], "\n"))
    kept = "array_join(transform(array_except(sequence(0, size(_all) - 1), _gone), i -> _all[i]), '\\n')"
    text = F.when(F.col("_gone").isNull(), F.col(ROW)[text_col]).otherwise(F.expr(kept))
    n_lines = F.size(F.filter("_all", lambda x: x.rlike(WORD)))
    out = rows.withColumn("_new", text)
    return unpack(out, df.columns, F.col("_new").alias(text_col),
                  F.when(F.col("_all").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
                  F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"))


def op5_line_dedup(spark, sf_dir):
    """The cleaned text of every document (all of it), with line counts."""
    out = remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


SQL = f"""
with l as (
  select doc_id, source, pos, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') as has_word
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)),
s as (select line, count(distinct source) as sites from l where has_word group by line),
r as (
  select l.*, has_word and s.sites >= (
             select greatest({FEW_SITES}, least({MANY_SITES}, ceil({SITE_SHARE} * count(distinct source)))) from documents)
           and row_number() over (partition by l.line order by doc_id, pos) > 1 as gone
  from l left join s on l.line = s.line and l.has_word),
k as (
  select doc_id, count(*) filter (has_word) as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
  from r group by doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
       case when d.text is null then null else k.text end as text
from documents d left join k using (doc_id)
"""
