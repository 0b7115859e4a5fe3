"""Personal data: rule-based spans plus boosted candidates, JVM-side only.

The base rules are four patterns with checks (digit counts, Luhn, octets).
On top, generators of high recall propose overlapping spans: looser addresses,
any long run of digits and separators, dotted quads, card-like groups.  Each
proposal gets features of its format and of the text around it, and gradient
boosted trees (pyspark.ml, which runs in the JVM) score it.

What the trees learn from:
  * planted values in forms that the base rules miss, and look-alikes, set
    into pieces of the corpus (``pii_planted``): these are labelled as made;
  * proposals of the corpus that are settled either way: base spans are
    positives; card-like digits that fail Luhn, quads beyond 255, and numbers
    too long for a telephone or inside another kind's base span are negatives.
Other proposals of the corpus have no label.  Only the fitting sees a bounded
sample, taken per kind and label so that a rare kind is in it.  Per kind, the
lowest score that still finds something and from which held-out proposals (half
of all with a label) are right often enough is the threshold; proposals above it that touch no base span are
added, of those that overlap the one with the highest score.

Positions are code points.  For a pattern, the matches (``regexp_extract_all``)
and the pieces between them (``split``) come in turn, so the lengths give every
position without Python, summed up in parts of about the square root of the
matches so that no list is copied for each of them.  The patterns are written
with possessive quantifiers and anchors at the start of a run: same matches as
the plain forms, but linear time and no recursion on long runs.  Proposals meet
the base spans of their text in a sorted window, not one by one.

Defined cases: null text is empty; where all texts are empty, or either
half has fewer than ``MIN_LABELLED`` proposals of a label, nothing is learnt
and nothing added; texts of any length are searched
whole; repeated rows get the same spans; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import pii_planted
from riskloom.llm.common import pack, table, text_or_empty, unpack
from riskloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns (after \G or outside a run a match can start; see above)
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": [r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[a-z0-9-]++)++"],
    "ip": [r"(?<![0-9.])[0-9]++(?:\.[0-9]++){3}(?![0-9.])", r"(?<![0-9])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])", r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./-][0-9]{3,6}){2,3}(?![0-9A-Za-z])"],
    "phone": [r"(?<![0-9A-Za-z+])[+(]?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6,}+",
              r"(?<![0-9A-Za-z+])(?:\+?[0-9]{1,3}\x20?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"],
}
HINT = {
    "email": r"(?i)(?:mail|contact|write|reach|address)\W*$",
    "ip": r"(?i)(?:\bip\b|host|server|address|login from|client)\W*$",
    "card": r"(?i)(?:card|visa|credit|payment|account|iban)\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|contact|dial)\W*$",
}
DECOY = r"(?i)(?:order|serial|tracking|section|version|\bv|steps?|chapter|since|\bno\.?|\bid|\bon|isbn|invoice|part)\W*$"
AROUND = 24                # code points of context on either side
TRAIN_ROWS = 20_000        # proposals the trees are fitted on at most (by hash order, shared by kinds and labels)
TREES, DEPTH = 20, 5
MIN_LABELLED = 10          # proposals of either label that each half must have
PRECISION = 0.98           # of held-out proposals above a kind's threshold
MIN_SUPPORT = 20           # held-out proposals a threshold needs above it
SCORE_BINS = 100


# -------------------------------------------------------------------- spans --

_NONE = "cast(array() as array<struct<s:int,e:int,m:string>>)"


def _matches(pattern: str) -> str:
    """SQL: the matches of ``pattern`` in _t as (s, e, m), code points."""
    p = "r'" + pattern + "'"
    pairs = f"filter(zip_with(regexp_extract_all(_t, {p}, 0), split(_t, {p}, -1), (m, g) -> named_struct('m', m, 'gap', g)), x -> x.m is not null)"
    part = ("aggregate(slice(p, i, step), named_struct('at', a.at, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)), "
            "(b, x) -> named_struct('at', b.at + length(x.gap) + length(x.m), 'out', "
            "concat(b.out, array(named_struct('s', b.at + length(x.gap), 'e', b.at + length(x.gap) + length(x.m), 'm', x.m)))))")
    # a list of one element binds a value to a name: it is computed once
    whole = ("flatten(aggregate(sequence(1, size(p), step), named_struct('at', 0, 'out', cast(array() as array<array<struct<s:int,e:int,m:string>>>)), "
             f"(a, i) -> element_at(transform(array({part}), z -> named_struct('at', z.at, 'out', concat(a.out, array(z.out)))), 1), a -> a.out))")
    return (f"element_at(transform(array({pairs}), p -> if(size(p) = 0, {_NONE}, "
            f"element_at(transform(array(cast(ceil(sqrt(size(p))) as int)), step -> {whole}), 1))), 1)")


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """SQL: whether the string of digits ``d`` passes the Luhn check."""
    v = f"coalesce(try_cast(substring({d}, -i, 1) as int), 0)"   # also evaluated, to no effect, where there are no digits
    return (f"aggregate(sequence(1, greatest(length({d}), 1)), 0, (a, i) -> a + if(i % 2 = 1, {v}, if({v} > 4, 2 * {v} - 9, 2 * {v}))) % 10 = 0")


def _octets(m: str) -> str:
    """SQL: all dotted parts of ``m`` at most 255, whatever their zeros."""
    return f"forall(split({m}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"


_VALID = {
    "email": "true",
    "ip": _octets("x.m"),
    "card": f"length({_digits('x.m')}) between 16 and 19 and {_luhn(_digits('x.m'))}",
    "phone": f"length({_digits('x.m')}) between 8 and 15",
}
#: What a text must hold for a pattern to match at all (cheap, most texts fail).
_NEEDS = {"email": "contains(_t, '@')", "ip": "_num", "card": "_num", "phone": "_num and contains(_t, '+')"}
_GEN_NEEDS = {"email": r"(contains(_t, '@') or _t rlike r'(?i)[(\[\x20]dot[)\]\x20]|[(\[]at[)\]]')", "ip": "_num", "card": "_num", "phone": "_num"}


def base_spans(df: DataFrame) -> DataFrame:
    """``df`` (_t) with b_<kind>: the valid base spans as (s, e)."""
    df = df.withColumn("_num", F.expr("_t rlike '[0-9]'"))
    for k in KINDS:
        found = f"if({_NEEDS[k]}, {_matches(BASE[k])}, {_NONE})"
        df = df.withColumn(f"b_{k}", F.expr(f"transform(filter({found}, x -> {_VALID[k]}), x -> named_struct('s', x.s, 'e', x.e))"))
    return df


def proposals(df: DataFrame) -> DataFrame:
    """``df`` (_t, _num) with _found: what the generators propose, as
    (kind, s, e, m, left, right)."""
    each = []
    for no, k in enumerate(KINDS):
        for g in GENERATORS[k]:
            each.append(f"if({_GEN_NEEDS[k]}, transform({_matches(g)}, x -> named_struct('kind', {no}, 's', x.s, 'e', x.e, 'm', x.m, "
                        f"'left', substring(_t, greatest(x.s - {AROUND}, 0) + 1, least(x.s, {AROUND})), 'right', substring(_t, x.e + 1, {AROUND}))), "
                        "cast(array() as array<struct<kind:int,s:int,e:int,m:string,left:string,right:string>>))")
    return df.withColumn("_found", F.expr(f"array_distinct(concat({', '.join(each)}))"))


#: Whether a proposal is by itself what the base rule accepts (kind, m).
_CERTAIN = " or ".join([
    "(kind = 0 and m rlike r'^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++$')",
    f"(kind = 1 and m rlike r'^[0-9]+([.][0-9]+){{3}}$' and {_octets('m')})",
    f"(kind = 2 and m rlike r'^[0-9](?:[\x20-]?[0-9])++$' and length({_digits('m')}) between 16 and 19 and {_luhn(_digits('m'))})",
    f"(kind = 3 and m rlike r'^[+][0-9][\x20().0-9-]+[0-9]$' and length({_digits('m')}) between 8 and 15)"])

# ----------------------------------------------------------------- features --

def features() -> dict[str, Column]:
    """Format and context of a proposal (m, left, right, kind)."""
    n = lambda cls: F.length(F.regexp_replace("m", cls, "")).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    d = F.expr(_digits("m"))
    groups = F.filter(F.split("m", r"[^0-9]+"), lambda g: g != "")
    out = {f"is_{k}": flag(F.col("kind") == no) for no, k in enumerate(KINDS)}
    out |= {
        "length": F.length("m").cast("double"), "digits": n(r"[^0-9]"), "letters": n(r"[^A-Za-z]"), "blanks": n(r"[^\x20]"),
        "dashes": n(r"[^-]"), "dots": n(r"[^.]"), "brackets": n(r"[^()\[\]]"), "slashes": n(r"[^/]"),
        "groups": F.size(groups).cast("double"),
        "last_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "luhn": flag(F.expr(f"length({_digits('m')}) >= 13 and length({_digits('m')}) <= 19 and {_luhn(_digits('m'))}")),
        "octets": flag(F.expr(f"m rlike r'^[0-9. ]+$' and {_octets("replace(m, ' ', '')")}")),
        "left_word": flag(F.col("left").rlike(r"[\p{L}\p{N}_]$")), "left_blank": flag((F.col("left") == "") | F.col("left").rlike(r"[\s]$")),
        "right_word": flag(F.col("right").rlike(r"^[\p{L}\p{N}_]")), "right_blank": flag((F.col("right") == "") | F.col("right").rlike(r"^[\s.,;:!?)]")),
        "left_digits": F.length(F.regexp_replace("left", "[^0-9]", "")).cast("double"),
        "right_digits": F.length(F.regexp_replace("right", "[^0-9]", "")).cast("double"),
        "hint": F.expr("case " + " ".join(f"when kind = {no} then left rlike r'{HINT[k]}'" for no, k in enumerate(KINDS)) + " end").cast("double"),
        "email_at_mark": flag(F.col("m").contains("@")), "email_at_bracket": flag(F.col("m").rlike(r"(?i)[(\[]at[)\]]")),
        "email_dot_bracket": flag(F.col("m").rlike(r"(?i)[(\[]dot[)\]]")), "email_dot_word": flag(F.col("m").rlike(r"(?i)\x20dot\x20")),
        "email_upper_after_dot": flag(F.col("m").rlike(r"\.[A-Z][a-z]")), "email_local_marks": F.length(F.regexp_replace(F.regexp_extract("m", r"^[A-Za-z0-9._%+-]+", 0), r"[^0-9._%+-]", "")).cast("double"),
        "last_letters": F.length(F.regexp_extract("m", r"[A-Za-z]+$", 0)).cast("double"),
        "first_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(1))), F.lit(0)).cast("double"),
        "second_group": F.coalesce(F.length(F.try_element_at(groups, F.lit(2))), F.lit(0)).cast("double"),
        "first_value": F.coalesce(F.try_element_at(groups, F.lit(1)).try_cast("double"), F.lit(0.0)),
        "rises_by_one": flag((F.size(groups) > 2) & F.forall(F.sequence(F.lit(1), F.greatest(F.size(groups) - 1, F.lit(1))), lambda i: F.coalesce(
            F.try_element_at(groups, i + 1).try_cast("double") - F.try_element_at(groups, i).try_cast("double") == 1, F.lit(False)))),
        "plain_digits": flag(F.col("m").rlike(r"^[0-9]+$")), "starts_zero": flag(F.col("m").rlike(r"^0")), "starts_bracket": flag(F.col("m").rlike(r"^[(+]")),
        "decoy": flag(F.col("left").rlike(DECOY)),
        "number_is_years": flag(d.rlike(r"^(?:(?:19|20)[0-9]{2}){2,}+$")),
    }
    return out


# -------------------------------------------------------------------- model --

class Booster:
    """Fitted trees and a score threshold per kind (none: kind adds nothing)."""

    def __init__(self, model: GBTClassificationModel | None, thresholds: dict[int, float], names: list[str]):
        self.model, self.thresholds, self.names = model, thresholds, names

    def score(self, rows: DataFrame) -> DataFrame:
        vec = VectorAssembler(inputCols=self.names, outputCol="_vec").transform(rows)
        return self.model.transform(vec).withColumn("score", vector_to_array("probability")[1]).drop("_vec", "rawPrediction", "probability", "prediction")

    def accepted(self) -> Column:
        ok = F.lit(False)
        for k, t in self.thresholds.items():
            ok = ok | ((F.col("kind") == k) & (F.col("score") >= t))
        return ok


def _shares(sizes: list[int], room: int) -> list[int]:
    """``room`` dealt evenly; what a small one leaves goes to the larger ones."""
    out, left = [0] * len(sizes), len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        out[i] = min(sizes[i], room // left)
        room, left = room - out[i], left - 1
    return out


def fit(rows: DataFrame, names: list[str], train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Booster:
    """Trees on at most ``train_rows`` proposals (label, features, _pick) of
    one half, thresholds on all of the other half."""
    by = {(r["half"], r["kind"], r["label"]): r["count"] for r in rows.groupBy((F.col("_pick") % 2 != 0).alias("half"), "kind", "label").count().collect()}
    if min(sum(n for (half, _, y), n in by.items() if (half, y) == (h, z)) for h in (False, True) for z in (0.0, 1.0)) < MIN_LABELLED:
        return Booster(None, {}, names)
    train, held = rows.filter("_pick % 2 = 0"), rows.filter("_pick % 2 != 0")
    if (groups := [(k, y) for (half, k, y) in sorted(by) if not half]) and sum(by[False, k, y] for k, y in groups) > train_rows:
        takes = _shares([by[False, k, y] for k, y in groups], train_rows)
        parts = [train.filter((F.col("kind") == k) & (F.col("label") == y)).orderBy("_pick").limit(n) for (k, y), n in zip(groups, takes)]
        train = cut_lineage(reduce(DataFrame.unionAll, parts), "sample")
    vec = VectorAssembler(inputCols=names, outputCol="_vec").transform(train)
    model = GBTClassifier(featuresCol="_vec", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=11).fit(vec.select("_vec", "label"))
    booster = Booster(model, {}, names)
    bins = (booster.score(held).groupBy("kind", F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).alias("bin"))
            .agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")).collect())
    for kind in range(len(KINDS)):
        right = n = 0
        own, lowest = sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]), None
        for i, r in enumerate(own):
            right, n = right + r["right"], n + r["n"]
            if n >= MIN_SUPPORT and right < precision * n:
                break
            if n >= MIN_SUPPORT and (r["right"] or lowest is None):     # no further down than there is something to find
                lowest = i
        if lowest is not None:
            # half way down to the next scores seen
            below = own[lowest + 1]["bin"] + 1 if lowest + 1 < len(own) else 0
            booster.thresholds[kind] = (own[lowest]["bin"] + below) / 2 / SCORE_BINS
    return booster


#: What is settled about a proposal of the corpus: a base span is personal data;
#: one that fails by its digits alone, or lies in a base span of another kind, is not.
_SETTLED = f"""case when is_base then 1.0D when {_CERTAIN} then null
    when kind = 1 and not ({_octets("replace(m, ' ', '')")}) then 0.0D
    when kind = 2 and (touches or not {_luhn(_digits('m'))}) then 0.0D
    when kind = 3 and (touches or length({_digits('m')}) > 15) then 0.0D end"""


def _featured(rows: DataFrame) -> DataFrame:
    """Proposals with their features; _pick orders and halves them."""
    return rows.select("_key", "kind", "s", "e", "label", "touches", *[v.alias(k) for k, v in features().items()],
                       F.xxhash64("_key", "kind", "s", "e").alias("_pick"))


def _against_base(found: DataFrame, base: DataFrame) -> DataFrame:
    """Proposals (_key, kind, s, e, ...) with is_base (a base span itself) and
    touches (overlaps one), by one sorted pass over a text's spans."""
    own = base.select(F.col("_key").alias("_bk"), F.col("kind").alias("_bkind"), F.col("s").alias("_bs"), F.col("e").alias("_be")).distinct()
    found = found.join(own, (F.col("_key") == F.col("_bk")) & (F.col("kind") == F.col("_bkind")) & (F.col("s") == F.col("_bs")) & (F.col("e") == F.col("_be")), "left")
    found = found.withColumn("is_base", F.col("_bk").isNotNull()).drop("_bk", "_bkind", "_bs", "_be")
    # a proposal comes in at its end, before a base span that begins there
    events = found.withColumns({"_at": F.col("e"), "_turn": F.lit(0), "_reach": F.lit(None).cast("int")}).unionByName(
        base.select("_key", F.col("s").alias("_at"), F.lit(1).alias("_turn"), F.col("e").alias("_reach")), allowMissingColumns=True)
    so_far = Window.partitionBy("_key").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("touches", F.coalesce(F.max("_reach").over(so_far) > F.col("s"), F.lit(False))).filter("_turn = 0").drop("_at", "_turn", "_reach")


def _learn(flat: DataFrame, df: DataFrame, text_col: str, names: list[str], train_rows: int) -> Booster:
    """Trees and thresholds from the settled proposals of the corpus and the
    planted ones."""
    spark = df.sparkSession
    pieces = pii_planted.contexts(df.select(text_or_empty(text_col).alias("_t")))
    if not pieces:
        return Booster(None, {}, names)
    texts = pii_planted.planted(pieces, spark).withColumn("_num", F.expr("_t rlike '[0-9]'")).withColumnsRenamed({"kind": "pk", "s": "ps", "e": "pe"})
    made = proposals(texts).select(F.col("id").alias("_key"), "pk", "ps", "pe", "good", F.explode("_found").alias("c")).select("_key", "pk", "ps", "pe", "good", "c.*")
    label = F.expr(f"""case when s >= pe or e <= ps then null when good and kind = pk then if(s = ps and e = pe, 1.0D, null)
        when {_CERTAIN} then null else 0.0D end""")
    made = _featured(made.withColumn("label", label).withColumn("touches", F.lit(False)))
    labelled = cut_lineage(flat.unionByName(made).filter("label is not null"), "labelled")
    return fit(labelled, names, train_rows)


def _apart(accepted: DataFrame) -> DataFrame:
    """(_k, _more): per text the accepted spans, of those that overlap the one
    with the highest score.  Overlaps are settled within runs of spans that
    hang together, which are short, not over a whole text."""
    rows = accepted.select("_key", "kind", "s", "e", "score").dropDuplicates(["_key", "kind", "s", "e"])
    order = Window.partitionBy("_key").orderBy("s", "e", "kind")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (F.col("s") >= F.coalesce(reach, F.lit(0))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = rows.groupBy("_key", "_run").agg(F.sort_array(F.collect_list(F.struct("score", "kind", "s", "e")), asc=False).alias("_all"))
    best = best.withColumn("_all", F.expr("aggregate(_all, cast(array() as array<struct<score:double,kind:int,s:int,e:int>>), "
                                          "(a, x) -> if(exists(a, b -> b.s < x.e and x.s < b.e), a, concat(a, array(x))))"))
    return best.select("_key", F.explode("_all").alias("x")).groupBy(F.col("_key").alias("_k")).agg(
        F.collect_list(F.struct(F.col("x.kind").alias("kind"), F.col("x.s").alias("s"), F.col("x.e").alias("e"))).alias("_more"))


def _span_string(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')"


def find(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``df`` (its columns, or ``keep`` of them) with n_<kind> and base_sha256
    of the base spans, spans (all, as text), n_added and all_spans (kind, s, e)."""
    cols = list(df.columns if keep is None else keep)
    rows = pack(df.select(*[f"`{c}`" for c in dict.fromkeys([*cols, text_col])]))
    rows = rows.withColumn("_t", text_or_empty(F.col("_row")[text_col]))
    rows = proposals(base_spans(rows)).withColumn(
        "_key", F.xxhash64("_t", *[F.col("_row")[c] for c, kind in df.dtypes if c in cols and "map<" not in kind]))
    base = ("array_sort(concat(" + ", ".join(f"transform(b_{k}, x -> named_struct('kind', {no}, 's', x.s, 'e', x.e))" for no, k in enumerate(KINDS)) + "))")
    rows = rows.select(F.struct(*[F.col("_row")[c].alias(c) for c in cols]).alias("_row"), "_key", "_found",
                       *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.expr(base).alias("_base"))
    rows = cut_lineage(rows, "pii")
    names = list(features())
    found = _against_base(rows.filter("size(_found) > 0").select("_key", F.explode("_found").alias("c")).select("_key", "c.*"),
                          rows.filter("size(_base) > 0").select("_key", F.explode("_base").alias("b")).select("_key", "b.*"))
    flat = cut_lineage(_featured(found.withColumn("label", F.expr(_SETTLED))), "proposals")
    booster = _learn(flat, df, text_col, names, train_rows)
    out = rows.withColumn("_more", F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)"))
    if booster.thresholds:
        added = _apart(booster.score(flat.filter("not touches")).filter(booster.accepted()))
        out = rows.join(added, F.col("_key") == F.col("_k"), "left").withColumn("_more", F.coalesce("_more", F.expr("cast(array() as array<struct<kind:int,s:int,e:int>>)")))
    out = out.withColumn("all_spans", F.expr("array_sort(concat(_base, _more))"))
    return unpack(out, cols, *[f"n_{k}" for k in KINDS], F.sha2(F.expr(_span_string("_base")), 256).alias("base_sha256"),
                  F.expr(_span_string("all_spans")).alias("spans"), F.size("_more").cast("long").alias("n_added"), "all_spans")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``df`` (a result of ``find`` that kept the text) with every span
    replaced by its kind's mark; of overlapping spans the first counts."""
    names = "array(" + ", ".join("'" + mark.format(k.upper()) + "'" for k in KINDS) + ")"
    order = "array_sort(transform(all_spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    return df.withColumn(text_col, F.expr(
        f"aggregate({order}, named_struct('at', 0, 'out', ''), "
        f"(a, x) -> if(x.s < a.at, a, named_struct('at', x.e, 'out', concat(a.out, substring({text_col}, a.at + 1, x.s - a.at), {names}[x.kind]))), "
        f"a -> concat(a.out, substring({text_col}, a.at + 1)))"))


def op6_pii(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added")
