"""Language identification of mixed text.

Learnt: hashed counts per language of words and of byte trigrams inside words
(a word is a run of ASCII letters and non-ASCII bytes), and in which scripts
each language is written.  A word's script, from Unicode ranges, narrows the
languages that may claim it; each of these gets the log-likelihood of the
word's features, relative to the best and bounded, so no single word decides.
Viterbi over the words of a text, with a penalty for each switch, labels its
spans; the language with the most letters is the prediction.

Most texts are of one language.  If no stretch of words prefers some other
language by more than the penalty (nor a beginning and an end together), no
switch can pay and the path is constant; only other texts go through the full
recursion.

The model's size is fixed by ``bits`` and the number of languages; counting
sums dense slices per task, and one table of that size reaches the driver.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
without any training text everything is ``und``; languages tie in code point
order; repeated rows count and are labelled alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, sum_slices, table
from riskloom.llm.textvec import BYTE_VALUE, LOWER, chunks, run_hashes, runs

BITS = 17               # hashed features per language: 2 ** BITS
SLICE = 1 << 13         # counts in a row of the counting job
CLIP = 6.0              # a word's evidence for or against a language at most
SWITCH = 18.0           # penalty of a switch
SCRIPT_SHARE = 0.01     # of a language's words in a script it is written in
UNKNOWN = "und"

# fixed values: where the code point ranges of scripts begin (number of the script)
SCRIPTS = [
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_SCRIPT_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT_NO = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])

_LETTER_BYTE = np.zeros(256, bool)
_LETTER_BYTE[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_HAS_LETTER = regex.compile(r"\p{L}").search


@dataclass
class Words:
    """The words of a chunk: their text, letters, script and features."""

    doc: np.ndarray        # number of the text each word is in
    start: np.ndarray      # of the word in the chunk's bytes
    end: np.ndarray
    script: np.ndarray
    word: np.ndarray       # hashed feature of the whole word
    tri: np.ndarray        # hashed trigram features, word after word
    tri_from: np.ndarray   # where a word's trigrams begin


def words_in(data: np.ndarray, offsets: np.ndarray, bits: int) -> Words:
    letter = _LETTER_BYTE[data]
    start, end, doc = runs(letter, offsets)
    low = LOWER[data]
    mask = np.uint64((1 << bits) - 1)
    word = (run_hashes(BYTE_VALUE[low], start, end) & mask).astype(np.int32) if len(start) else np.empty(0, np.int32)
    # trigrams: the byte with its neighbours inside the word, blank beyond
    mid = np.flatnonzero(letter)
    of_word = np.repeat(np.arange(len(start)), end - start)
    cur = low[mid].astype(np.uint64)
    left = np.where(mid > start[of_word], low[np.maximum(mid - 1, 0)], 32).astype(np.uint64)
    right = np.where(mid + 1 < end[of_word], low[np.minimum(mid + 1, len(low) - 1)], 32).astype(np.uint64)
    tri = ((((left << np.uint64(16)) | (cur << np.uint64(8)) | right) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    tri_from = np.concatenate(([0], np.cumsum(end - start)[:-1])) if len(start) else np.empty(0, np.int64)
    # code point of the word's first character
    b = [data[np.minimum(start + k, len(data) - 1)].astype(np.int64) for k in range(4)] if len(start) else [np.empty(0, np.int64)] * 4
    tail = lambda x: x & 0x3F
    code = np.where(b[0] < 0xC0, b[0] & 0x7F,
                    np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | tail(b[1]),
                             np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | tail(b[1]) << 6 | tail(b[2]),
                                      (b[0] & 7) << 18 | tail(b[1]) << 12 | tail(b[2]) << 6 | tail(b[3]))))
    script = _SCRIPT_NO[np.searchsorted(_SCRIPT_FROM, code, "right") - 1]
    return Words(doc, start, end, script, word, tri.astype(np.int32), tri_from)


# ----------------------------------------------------------------- learning --

def _counts(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << bits
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column("_lang").to_pylist(), object)
            for first, to, data, offsets in chunks(b.column("_text"), 1 << 20):
                w = words_in(data, offsets, bits)
                per_doc = lang[first:to]
                for name in set(per_doc):
                    c = seen.setdefault(name, np.zeros(size + SLICE, np.int64))
                    own = (per_doc == name)[w.doc] if len(w.doc) else np.empty(0, bool)
                    c[:size] += np.bincount(w.word[own], minlength=size)
                    c[:size] += np.bincount(w.tri[np.repeat(own, w.end - w.start)], minlength=size)
                    c[size:size + len(SCRIPT_NAMES)] += np.bincount(w.script[own], minlength=len(SCRIPT_NAMES))
        for name, c in seen.items():
            for no in range(0, len(c), SLICE):
                if c[no:no + SLICE].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([no // SLICE], pa.int32()), pa.array([c[no:no + SLICE]], pa.list_(pa.int64()))], ["lang", "slice", "counts"])
    return count


@dataclass
class Model:
    """Languages in code point order; log-likelihoods by feature and language;
    which languages a script allows."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray
    bits: int


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = BITS) -> Model:
    """The model of all texts of ``df`` that have a language."""
    small_batches(df.sparkSession)
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    schema = "lang string, slice int, counts array<long>"
    slices = rows.mapInArrow(_counts(bits), schema).groupBy("lang", "slice").applyInArrow(sum_slices, schema)
    size, found = 1 << bits, {}
    for r in slices.toLocalIterator():
        c = found.setdefault(r["lang"], np.zeros(size + SLICE, np.int64))
        c[r["slice"] * SLICE:(r["slice"] + 1) * SLICE] = r["counts"]
    langs = sorted(found)
    counts = np.array([found[x][:size] for x in langs], np.float64).reshape(len(langs), size)
    logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * size))
    scripts = np.array([found[x][size:size + len(SCRIPT_NAMES)] for x in langs], np.float64).reshape(len(langs), len(SCRIPT_NAMES))
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(1, keepdims=True))
    return Model(langs, np.ascontiguousarray(logs.T.astype(np.float32)), np.ascontiguousarray(allowed.T), bits)


# --------------------------------------------------------------- predicting --

def word_scores(w: Words, model: Model) -> np.ndarray:
    """Evidence of each word for each language, between -CLIP and 0; 0 for all
    where the script tells nothing."""
    if not len(w.doc):
        return np.zeros((0, len(model.langs)))
    s = np.add.reduceat(model.table[w.tri], w.tri_from, axis=0, dtype=np.float64) + model.table[w.word]
    allowed = model.allowed[w.script]
    s = np.where(allowed, s, -np.inf)
    top = s.max(1, keepdims=True)
    none = ~allowed.any(1)
    top[none] = 0
    s = np.maximum(s - top, -CLIP)
    s[none] = 0
    return s


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language per word; ties stay, then go to the earlier language."""
    n, m = s.shape
    best, came = s[0].tolist(), []
    for row in s[1:].tolist():
        top = max(best)
        at, floor = best.index(top), top - switch
        came.append([i if best[i] >= floor else at for i in range(m)])
        best = [max(b, floor) + x for b, x in zip(best, row)]
    path = [best.index(max(best))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return np.array(path[::-1])


def _may_switch(s: np.ndarray, doc: np.ndarray, first: np.ndarray, base: np.ndarray, switch: float) -> np.ndarray:
    """Per text (words ``first`` on): whether a path with switches could beat
    the constant path ``base``, the best of the constant ones.

    Away from ``base`` a path's k stretches cost k switches or more, unless
    they fill the whole text: then k - 1, and the first and last stretch begin
    and end it.  So none pays if no stretch gains more than a switch, nor a
    beginning and an end together.
    """
    n = np.diff(np.append(first, len(s)))
    last = first + n - 1
    gain, head, tail = np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(first))
    own = s[np.arange(len(s)), base]
    # a falling offset per text resets the running minimum
    drop = np.repeat(np.arange(len(first)), n) * (2 * CLIP * (len(s) + 1))
    for k in range(s.shape[1]):
        d = s[:, k] - own
        sums = np.cumsum(d)
        before = sums - d
        low = np.minimum.accumulate(before - drop) + drop
        gain = np.maximum(gain, np.maximum.reduceat(sums - low, first))
        head = np.maximum(head, np.maximum.reduceat(sums, first) - before[first])
        tail = np.maximum(tail, sums[last] - np.minimum.reduceat(before, first))
    # a little less than the penalty: sums over many words are rounded
    return (gain > switch - 1e-6) | (head + tail > switch - 1e-6)


def spans_of(data: np.ndarray, offsets: np.ndarray, model: Model, switch: float = SWITCH):
    """(words, path, score sums per text and language, first word and number
    of the texts that have words)."""
    w = words_in(data, offsets, model.bits)
    s = word_scores(w, model)
    if not len(w.doc):
        return w, np.empty(0, int), np.zeros((0, len(model.langs))), np.empty(0, int), np.empty(0, int)
    first = np.flatnonzero(np.concatenate(([True], w.doc[1:] != w.doc[:-1])))
    sums = np.add.reduceat(s, first, axis=0)
    base = sums.argmax(1)
    n_words = np.diff(np.append(first, len(s)))
    path = np.repeat(base, n_words)
    for i in np.flatnonzero(_may_switch(s, w.doc, first, path, switch)):
        a, b = first[i], first[i] + n_words[i]
        path[a:b] = viterbi(s[a:b], switch)
    return w, path, sums, first, w.doc[first]


def _label(model_bc, switch: float, with_spans: bool, with_known: bool, path_to_text: list[str]):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = model_bc.value
        names, m = np.array([*model.langs, UNKNOWN], object), len(model.langs)
        step = max(1 << 16, (1 << 20) // max(4, m))
        for b in batches:
            texts = b.column(path_to_text[0])
            for field in path_to_text[1:]:
                texts = texts.field(field)
            pred, score, n_spans, spans, known = [], [], [], [], []
            for first, to, data, offsets in chunks(texts, step):
                n = to - first
                own = np.full(n, m)
                conf, runs_, listed, seen = np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)], np.zeros(n)
                if m:
                    w, path, sums, start, doc = spans_of(data, offsets, model, switch)
                    letters = np.zeros((n, m))
                    np.add.at(letters, (w.doc, path), w.end - w.start)
                    has = np.array([_HAS_LETTER(t or "") is not None for t in texts.slice(first, n).to_pylist()], bool)
                    own = np.where(has, letters.argmax(1), m)
                    total = letters.sum(1)
                    share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0)
                    sure = np.full(n, 1 / m)
                    if len(doc):
                        e = np.exp((sums - sums.max(1, keepdims=True)) / 3)
                        sure[doc] = 1 / e.sum(1)
                    conf = np.where(has, share * sure, 0)
                    if with_known:
                        np.add.at(seen, w.doc, np.where(model.allowed[w.script].any(1), w.end - w.start, 0))
                        seen = np.where(has, seen / np.maximum(total, 1), 0)
                    if len(path):
                        new = np.concatenate(([True], (w.doc[1:] != w.doc[:-1]) | (path[1:] != path[:-1])))
                        np.add.at(runs_, w.doc[new], 1)
                        if with_spans:
                            at = np.flatnonzero(new)
                            stop = np.append(at[1:], len(path)) - 1
                            for d, l, x, y in zip(w.doc[at], path[at], w.start[at], w.end[stop]):
                                base = int(offsets[d])
                                listed[d].append({"lang": model.langs[l], "start": int(x) - base, "end": int(y) - base})
                pred += names[own].tolist()
                score += conf.tolist()
                n_spans += np.where(own < m, runs_, 0).tolist()
                spans += listed
                known += seen.tolist()
            cols = [b.column("_row"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(n_spans, pa.int64())]
            labels = ["_row", "lang_pred", "score", "n_spans"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                labels.append("spans")
            if with_known:
                cols.append(pa.array(known, pa.float64()))
                labels.append("known")
            yield pa.RecordBatch.from_arrays(cols, labels)
    return label


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, switch: float = SWITCH, with_spans: bool = False,
            with_known: bool = False) -> DataFrame:
    """``df`` (its columns, or ``keep`` of them; ``text_col`` may be a field
    of a struct, written with a dot) with lang_pred, score (0 to 1), n_spans and, if asked for, spans (language, start and end in bytes of
    UTF-8) and known, the share of the letters in words whose script some
    learnt language has.  Only the text enters a prediction."""
    small_batches(df.sparkSession)
    cols = list(df.columns if keep is None else keep)
    added = {"lang_pred": "string", "score": "double", "n_spans": "long"} | ({"spans": "array<struct<lang:string,start:int,end:int>>"} if with_spans else {}) | ({"known": "double"} if with_known else {})
    row = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row")
    # a text that is kept anyway goes to the task once, in its row
    path = ["_row", *text_col.split(".")] if text_col.split(".")[0] in cols else ["_text"]
    rows = df.select(row) if path[0] == "_row" else df.select(row, F.col(text_col).alias("_text"))
    schema = rows.select("_row", *[F.lit(None).cast(t).alias(c) for c, t in added.items()]).schema
    out = rows.mapInArrow(_label(df.sparkSession.sparkContext.broadcast(model), switch, with_spans, with_known, path), schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in cols if c.lower() not in added], *added)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = learn(docs.filter(~out))
    found = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_spans")
