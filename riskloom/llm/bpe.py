"""Byte-pair encoding by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be
merged over, so a token must end between them: the text may be cut there
before any merge is looked at.  A piece of the tokenizer's own splitting
pattern is cut at such pairs, each fragment is encoded by itself, and the ids
are concatenated.  Fragments are short and recur: the new pieces of a batch of
texts are encoded together with numpy, a merge per fragment and round, and kept
in a cache of bounded size (two generations; the older one is dropped when the
younger is full).

The vocabulary file (a ``tokenizers`` JSON of kind byte-level BPE) is read on
the driver and broadcast: its size is that of the vocabulary.

Defined cases: null text is empty and gives no ids; the added tokens of the
file (such as an end-of-text mark) are found in a text first, as the library
does; ids that are no UTF-8 together decode with replacement characters, and
unknown ids to nothing.
"""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import small_batches, table

CACHE_PIECES = 80_000   # per generation
LONG = 48                # bytes from which a fragment's merges go through a heap
BATCH_ROWS = 256

# fixed values: white space as the splitting pattern means it, and the pattern
_WS = r"\t-\r\x20\x85\xa0  -     　"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the file: bytes
    that print are themselves, the others follow from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def _slices(items: list, size: int):
    return (items[i:i + size] for i in range(0, len(items), size))


class _Pieces(dict):
    """Piece -> (number of ids, ids joined by commas, ids, the bytes that the
    ids decode to), two generations."""

    def __init__(self, limit: int, bytes_of: dict[int, bytes]):
        self.limit, self.old, self.bytes_of = limit, {}, bytes_of

    def put(self, piece: str, ids: list[int]) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = self.entry(ids)

    def entry(self, ids) -> tuple:
        return len(ids), ",".join(map(str, ids)), tuple(ids), b"".join([self.bytes_of.get(i, b"") for i in ids])   # tuples of plain values cost the garbage collector nothing

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def lookup(self, piece: str):
        return self.get(piece) or self.old.get(piece)


class Bpe:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: str, cache_pieces: int = CACHE_PIECES):
        spec = json.loads(content)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # pair a, b as a * size + b -> rank * size + id of the merged token; NONE: no merge
        self.size = max(vocab.values(), default=0) + 1
        self.none = (len(pairs) + 1) * self.size
        self.merges = {vocab[a] * self.size + vocab[b]: rank * self.size + vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.byte_id = [None] * 256
        self.joined = np.zeros((256, 256), bool)   # pairs inside some token
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.byte_id[raw[0]] = i
            b = np.frombuffer(raw, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.every_byte = None not in self.byte_id
        self.joined_flat = self.joined.tobytes()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces_of = regex.compile(PIECE).findall
        self.pieces = _Pieces(cache_pieces, self.bytes_of)
        order = np.argsort(np.fromiter(self.merges, np.int64, len(self.merges)))
        self.keys = np.fromiter(self.merges, np.int64, len(self.merges))[order]
        self.values = np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]
        self.byte_ids = np.array([-1 if i is None else i for i in self.byte_id], np.int64)

    def fragments(self, raw: bytes) -> list[bytes]:
        """``raw`` cut at every pair that stands inside no token."""
        flat, out, start, a = self.joined_flat, [], 0, raw[0] if raw else 0
        for i in range(1, len(raw)):
            b = raw[i]
            if not flat[a * 256 + b]:
                out.append(raw[start:i])
                start = i
            a = b
        out.append(raw[start:])
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: the pair of lowest rank, leftmost first, until
        none is left."""
        ids = [i for b in raw if (i := self.byte_id[b]) is not None]
        if len(raw) >= LONG:
            return self._merge_long(ids)
        get, none, size = self.merges.get, self.none, self.size
        found = [get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            at = found.index(best)
            ids[at] = best % size
            del ids[at + 1], found[at]
            if at:
                found[at - 1] = get(ids[at - 1] * size + ids[at], none)
            if at < len(found):
                found[at] = get(ids[at] * size + ids[at + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get, none, size = len(ids), self.merges.get, self.none, self.size
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # (rank and merged id, place, the two ids); an entry whose ids have changed is void
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a * size + b, none)) != none]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m % size, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (m := get(ids[k] * size + ids[right[k]], none)) != none:
                    heapq.heappush(heap, (m, k, ids[k], ids[right[k]]))
        return [i for i in ids if i >= 0]

    def encode_piece(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for f in self.fragments(raw):
            out += self.merge(f)
        return out

    def merges_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair, as in ``merges``; ``none`` where
        there is no merge."""
        if not len(self.keys):
            return np.full(len(a), self.none)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.none)

    def encode_pieces(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of many short pieces at once: every fragment of every piece
        merges its best pair in each round."""
        n_piece = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.byte_ids[data]
        piece = np.repeat(np.arange(len(raw)), n_piece)
        # a fragment ends with its piece or at a pair inside no token
        same = (piece[1:] == piece[:-1]) & self.joined[data[:-1], data[1:]]
        alive = np.ones(len(ids), bool)
        here = np.arange(len(ids))                  # places still at work, fragment after fragment
        follow = np.append(np.where(same, here[1:], -1), -1)
        before = np.append(-1, np.where(same, here[:-1], -1))
        value = np.full(len(ids), self.none)
        pairs = np.flatnonzero(same)
        value[pairs] = self.merges_of(ids[pairs], ids[pairs + 1])
        start = np.flatnonzero(np.append(True, ~same))
        frag = np.cumsum(np.append(True, ~same)) - 1
        while len(here):
            best = np.minimum.reduceat(value[here], start)
            size = np.diff(np.append(start, len(here)))
            hit = (value[here] == np.repeat(best, size)) & (value[here] != self.none)
            at = here[hit]
            if not len(at):
                break
            at = at[np.append(True, frag[at][1:] != frag[at][:-1])]      # leftmost in its fragment
            gone = follow[at]
            ids[at] = value[at] % self.size
            alive[gone], value[gone] = False, self.none
            follow[at] = follow[gone]
            value[at] = self.none
            right = at[follow[at] >= 0]
            before[follow[right]] = right
            value[right] = self.merges_of(ids[right], ids[follow[right]])
            left = before[at]
            has = left >= 0
            value[left[has]] = self.merges_of(ids[left[has]], ids[at[has]])
            # on with the fragments that had a merge, without the places merged away
            going = np.zeros(frag[-1] + 1, bool)
            going[frag[at]] = True
            here = here[going[frag[here]] & alive[here]]
            start = np.flatnonzero(np.append(True, frag[here][1:] != frag[here][:-1])) if len(here) else here
        out, ends = ids[alive].tolist(), np.cumsum(np.bincount(piece[alive], minlength=len(raw))).tolist()
        return [out[a:b] for a, b in zip([0, *ends], ends)]

    def learn_pieces(self, pieces) -> None:
        """Put pieces into the cache."""
        short, raw, known = [], [], self.pieces.old
        for p in pieces:
            if (got := known.get(p)) is not None:
                self.pieces.put(p, got[2])
                continue
            b = p.encode("utf-8", "surrogatepass")
            if len(b) < LONG and self.every_byte:
                short.append(p)
                raw.append(b)
            else:
                self.pieces.put(p, self.encode_piece(b))
        if raw:
            for p, ids in zip(short, self.encode_pieces(raw)):
                self.pieces.put(p, ids)

    def split(self, text: str) -> list[str | int]:
        """The pieces of a text; ids where an added token stands."""
        if self.marks is None or not self.marks.search(text):
            return self.pieces_of(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.pieces_of(text[at:m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.pieces_of(text[at:])

    def parts(self, texts: list[str]) -> list[list[tuple[int, str, tuple, bytes]]]:
        """The encoded pieces of each text in order."""
        pieces = [self.split(t) for t in texts]
        found = [list(map(self.pieces.get, p)) for p in pieces]
        new = {x for p, f in zip(pieces, found) if None in f for x, y in zip(p, f) if y is None and isinstance(x, str)}
        for some in _slices(sorted(new), self.pieces.limit):
            self.learn_pieces(some)
            for p, f in zip(pieces, found):
                if None in f:
                    f[:] = [self.pieces.lookup(x) if y is None and isinstance(x, str) else y for x, y in zip(p, f)]
        if self.marks is not None:
            for p, f in zip(pieces, found):
                if None in f:
                    f[:] = [self.pieces.entry([x]) if y is None else y for x, y in zip(p, f)]   # added tokens
        return found

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.parts([text or ""])[0] for i in p[2]]

    def decode(self, ids) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


@contextlib.contextmanager
def loaded(content: str):
    """One encoder per worker process and vocabulary; its cache lasts for a
    task, as an idle worker should hold little memory."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(content)
    try:
        yield _loaded[key]
    finally:
        _loaded[key].pieces.forget()


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _text_batches(batches: Iterator[pa.RecordBatch], column: str):
    for b in batches:
        for start in range(0, b.num_rows, BATCH_ROWS):
            part = b.slice(start, BATCH_ROWS)
            yield part, part.column(column).to_pylist()


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col``; an input column named ``ids_col``
    is replaced."""
    shared = small_batches(df.sparkSession).sparkContext.broadcast(vocabulary)
    cols = [c for c in df.columns if c.lower() != ids_col.lower()]

    def run(batches):
        with loaded(shared.value) as bpe:
            for part, texts in _text_batches(batches, "_text"):
                ids = pa.array([[i for p in parts for i in p[2]] for parts in bpe.parts([t or "" for t in texts])], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["_row", ids_col])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(text_col).alias("_text"))
    schema = rows.select("_row", F.array().cast("array<int>").alias(ids_col)).schema
    return rows.mapInArrow(run, schema).select("_row.*", ids_col)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` (null: empty)."""
    shared = small_batches(df.sparkSession).sparkContext.broadcast(vocabulary)
    cols = [c for c in df.columns if c.lower() != text_col.lower()]

    def run(batches):
        with loaded(shared.value) as bpe:
            for part, ids in _text_batches(batches, "_ids"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(i or []) for i in ids], pa.string())], ["_row", text_col])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, rows.select("_row", F.lit("").alias(text_col)).schema).select("_row.*", text_col)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: number of ids, their digest, the digest of the text
    decoded from them and, ``with_ids``, the ids themselves."""
    shared = small_batches(df.sparkSession).sparkContext.broadcast(vocabulary)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        with loaded(shared.value) as bpe:
            for part, texts in _text_batches(batches, "_text"):
                n, ids_sha, text_sha, listed = [], [], [], []
                for parts in bpe.parts([t or "" for t in texts]):
                    counts, joined, ids, raw = zip(*parts) if parts else ((), (), (), ())
                    n.append(sum(counts))
                    ids_sha.append(sha(",".join(joined)))
                    # the bytes of each piece's ids, decoded once a piece; together they are what the whole list decodes to
                    text_sha.append(sha(b"".join(raw).decode("utf-8", "replace")))
                    if with_ids:
                        listed.append([i for p in ids for i in p])
                cols = [part.column("_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(listed, pa.list_(pa.int32()))] * with_ids, names)
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kinds = dict(zip(names[1:], ["long", "string", "string", "array<int>"]))
    schema = rows.select(F.col("_id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()]).schema
    return rows.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe_encoding_and_decoding(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
