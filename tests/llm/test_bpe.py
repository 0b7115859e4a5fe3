import hashlib
import random

import pytest

from riskloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

PIECES = ["a", "b", "E", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "'", "1", "23", "é", "ü", "中", "文", "🙂", " ", "　", " ", "\x85", "\x1c", "<|endoftext|>",
          "<|end", "---", "...", "!!", "=", "x" * 60, "qzxj", "ſ", "Ⅷ", "½", "٣", "̈", "​", "﻿", "\x00", "don't", "I'M"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_the_library(library):
    own, rng = bpe.Bpe(bpe.default_vocabulary(), cache_pieces=50), random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", "ab" * 3000, "x" * 5000, "=" * 4000, " " * 5000, "\n" * 3000 + "a"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == t


def test_pieces_carry_the_bytes_their_ids_decode_to(library):
    """Decoding is done once a piece; the bytes of a text's pieces together
    decode as the whole list of ids, also where a character spans ids."""
    own, rng = bpe.Bpe(bpe.default_vocabulary(), cache_pieces=50), random.Random(4)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(300)] + ["", "x\ud800y"]
    for t, parts in zip(texts, own.parts(texts)):
        ids = [i for p in parts for i in p[2]]
        assert b"".join(p[3] for p in parts) == b"".join(own.bytes_of.get(i, b"") for i in ids)
        assert b"".join(p[3] for p in parts).decode("utf-8", "replace") == own.decode(ids)
        assert own.decode(ids) == (library.decode(ids, skip_special_tokens=False))


def test_fragments_are_cut_at_pairs_in_no_token():
    own = bpe.Bpe(bpe.default_vocabulary())
    raw = "thqx 中zq".encode()
    frags = own.fragments(raw)
    assert b"".join(frags) == raw and len(frags) > 1
    tokens = list(own.bytes_of.values())
    for a, b in zip(frags, frags[1:]):
        assert not any(a[-1:] + b[:1] in t for t in tokens if len(t) < 12 and t != b"<|endoftext|>")


def test_partial_characters_decode_like_the_library(library):
    own = bpe.Bpe(bpe.default_vocabulary())
    for ids in ([127], [127, 239], [47704, 127, 64], [50256, 64], []):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents(library, odd, odd_rows):
    vocabulary = bpe.default_vocabulary()
    got = bpe.round_trip(odd, vocabulary, with_ids=True).collect()
    want = []
    for i, t, *_ in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    encoded = bpe.encode(odd, vocabulary)
    assert encoded.columns[-1] == "ids" and len(encoded.columns) == len(odd.columns)
    back = bpe.decode(encoded, vocabulary)
    assert all(r.decoded == (r.text or "") for r in back.collect())


def test_empty(empty):
    assert bpe.round_trip(empty, bpe.default_vocabulary()).count() == 0
    assert bpe.decode(bpe.encode(empty, bpe.default_vocabulary()), bpe.default_vocabulary()).count() == 0
