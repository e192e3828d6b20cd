import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoweir.llm import bpe, token_counts
from conftest import odd_rows, prose

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BYTES)
LIBRARY.no_truncation(), LIBRARY.no_padding()
PIECE_LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
VOCABULARY, KNOWN = bpe.vocabulary(BYTES), token_counts.pieces(PIECES)
TRICKY = ["", " ", "  a", "a  ", "\n\n a\t\tb", "don't I'LL they've", "<|endoftext|>x<|endoftext|>", "<|endof<|endoftext|>text|>", "naïve ٣٤ ②½ ३", "日本語テキスト  混ぜ", "é" * 200, "a" * 500, "\x85\xa0  　x", "࢏\U0001c0de \U0001f600👩‍👩‍👧", "▁ ▁▁a ▁", "<s></s><unk><0x41>", "\x00\x01 \x7f", "1234567890 12,5", "ǅ ʰ ͅ ́a", "͸�﻿x", "-" * 300, "ab" * 300]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check(text):
    ids = library_ids(text)
    assert VOCABULARY.encode(text) == ids
    assert VOCABULARY.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert KNOWN.count([text]) == [len(PIECE_LIBRARY.encode(text, num_threads=1))]


@pytest.mark.parametrize("text", TRICKY)
def test_tricky_texts(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(text):
    check(text)


def test_mixed_texts():
    rng = random.Random(1)
    for _ in range(200):
        check("".join(rng.choice([prose(rng, 3), *TRICKY, chr(rng.randrange(32, 0xD000))]) for _ in range(6)))


def test_all_code_points():
    """Between letters, digits and spaces, as the library sorts them into letters, digits and others."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4000):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}b " for c in points[k : k + 4000])
        assert VOCABULARY.encode(text) == library_ids(text), hex(points[k])


@settings(max_examples=200, deadline=None)
@given(st.text("abcehinrst '", min_size=1, max_size=96))
def test_scan_equals_heap(word):
    raw = word.encode()
    assert bpe.merged_by_scan(raw, VOCABULARY.ranks) == bpe.merged_by_heap(raw, VOCABULARY.ranks)


def test_broken_ids_decode_as_the_library_does():
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(12)]
        assert VOCABULARY.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_whole_pieces_are_one_token():
    some = random.Random(3).sample(sorted(KNOWN.whole), 500)
    for p in some:
        assert KNOWN.merged(p) == [p]


def test_bounded_memory(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 10)
    rng = random.Random(4)
    for _ in range(10):
        check(prose(rng, 30))


def test_queries(spark, tables):
    at, rows = tables["odd"]
    texts = {r[0]: r[1] or "" for r in rows}
    for r in bpe.op3_bpe(spark, at).collect():
        if r["doc_id"] is not None:
            ids = library_ids(texts[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in token_counts.op5_token_counts(spark, at).collect():
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]]
            n = len(PIECE_LIBRARY.encode(text, num_threads=1))
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_round_trip_as_columns(spark, frame):
    docs = frame([r for r in odd_rows() if r[0] is not None][:12])
    back = bpe.decode(bpe.encode(docs, BYTES, ids="_ids"), BYTES, "_ids", "_back").collect()
    assert all(r["_back"] == (r["text"] or "") for r in back)
