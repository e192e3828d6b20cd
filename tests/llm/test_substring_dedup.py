import hashlib
import random
from collections import Counter

import pytest

from chronoweir.llm import substring_dedup
from conftest import prose

LENGTH = 200


def brute(texts):
    """(bytes, removed, spans, kept) of texts."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + LENGTH] for b in raw for i in range(len(b) - LENGTH + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, 90)[: rng.randrange(150, 700)] for _ in range(6)] + ["é" * 130, "ab" * 180, prose(rng, 60)[:199], prose(rng, 60)[:200], prose(rng, 60)[:201]]
    texts = []
    for _ in range(45):
        parts = [rng.choice([prose(rng, rng.randrange(1, 60)), rng.choice(passages), rng.choice(passages)[: rng.randrange(100, 400)], rng.choice(passages)[rng.randrange(60) :]]) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    return [*texts, texts[0], texts[1], None, "", "x" * 199, "y" * 200, "z" * 201, "w" * 700]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(texts_frame, seed):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup.removed(texts_frame(texts), keep=True).collect()}
    assert [got[10 + i] for i in range(len(texts))] == brute(texts)


def test_a_passage_in_every_document(texts_frame):
    """One gram with as many contents as documents: its windows go the way for hot grams."""
    rng = random.Random(5)
    passage = prose(rng, 60)[:230]
    texts = [prose(rng, 20) + passage + prose(rng, 20) for _ in range(150)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.removed(texts_frame(texts)).collect()}
    want = brute(texts)
    assert [got[10 + i] for i in range(len(texts))] == [w[1:3] for w in want]


@pytest.mark.parametrize(("name", "value"), [("KINDS", 1), ("SYMBOLS", 700), ("SPAN", 7)])
def test_hot_cores_and_small_collections(texts_frame, monkeypatch, name, value):
    monkeypatch.setattr(substring_dedup, name, value)
    texts = corpus(5)
    got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.removed(texts_frame(texts), keep=True).collect()}
    assert [got[10 + i] for i in range(len(texts))] == [w[3] for w in brute(texts)]


def test_null_and_repeated_ids(frame):
    rng = random.Random(8)
    passage = prose(rng, 60)[:200]
    texts = [passage, passage, passage + "z", "y" + passage, prose(rng, 80), None]
    ids = [1, None, None, 1, None, None]
    got = substring_dedup.removed(frame([(i, t, None, None, 0) for i, t in zip(ids, texts, strict=True)])).collect()
    want = [(i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in zip(ids, brute(texts), strict=True)]
    assert Counter(tuple(r) for r in got) == Counter(want)


def morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_texts_on_which_sums_of_powers_cancel(texts_frame, n):
    texts = [morse(n), morse(n, True), morse(n // 2) + "c" + morse(n // 2, True)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.removed(texts_frame(texts)).collect()}
    assert [got[10 + i] for i in range(3)] == [w[1:3] for w in brute(texts)]


def test_long_texts(texts_frame):
    rng = random.Random(9)
    long = prose(rng, 12_000)
    texts = [long, long[:30_000] + "#" + long[30_000:], "ab" * 40_000, "abc" * 30_000 + long[500:900]]
    assert all(len(t) > 50_000 for t in texts)
    got = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.removed(texts_frame(texts), keep=True).collect()}
    assert [got[10 + i] for i in range(len(texts))] == [w[3] for w in brute(texts)]


def windows(texts):
    number, gram, _, where = substring_dedup.runs(texts)
    out = []
    for i, g, w in zip(number.tolist(), gram.tolist(), where.tolist(), strict=True):
        first, n, offset = w >> 16, (w >> 8) & 0xFF, w & 0xFF
        out += [(i, first + k, g, offset - k) for k in range(n)]
    return sorted(out)


def test_every_window_is_in_one_run(monkeypatch):
    rng = random.Random(6)
    texts = [prose(rng, 900).encode(), b"", b"q" * 450, prose(rng, 28).encode()[:199]]
    whole = windows(texts)
    assert [(i, p) for i, p, *_ in whole] == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - LENGTH + 1)]
    monkeypatch.setattr(substring_dedup, "PIECE", 500)
    assert windows(texts) == whole


def test_query(spark, tables):
    at, rows = tables["odd"]
    want = Counter((r[0], *w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, brute([r[1] for r in rows]), strict=True))
    assert Counter(tuple(r) for r in substring_dedup.op2_substring_dedup(spark, at).collect()) == want
