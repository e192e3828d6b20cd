import random
import re
from collections import Counter

import numpy as np
import pytest

from chronoweir.llm import components, minhash, words
from conftest import odd_rows, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent):
    """(id, size of the set, smallest reachable id) of rows (id, text)."""
    found = [(i, shingles(t, k)) for i, t in rows]
    least = {i: i for i, _ in rows}
    links = [(a, b) for x, (a, s) in enumerate(found) for b, t in found[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return sorted((i, len(s), least[i]) for i, s in found)


def corpus(seed):
    """Originals with copies of growing distance, about the threshold too, and chains."""
    rng = random.Random(seed)
    rows = []
    for _ in range(14):
        base = prose(rng, rng.choice([1, 2, 4, 30, 120, 400])).split()
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(["other", words[0].upper(), f"w{rng.randrange(99)}"])
            rows.append(" ".join(words))
            if rng.random() < 0.3:
                base = words  # a chain: what comes next is near this one, not the first
    rows += ["", None, " \n", "A b C", "a\tB c"]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_equals_brute_force(texts_frame, seed, k, percent):
    texts = corpus(seed)
    got = minhash.classes(texts_frame(texts), k, percent).collect()
    assert sorted(map(tuple, got)) == brute([(10 + i, t) for i, t in enumerate(texts)], k, percent)


def test_large_group_in_blocks(texts_frame, monkeypatch):
    """One group of many blocks, whose links must all be found, in the order that makes them a chain."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    words = prose(rng, 300).split()
    texts = []
    for i in range(120):
        words[(i * 37) % 300] = f"new{i}"
        texts.append(" ".join(words))
    order = list(range(120))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    got = minhash.classes(texts_frame(texts), 3, 85).collect()
    want = brute([(10 + i, t) for i, t in enumerate(texts)], 3, 85)
    assert sorted(map(tuple, got)) == want
    assert {c for *_, c in want} == {10}


def test_coordinates_are_filled_and_estimate_similarity():
    rng = np.random.default_rng(1)
    small = minhash.sketches(np.array([5, 77], np.uint64), np.array([2]), 96)
    assert (small != 2**64 - 1).all()
    for share in (0.5, 0.8, 0.95):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        rest = (n - len(both)) // 2
        a, b = (np.concatenate([both, rng.integers(0, 2**63, rest, dtype=np.uint64)]) for _ in range(2))
        s = minhash.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), 960)
        assert abs((s[0] == s[1]).mean() - share) < 0.06
    assert (minhash.sketches(np.empty(0, np.uint64), np.array([0]), 12) == 2**64 - 1).all()


def test_near_dedup_keeps_one_of_each(texts_frame):
    texts = corpus(4)
    want = brute([(10 + i, t) for i, t in enumerate(texts)], 5, 80)
    kept = minhash.near_dedup(texts_frame(texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for *_, c in want})


def brute_rows(rows, k, percent):
    """brute() for rows whose ids repeat or are null: the smallest id of each row's component, and a number for the component (None without words)."""
    found = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for x, s in enumerate(found):
        for y in range(x):
            t = found[y]
            if group[x] != group[y] and s and t and (s == t or len(s) * 100 >= percent * len(t) and len(t) * 100 >= percent * len(s) and 100 * len(s & t) >= percent * len(s | t)):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), least.get(g), g if s else None) for (i, _), s, g in zip(rows, found, group, strict=True)]


def test_near_dedup_of_odd_rows(frame):
    rows = odd_rows()
    want = brute_rows([r[:2] for r in rows], 5, 80)
    kept = minhash.near_dedup(frame(rows)).collect()
    components = {(c, i) for i, _, c, g in want if g is not None}
    assert Counter(r["doc_id"] for r in kept) == Counter([c for c in {g: c for _, _, c, g in want if g is not None}.values()] + [i for i, _, _, g in want if g is None])
    assert all((r["doc_id"], r["doc_id"]) in components for r in kept if shingles(r["text"], 5))


def test_rows_of_one_id_are_apart(frame):
    rng = random.Random(3)
    a, b, c = (prose(rng, 50) for _ in range(3))
    rows = [(1, a), (1, b), (None, c), (None, a), (2, b + " more"), (1, a), (3, None), (3, "")]
    docs = frame([(i, t, None, None, None) for i, t in rows])
    assert Counter((r["doc_id"], r["text"]) for r in minhash.near_dedup(docs).collect()) == Counter([(1, a), (1, b), (None, c), (3, None), (3, "")])
    assert Counter(map(tuple, minhash.classes(docs).collect())) == Counter(x[:3] for x in brute_rows(rows, 5, 80))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_on_which_sums_of_powers_cancel(texts_frame, n):
    x, y = ("".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n)) for swap in (0, 1))
    texts = [f"{x} one two {y}", f"{y} one two {x}", f"{x} {y} {x} {y}", f"{y} {x} {y} {x}"]
    assert sorted(map(tuple, minhash.classes(texts_frame(texts), 3, 85).collect())) == brute([(10 + i, t) for i, t in enumerate(texts)], 3, 85)


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(200, x) for x in range(300, 340)]
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_query(spark, tables):
    at, rows = tables["odd"]
    want = Counter((i, n, c, i == c) for i, n, c, g in brute_rows([r[:2] for r in rows], 3, 85))
    assert Counter(map(tuple, minhash.op10_minhash(spark, at).collect())) == want


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    number, counts = words.exact_words([b"one two One", b"", b"two " + b"x" * 70 + b" " + b"x" * 69 + b"y one"], lower=True)
    assert number.tolist() == [0, 1, 0, 1, 2, 3, 0] and counts.tolist() == [3, 0, 4]
