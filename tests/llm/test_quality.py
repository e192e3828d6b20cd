import random
import re

import numpy as np
import pytest

from chronoweir.llm import catalog, quality
from conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    n = len(words)
    at, repeats = {}, [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                repeats[i] = max(repeats[i], k)
    inside = lambda least, width: len({i + k for i in range(n) if repeats[i] >= least for k in range(width or repeats[i])})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": inside(3, 3), "n_covered": inside(quality.MIN_WORDS, None), "longest": max(repeats, default=0)}
    return at, repeats


def texts(seed):
    rng = random.Random(seed)
    few = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    out = ["", " ", "a", "a a a a", "x\nx\n x\n\n", few(60, 2), few(80, 4), "z " * 70, "#1 $é <b> é\U0001f600\n" * 4]
    for _ in range(12):
        part = prose(rng, 12)
        out.append("\n".join(rng.choice([part, prose(rng, 8), few(9, 3)]) for _ in range(7)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(seed):
    found = texts(seed)
    m = quality.measures(found)
    for i, t in enumerate(found):
        assert {k: int(v[i]) for k, v in m.items()} == brute(t)[0], t


def test_repeats_of_each_word():
    words = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 1, 2, 3], np.uint64)
    counts = np.array([7, 5])
    assert quality.longest_repeats(words, counts).tolist() == [3, 2, 1, 3, 2, 1, 0, 2, 1, 2, 1, 0]


def test_one_word_many_times():
    assert quality.longest_repeats(np.zeros(50_000, np.uint64), np.array([50_000])).max() == 49_999


def test_verdict(spark, frame):
    rng = random.Random(9)
    clean, part = prose(rng, 400), prose(rng, 120)
    rows = [(1, clean, "en", "s", 0), (2, part + " " + clean + " " + part, "en", "s", 0), (3, " ".join(prose(rng, 9) for _ in range(3)) + (" " + prose(random.Random(1), 12)) * 9 + " " + prose(rng, 40), "en", "s", 0), (4, prose(rng, 49), "en", "s", 0)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judge(frame(rows)).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (True, False), 4: (True, False)}


def test_query(spark, tables):
    at, rows = tables["odd"]
    short = {r[0]: r[1] or "" for r in rows if r[0] is not None and len(r[1] or "") < 3000}
    for r in quality.op6_quality(spark, at).collect():
        if r["doc_id"] in short:
            want, _ = brute(short[r["doc_id"]])
            assert {k: r[k] for k in want} == want
            assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_longest_repeat_is_kept_by_the_operator_only(spark, tables):
    at, _ = tables["odd"]
    whole, query = quality.op6_quality(spark, at), catalog.QUERIES["op6_quality"](spark, at)
    assert "longest" in whole.columns
    assert query.columns == [c for c in whole.columns if c != "longest"]
    assert sorted(map(str, query.collect())) == sorted(map(str, whole.drop("longest").collect()))
