import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweir.llm import bwt
from chronoweir.llm.bwt import repeated, transform


def brute(strings, cap):
    """Suffixes in order, and common prefixes of neighbours."""
    suffixes = sorted(s[i:] for s in strings for i in range(len(s)))
    out = [0] if suffixes else []
    for a, b in zip(suffixes, suffixes[1:]):
        n = 0
        while n < min(cap, len(a), len(b)) and a[n] == b[n]:
            n += 1
        out.append(n)
    return suffixes, out


def found(strings, cap):
    before, ends, at = [], [], 0
    for s in strings:
        before += [0, *(x + 1 for x in s)]
        at += len(s) + 1
        ends.append(at - 1)
    place, prefix = transform(np.array(before, np.uint16), np.arange(-1, len(before) - 1, dtype=np.int32), np.array(ends), cap)
    flat = [s[i:] for s in strings for i in range(len(s) + 1)]
    return [flat[p] for p in place.tolist()], prefix.tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\0ô", max_size=9).map(str.encode), min_size=1, max_size=8), st.integers(1, 9))
def test_equals_brute_force(strings, cap):
    assert found(strings, cap) == brute(strings, cap)


def test_longer_strings():
    rng = random.Random(1)
    base = [bytes(rng.choice(b"abcdef ") for _ in range(60)) for _ in range(3)]
    strings = [bytes(b if rng.random() > 0.02 else 35 for b in rng.choice(base)[rng.randrange(20) :]) for _ in range(12)]
    assert found(strings, 200) == brute(strings, 200)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([100, 150, 200]), st.booleans())
def test_windows_of_stretches(seed, width, collide):
    rng = random.Random(seed)
    base = bytes(rng.choice(b"ab") for _ in range(400))
    strings, owner, place = [], [], []
    for i in range(rng.randrange(1, 9)):
        a = rng.randrange(100)
        strings.append(bytes(b if rng.random() > 0.02 else 99 for b in base[a : a + rng.randrange(width, width + 40)])), owner.append(i), place.append(rng.randrange(100))
        if len(strings[-1]) < width:
            strings.pop(), owner.pop(), place.pop()
        elif rng.random() < 0.2:  # the same stretch again is no other place
            strings.append(strings[-1]), owner.append(i), place.append(place[-1])
    if strings:
        at = {}
        for s, o, p in zip(strings, owner, place, strict=True):
            for i in range(len(s) - width + 1):
                at.setdefault(s[i : i + width], set()).add((o, p + i))
        want = [len(at[s[i : i + width]]) > 1 for s in strings for i in range(len(s) - width + 1)]
        with pytest.MonkeyPatch.context() as patch:
            if collide:  # words with one hash are told apart
                patch.setattr(bwt, "mixed", lambda x: x & np.uint64(3))
            got = repeated(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), np.array(owner), np.array(place), width)
        assert got.tolist() == want
