import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from chronoweir.llm import fingerprints as fp
from conftest import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text("ABC+/", max_size=64), st.text("ABC+/", max_size=64))
def test_edit_distances(a, b):
    assert fp.edit_distances([a, b], [b, a]).tolist() == [distance(a, b)] * 2


def test_alone_or_among_others():
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(400)).encode() for _ in range(40)] + [b"", b"a", bytes(range(256)) * 9]
    assert fp.fingerprints(texts) == [fp.fingerprints([t])[0] for t in texts]
    for f in fp.fingerprints(texts):
        size, a, b = f.split(":")
        assert int(size) >= 1 and len(a) <= fp.MOST and len(b) <= fp.MOST
    assert fp.fingerprints([b""]) == ["1::"]
    assert fp.fingerprints([]) == []


def test_likeness_falls_with_edits():
    rng = random.Random(2)
    words = prose(rng, 3000).split()
    of = lambda w: fp.fingerprints([" ".join(w).encode()])[0]
    few, many = list(words), list(words)
    few[700:704] = ["changed"] * 5
    for i in range(0, 3000, 20):
        many[i] = "other"
    other = prose(rng, 3000).split()
    same, near, far, none = fp.likeness([of(words)] * 4, [of(words), of(few), of(many), of(other)])
    assert same == 1 and near > 0.9 and near > far and none < 0.3
    half = fp.likeness([of(words)], [of(words[:1500] + other[1500:])])[0]
    assert 0.3 < half < 0.8
    doubled = fp.likeness([of(words)], [of(words + other[:1800])])[0]  # block sizes may differ by two
    assert doubled > none


def plain_fingerprint(text):
    """Byte by byte."""
    if not text:
        return "1::"
    m32, m64 = 2**32 - 1, 2**64 - 1

    def roll(i):
        x = text[i] * 0x9E3779B1
        for j in range(1, 7):
            x ^= ((text[i - j] if i >= j else 0) * (0x85EBCA77 + 2 * j) & m32) << 3 * j
        x &= m32
        x ^= x >> 15
        x = x * 0x2C1B3C6D & m32
        return x ^ x >> 13

    def letter(piece):
        x = (sum((b + 1) * pow(0x5851F42D4C957F2D, i, 2**64) for i, b in enumerate(piece)) + len(piece)) & m64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(x ^ x >> 31) >> 58]

    rolls = [roll(i) for i in range(len(text))]
    ends = lambda size: [i + 1 for i, x in enumerate(rolls) if x % size == 0]
    size = 1
    while size * 32 <= len(text):
        size *= 2
    while len(ends(size)) < 32 and size > 1:
        size //= 2
    out = [str(size)]
    for z in (size, 2 * size):
        stops = ends(z)[:63]
        stops += [len(text)] if not stops or stops[-1] < len(text) else []
        out.append("".join(letter(text[x:y]) for x, y in zip([0, *stops], stops)))
    return ":".join(out)


def plain_likeness(x, y):
    if x == y:
        return 1.0
    (n, a, b), (m, c, d) = x.split(":"), y.split(":")
    best = 0.0
    for size, u in ((int(n), a), (2 * int(n), b)):
        for other, v in ((int(m), c), (2 * int(m), d)):
            w = min(4, len(u), len(v))
            if size == other and w and any(u[i : i + w] in v for i in range(len(u) - w + 1)):
                best = max(best, 1 - distance(u, v) / max(len(u), len(v)))
    return best


def test_plain_fingerprints():
    rng = random.Random(5)
    texts = [prose(rng, n).encode() for n in (1, 3, 9, 40, 200, 700, 3000)] + [b"x", b"ab" * 900, b"\0" * 70]
    assert fp.fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def test_query(spark, tables):
    """Every row of the odd table against the plain version; rows of one id come in the order of their texts, null ids last."""
    at, rows = tables["odd"]
    ordered = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    prints = {t: plain_fingerprint((t or "").encode()) for _, t in ordered}
    want = Counter()
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, after = t or "", after or ""
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        edited = plain_fingerprint(changed.encode())
        want[(i, len(t), hashlib.sha256(changed.encode()).hexdigest(), prints[t] if t else "1::", edited, round(plain_likeness(prints.get(t, "1::"), edited), 9), round(plain_likeness(prints.get(t, "1::"), prints.get(after, "1::")), 9))] += 1
    got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fp.op7_fingerprints(spark, at).collect())
    assert got == want


def test_one_row_is_its_own_next(texts_frame):
    (r,) = fp.with_next(texts_frame(["only one"])).collect()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"onlyonly").hexdigest()


def test_the_last_is_followed_by_the_first(texts_frame):
    texts = [f"{i} " * 20 for i in range(9)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fp.with_next(texts_frame(texts)).collect()}
    for i, t in enumerate(texts):
        assert got[10 + i] == hashlib.sha256(fp.edited(t, texts[i - 1]).encode()).hexdigest()
