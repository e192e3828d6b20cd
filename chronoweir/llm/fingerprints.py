"""Document fingerprints: context-triggered piecewise hashing.

A hash of the last WINDOW bytes rolls over the text; where it ends in enough zero bits, a piece ends. Each piece gives one of 64 characters by a hash of its bytes. A fingerprint is `size:signature:signature`, the signatures at block size `size` and twice that. The block size is the largest power of two that gives a text of its length 32 pieces on average, halved while there are fewer; a signature has 64 characters at most, the last standing for all the rest of the text.

Likeness of two fingerprints: 1 if equal, else the best over compatible block sizes (equal, or one twice the other) of 1 - edit distance / longer length, and 0 where signatures share no run of COMMON characters. Edit distances of many pairs are counted together, bit-parallel, one machine word a pair.

The next document of each is found by sorting: documents are dealt by ranges of doc_id and sorted in their partitions, so that only each partition's first and last document meet another partition's.

Cases: null ids: rows like others, after all others in descending order. Null text: empty. Empty text: fingerprint `1::`. Equal texts have equal fingerprints, whatever the partition. A table of one row: the document is its own next one. Repeated ids and rows are ordered by text; equal rows are told apart by nothing, and each has the next row. Empty table: empty result. Other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mixed

WINDOW = 7
LEAST, FEW, MOST = 32, 32, 64
COMMON = 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x5851F42D4C957F2D | 1


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base & (2**64 - 1), np.uint64), dtype=np.uint64)])


_TABLES = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int):
    if len(_TABLES[0]) < n:
        _TABLES[:] = [_powers(_BASE, 2 * n), _powers(pow(_BASE, -1, 1 << 64), 2 * n)]
    return _TABLES


def fingerprints(texts: list[bytes]) -> list[str]:
    """The fingerprint of each text."""
    joined = np.frombuffer(bytes(WINDOW).join([b"", *texts]), np.uint8)
    if not len(joined):
        return ["1::"] * len(texts)
    with np.errstate(over="ignore"):
        # the rolling hash of the last WINDOW bytes: before a text stand WINDOW zeros
        value = joined.astype(np.uint32)
        roll = value * np.uint32(0x9E3779B1)
        for j in range(1, WINDOW):
            roll[j:] ^= (value[:-j] * np.uint32(0x85EBCA77 + 2 * j)) << np.uint32(3 * j)
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x2C1B3C6D)
        roll ^= roll >> np.uint32(13)
        up, down = _tables(len(joined) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], dtype=np.uint64)])
    # trailing zero bits of each place, as its lowest bit
    low = roll & (~roll + np.uint32(1))
    low[roll == 0] = np.uint32(1 << 31)
    out, at = [], 0
    pieces, numbers = [], []
    for t in texts:
        at += WINDOW
        n = len(t)
        if not n:
            out.append((1, 0, 0))
            continue
        mine = low[at : at + n]
        k = max(0, (n // LEAST).bit_length())
        ends = np.nonzero(mine >= (1 << k))[0]
        while len(ends) < FEW and k:
            k -= 1
            ends = np.nonzero(mine >= (1 << k))[0]
        for size, found in ((1 << k, ends), (2 << k, ends[mine[ends] >= (2 << k)])):
            found = found[: MOST - 1] if len(found) >= MOST else found
            found = found + (at + 1)
            if not len(found) or found[-1] < at + n:
                found = np.append(found, at + n)
            pieces.append(found)
            numbers.append((at, len(found)))
        out.append((1 << k, numbers[-2][1], numbers[-1][1]))
        at += n
    if not pieces:
        return ["1::"] * len(texts)
    stops = np.concatenate(pieces)
    starts = np.empty_like(stops)
    starts[1:] = stops[:-1]
    counts = np.array([n for _, n in numbers])
    starts[np.cumsum(counts) - counts] = [a for a, _ in numbers]
    with np.errstate(over="ignore"):
        piece = mixed((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    letters = ALPHABET[(piece >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    found, at = [], 0
    for size, a, b in out:
        found.append(f"{size}:{letters[at : at + a]}:{letters[at + a : at + a + b]}")
        at += a + b
    return found


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of pairs of strings of at most 64 characters of the alphabet."""
    n = len(a)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    pattern, text = np.zeros((n, MOST), np.uint8), np.zeros((n, MOST), np.uint8)
    for m, lengths, strings in ((pattern, la, a), (text, lb, b)):
        m[np.arange(MOST) < lengths[:, None]] = np.frombuffer("".join(strings).encode(), np.uint8)
    one, full = np.uint64(1), np.uint64(2**64 - 1)
    peq = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for j in range(MOST):
        live = rows[j < la]
        peq[live, pattern[live, j]] |= one << np.uint64(j)
    plus, minus = np.full(n, full), np.zeros(n, np.uint64)
    score, last = la.copy(), one << np.maximum(la - 1, 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(int(lb.max(initial=0))):
            live = j < lb
            eq = peq[rows, text[:, j]]
            x = eq | minus
            y = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(y | plus), plus & y
            score += live & (la > 0) & ((up & last) > 0)
            score -= live & (la > 0) & ((down & last) > 0)
            up, down = (up << one) | one, down << one
            plus = np.where(live, down | ~(x | up), plus)
            minus = np.where(live, up & x, minus)
    return np.where(la == 0, lb, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness, 0 to 1, of pairs of fingerprints."""
    out = np.zeros(len(a))
    left, right, where = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y:
            out[i] = 1.0
            continue
        (n, p, q), (m, r, s) = x.split(":"), y.split(":")
        n, m = int(n), int(m)
        for u, v in ((p, r), (q, s)) if n == m else ((p, s),) if n == 2 * m else ((q, r),) if m == 2 * n else ():
            w = min(COMMON, len(u), len(v))
            if w and not {u[k : k + w] for k in range(len(u) - w + 1)}.isdisjoint(v[k : k + w] for k in range(len(v) - w + 1)):
                left.append(u), right.append(v), where.append(i)
    if left:
        longer = np.maximum(np.fromiter(map(len, left), np.int64), np.fromiter(map(len, right), np.int64))
        np.maximum.at(out, where, 1 - edit_distances(left, right) / longer)
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                found = fingerprints([t.encode() for t in common.texts(part)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids, own: list[str], following: list[str]) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(own, following, strict=True)]
    prints = fingerprints([t.encode() for t in (*own, following[-1])]) if following[:-1] == own[1:] else None
    mine, other = (prints[:-1], prints[1:]) if prints else (fingerprints([t.encode() for t in own]), fingerprints([t.encode() for t in following]))
    changed_prints = fingerprints([t.encode() for t in changed])
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(mine, pa.string()), pa.array(changed_prints, pa.string()), pa.array(likeness(mine, changed_prints)), pa.array(likeness(mine, other)),
    ]


def with_next(docs: DataFrame) -> DataFrame:
    """Each document of docs (doc_id, text) compared with its edited text and with the next by descending doc_id.

    Partitions give their pairs, and their first and last text as rows of their own: a few rows a partition, which are joined afterwards.
    """
    names = ["doc_id", *_ROW, "_place", "_head", "_tail"]

    def run(batches):
        place = TaskContext.get().partitionId()
        head = last = None
        for batch in batches:
            for part in common.slices(batch):
                ids, own = part.column("doc_id").to_pylist(), common.texts(part)
                if head is None:
                    head = own[0]
                else:
                    ids, own = [last[0], *ids], [last[1], *own]
                last = ids[-1], own[-1]
                if len(own) > 1:
                    columns = _compared(ids[:-1], own[:-1], own[1:])
                    none = pa.nulls(len(ids) - 1, pa.string())
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ids) - 1, pa.int32()), none, none], names=names)
        if head is not None:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), *empty, pa.array([place], pa.int32()), pa.array([head]), pa.array([last[1]])], names=names)

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                own, following = batch.column("_tail").to_pylist(), batch.column("_next").to_pylist()
                found = [_compared([i], [a], [b]) for i, a, b in zip(batch.column("doc_id").to_pylist(), own, following, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*found, strict=True)], names=["doc_id", *_ROW])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), "text")
    found = common.stored(ordered.mapInArrow(run, _SCHEMA + ", _place int, _head string, _tail string"), "next-documents")
    ends = found.filter("_place is not null").select("doc_id", "_place", "_head", "_tail")
    # one row a partition
    places = [r[0] for r in ends.select("_place").orderBy("_place").collect()]
    links = docs.sparkSession.createDataFrame([(p, places[(i + 1) % len(places)]) for i, p in enumerate(places)], "_place int, _follows int")
    heads = ends.select(F.col("_place").alias("_follows"), F.col("_head").alias("_next"))
    closed = ends.drop("_head").join(links, "_place").join(heads, "_follows").select("doc_id", "_tail", "_next").mapInArrow(close, _SCHEMA)
    return found.filter("_place is null").select("doc_id", *_ROW).unionByName(closed)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    return with_next(common.table(spark, sf_dir, "documents"))
