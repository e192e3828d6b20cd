"""Removal of every byte inside a string of LENGTH bytes that also starts anywhere else.

Whether a window of LENGTH bytes repeats is decided by a column-wise built transform of real bytes (bwt.py), never by a hash. Hashes only bring what may be equal into one collection, and leave out what can't be: windows whose hash no other has.

Every window has an anchor, the place of the least hash among its GRAM-byte strings (the leftmost of equals), so equal windows have equal anchors at equal offsets. The windows of one anchor are neighbours: a run, about one for every 85 bytes.

1. Runs whose anchor's gram occurs once can't repeat. The others are judged by gram and content (a hash of the run's bytes).
2. Runs of a content that comes twice or more are copies, it seems: each is to be compared with a witness, another run of that content. Witnesses are chosen in parts of a content, as many as the root of the number of rows, so that no witness has too many runs. In a text the runs whose witnesses follow each other in one text are one stretch, cut where the witness passes a multiple of SPAN, so a copied text goes out about one and a half times.
3. Contents of a gram that has several: windows at the edge of repeated passages. One run of each content goes to the gram's collection, unless there are more than KINDS of them. Then runs are cut into groups of GROUPS[0] neighbouring windows by their offset from the anchor, which are judged by their core (the bytes that all have) and content as runs are, then into smaller groups, and last into windows, whose content is their core: so a passage in a third of all texts has collections of bounded size too.
4. Collections are decided in their tasks, which read them one after the other from Spark's sorted shuffle, some at a time as one transform of at most SYMBOLS places. Strings of the same bytes (compared, not hashed) stand as one in it, with all their places. Where a witness has more strings than that, it goes with each part of them.

The method's external files: a transform that is bounded by SYMBOLS takes under 2 MB, so it stays in memory, and the files that tasks read in sequence are the shuffle's. One transform of all texts would take a round over all that is built so far for each symbol of the longest text; equal windows have equal anchors, so transforms by anchor find the same.

Texts are shuffled once, to a table bucketed by a number given to each row, which all later steps join without another shuffle.

Cases: null or empty text: nothing to remove, the digest of the empty string. Texts under LENGTH bytes are kept whole. Windows that overlap themselves (runs of one letter) count. Repeated rows, ids that come again and null ids: each row is a document, so all lose what they share. Very long texts: cut into pieces that overlap by LENGTH - 1 bytes. Empty table: empty result. Extra columns, whatever their names, are not read; removed() gives doc_id and its own columns.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt, common
from .words import mixed

LENGTH, GRAM, GROUPS = 200, 32, (57, 8, 1)
#: Windows of a stretch that are compared with a witness, and contents of a core in one collection.
SPAN, KINDS = 400, 128
#: Places of a transform; those of KINDS runs are fewer.
SYMBOLS = 60_000
#: Bytes that are looked at together; places in them fit PLACE_BITS.
PIECE, PLACE_BITS = 2 << 20, 26
_TOP = np.uint64(2**64 - 1)


class Hashes:
    """Hashes of all substrings of 8 bytes or more of a buffer: sums up to each place of mixed eights of bytes, times powers of an odd number. They bring equals together and decide nothing."""

    BASE = 0x5851F42D4C957F2D
    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, data: np.ndarray):
        if len(self._powers[0]) <= len(data):
            with np.errstate(over="ignore"):
                Hashes._powers = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(data), b, np.uint64), dtype=np.uint64)]) for b in (self.BASE, pow(self.BASE, -1, 1 << 64))]
        up, self.down = Hashes._powers
        eights = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else np.empty((0, 8), np.uint8)
        value = mixed(np.ascontiguousarray(eights).view(np.uint64).ravel())
        with np.errstate(over="ignore"):
            value *= up[: len(value)]
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray, seed=0) -> np.ndarray:
        with np.errstate(over="ignore"):
            size = (np.asarray(stop) - np.asarray(start)).astype(np.uint64)
            return mixed((self.total[stop - 7] - self.total[start]) * self.down[start] + size + np.asarray(seed, np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    padded = np.full(-(-len(a) // width) * width, _TOP)
    padded[: len(a)] = a
    blocks = padded.reshape(-1, width)
    ahead, behind = np.minimum.accumulate(blocks, 1).ravel(), np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    k = len(a) - width + 1
    return np.minimum(behind[:k], ahead[width - 1 : width - 1 + k])


def runs(texts: list[bytes]):
    """For the windows of some texts: the text's number, the hashes of the anchor's gram and of the run's content, and the place: first window << 16 | windows << 8 | anchor's offset in the first window."""
    span = LENGTH - GRAM + 1
    parts: list[tuple[int, int, bytes]] = []  # number, place in the text, bytes
    for i, t in enumerate(texts):
        parts += [(i, at, t[at : at + PIECE]) for at in range(0, max(0, len(t) - LENGTH + 1), PIECE - LENGTH + 1) if len(t) - at >= LENGTH]
    lengths = np.array([len(p) for *_, p in parts], np.int64)
    if not len(lengths):
        return (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2, np.empty(0, np.int64))
    data = np.frombuffer(b"".join(p for *_, p in parts), np.uint8)
    starts = np.cumsum(lengths) - lengths
    h = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = _sliding_min((h.of(at, at + GRAM) & ~low) | at.astype(np.uint64), span)
    p = np.arange(len(least))
    part = np.repeat(np.arange(len(parts)), lengths)[: len(p)]
    inside = p + LENGTH <= (starts + lengths)[part]
    p, part, anchor = p[inside], part[inside], (least[inside] & low).astype(np.int64)
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
    first = np.nonzero(fresh)[0]
    last = np.append(first[1:], len(p)) - 1
    s0, s1, anchor, part = p[first], p[last], anchor[first], part[first]
    number, place = np.array([i for i, *_ in parts], np.int64)[part], np.array([a for _, a, _ in parts], np.int64)[part]
    where = ((s0 - starts[part] + place) << 16) | ((s1 - s0 + 1) << 8) | (anchor - s0)
    return number, h.of(anchor, anchor + GRAM), h.of(s0, s1 + LENGTH, anchor - s0 + 1), where


def groups(texts: list[bytes], number: np.ndarray, where: np.ndarray, size: int):
    """The runs or groups at places `where` of texts `number`, cut into groups of up to `size` windows by their offset from the anchor or core: text's number, hashes of the core and of all bytes, and the place with the core's offset."""
    base = np.cumsum([0, *map(len, texts)])[number]
    h = Hashes(np.frombuffer(b"".join(texts), np.uint8))
    s0, n, off = where >> 16, (where >> 8) & 0xFF, where & 0xFF
    least = off - n + 1
    count = off // size - least // size + 1
    row = np.repeat(np.arange(len(where)), count)
    g = least[row] // size + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    anchor = (s0 + off)[row]
    first, core = anchor - np.minimum(off[row], size * g + size - 1), anchor - size * g
    n = anchor - np.maximum(least[row], size * g) - first + 1
    at = base[row]
    return number[row], h.of(at + core, at + core + LENGTH - size + 1, g + 1), h.of(at + first, at + first + n - 1 + LENGTH, core - first + 1), (first << 16) | (n << 8) | (core - first)


def stretches(number: np.ndarray, place: np.ndarray, witness: np.ndarray, at: np.ndarray):
    """Runs of texts `number` at places, whose witnesses are at `at` in the texts `witness`, as stretches: number, first window, windows, witness, how much further they are in it, and which SPAN of it they are in."""
    first, n, shift = place >> 16, (place >> 8) & 0xFF, at - (place >> 16)
    count = (at + n - 1) // SPAN - at // SPAN + 1
    row = np.repeat(np.arange(len(first)), count)
    block = at[row] // SPAN + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.maximum(first[row], block * SPAN - shift[row])
    hi = np.minimum((first + n)[row], block * SPAN + SPAN - shift[row])
    number, witness, shift = number[row], witness[row], shift[row]
    order = np.lexsort((lo, block, shift, witness, number))
    number, witness, shift, block, lo, hi = (x[order] for x in (number, witness, shift, block, lo, hi))
    fresh = np.ones(len(lo), bool)
    for x in (number, witness, shift, block):
        fresh[1:] &= x[1:] == x[:-1]
    fresh[1:] = ~(fresh[1:] & (lo[1:] == hi[:-1]))
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(lo))[: len(start)] - 1
    return number[start], lo[start], hi[stop] - lo[start], witness[start], shift[start], block[start]


def _numbers(part: pa.RecordBatch, column: str):
    """Of a column of lists of structs: the row of each struct, and arrays of the fields; null is -1."""
    lists = part.column(column)
    values = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    return row, [values.field(i).fill_null(-1).to_numpy() for i in range(values.type.num_fields)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows_of(part: pa.RecordBatch, row: np.ndarray) -> pa.Array:
    return part.column("r").take(pa.array(row))


def all_runs(texts: DataFrame) -> DataFrame:
    """(r, key, content, place) of all runs of texts (r, text)."""

    def go(batches):
        for batch in batches:
            for part in common.slices(batch, limit=PIECE):
                row, gram, content, where = runs([t.encode() for t in common.texts(part)])
                yield pa.RecordBatch.from_arrays([_rows_of(part, row), _signed(gram), _signed(content), pa.array(where)], names=["r", "key", "content", "place"])

    return texts.select("r", "text").mapInArrow(go, "r long, key long, content long, place long")


def _listed(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(r, text, _places) of the texts that places (r and more) have: the other columns of places, as lists of structs."""
    lists = places.groupBy("r").agg(F.collect_list(F.struct(*(c for c in places.columns if c != "r"))).alias("_places"))
    return texts.select("r", "text").join(lists.hint("merge"), "r")


def smaller(texts: DataFrame, places: DataFrame, size: int) -> DataFrame:
    """groups() as rows, like those of all_runs(), for places (r, place)."""

    def go(batches):
        for batch in batches:
            for part in common.slices(batch, limit=PIECE):
                row, (where,) = _numbers(part, "_places")
                row, core, content, where = groups([t.encode() for t in common.texts(part)], row, where, size)
                yield pa.RecordBatch.from_arrays([_rows_of(part, row), _signed(core), _signed(content), pa.array(where)], names=["r", "key", "content", "place"])

    return _listed(texts, places).mapInArrow(go, "r long, key long, content long, place long")


def judged(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (r, key, content, place): those with a content that comes again, with their witness (r, place, witness, at); and one row of each content of keys with several contents (r, place, key, kinds)."""
    counts = rows.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key")
    # tables, so that the shuffles of rows with a hot key can be split
    some = common.stored(rows.join(common.stored(counts, f"{name}-keys").hint("merge"), "key", "left_semi"), f"{name}-rows")
    part = F.pmod(F.xxhash64("r"), F.lit(max(16, math.isqrt(some.count())))).alias("part")
    parts = common.stored(some.groupBy("key", "content", part).agg(F.count("*").alias("n"), F.min(F.struct("r", "place")).alias("first")), f"{name}-parts")
    contents = common.stored(parts.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min("first").alias("least"), F.max("first").alias("most"), F.count_if(F.col("n") == 1).alias("alone")), f"{name}-contents")
    kinds = common.stored(contents.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), f"{name}-kinds")
    asked = contents.join(kinds.hint("merge"), "key").select("least.r", "least.place", "key", "kinds")
    # a row that is alone in its part has the least of all as its witness; if only the least is alone, it has that of another part
    witness = F.when(F.col("n") > 1, F.col("first")).when((F.col("alone") == 1) & (F.col("first") == F.col("least")), F.col("most")).otherwise(F.col("least"))
    again = parts.join(contents.filter("n > 1").drop("n").hint("merge"), ["key", "content"]).select("key", "content", "part", witness.alias("w"))
    copies = some.withColumn("part", part).join(common.stored(again, f"{name}-witnesses").hint("merge"), ["key", "content", "part"])
    return copies.select("r", "place", F.col("w.r").alias("witness"), F.shiftright("w.place", 16).alias("at")), asked


def strings(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(key, lead, bytes, r, place) for collections, place being first window << 16 | windows: of places (r, place, key, witness, at) with a key the string itself, of those with a witness their stretches. lead marks the witness's own."""

    def go(batches):
        for batch in batches:
            for part in common.slices(batch, limit=PIECE):
                row, (place, key, witness, at) = _numbers(part, "_places")
                raw = [t.encode() for t in common.texts(part)]
                own, r = witness < 0, part.column("r").to_numpy()
                copied, first, n, w, shift, block = stretches(row[~own], place[~own], witness[~own], at[~own])
                with np.errstate(over="ignore"):
                    joint = mixed(mixed(w.view(np.uint64)) + block.astype(np.uint64)).view(np.int64)
                row, key = np.concatenate([row[own], copied]), np.concatenate([key[own], joint])
                first, n = np.concatenate([place[own] >> 16, first]), np.concatenate([(place[own] >> 8) & 0xFF, n])
                lead = np.concatenate([np.zeros(own.sum(), bool), (w == r[copied]) & (shift == 0)])
                found = [raw[i][a:z] for i, a, z in zip(row.tolist(), first.tolist(), (first + n - 1 + LENGTH).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lead), pa.array(found, pa.binary()), _rows_of(part, row), pa.array((first << 16) | n)], names=["key", "lead", "bytes", "r", "place"])

    return _listed(texts, places).mapInArrow(go, "key long, lead boolean, bytes binary, r long, place long")


def _cut(key: np.ndarray, lead: np.ndarray, lengths: np.ndarray):
    """Places of rows sorted by key and lead, as transforms of at most about SYMBOLS bytes: keys whole, or a key's leads and some of its others."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    held, size, at = [], 0, 0
    for end in ends.tolist():
        mine = int(lengths[at:end].sum())
        if size + mine > SYMBOLS and held:
            yield np.arange(held[0], at)
            held, size = [], 0
        if mine <= SYMBOLS:
            held, size = held or [at], size + mine
        else:
            leads = at + np.flatnonzero(lead[at:end])
            others = np.setdiff1d(np.arange(at, end), leads)
            room = np.cumsum(lengths[others]) // max(1, SYMBOLS - int(lengths[leads].sum()))
            for k in np.unique(room):
                yield np.concatenate([leads, others[room == k]])
        at = end
    if held:
        yield np.arange(held[0], at)


def decided(found: DataFrame) -> DataFrame:
    """(r, place) of the stretches of windows that repeat among strings(); a key is in one task."""

    def decide(rows: pa.Table):
        key, lead, r, place = (rows.column(c).to_numpy() for c in ("key", "lead", "r", "place"))
        raw, first, n = rows.column("bytes").to_pylist(), place >> 16, place & 0xFFFF
        # strings of the same bytes stand as one in a transform; if they are from several places, all their windows repeat
        seen: dict[tuple[int, bytes], int] = {}
        model = np.fromiter((seen.setdefault(x, i) for i, x in enumerate(zip(key.tolist(), raw, strict=True))), np.int64, len(raw))
        many = np.zeros(len(raw), bool)
        many[model[(r != r[model]) | (first != first[model])]] = True
        one = np.flatnonzero(model == np.arange(len(raw)))
        lengths = np.fromiter((len(raw[i]) for i in one.tolist()), np.int64, len(one))
        found = [np.stack([x := one[many[one]], np.zeros(len(x), np.int64), n[x]])]
        for chosen in _cut(key[one], lead[one], lengths):
            size, chosen = lengths[chosen], one[chosen]
            data = np.frombuffer(b"".join([raw[i] for i in chosen.tolist()]), np.uint8)
            hit = bwt.repeated(data, size, np.unique(r[chosen], return_inverse=True)[1], first[chosen], LENGTH)
            windows = n[chosen]
            hit &= np.repeat(~many[chosen], windows)
            row = np.repeat(chosen, windows)[hit]
            step = (np.arange(len(hit)) - np.repeat(np.cumsum(windows) - windows, windows))[hit]
            if len(row):
                fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)]))
                found.append(np.stack([row[fresh], step[fresh], np.diff(np.append(fresh, len(row)))]))
        row, step, size = np.concatenate(found, 1)
        order = np.argsort(row, kind="stable")
        count = np.bincount(row, minlength=len(raw))
        begin, mine = np.cumsum(count) - count, count[model]
        at = np.repeat(np.arange(len(raw)), mine)
        chosen = order[np.repeat(begin[model] - (np.cumsum(mine) - mine), mine) + np.arange(len(at))]
        yield pa.RecordBatch.from_arrays([pa.array(r[at]), pa.array(((first[at] + step[chosen]) << 16) | size[chosen])], names=["r", "place"])

    def go(batches):
        held: list[pa.RecordBatch] = []
        bytes_ = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            bytes_ += batch.nbytes
            if bytes_ > 32 * SYMBOLS:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                full = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if full:
                    yield from decide(table.slice(0, full))
                    held, bytes_ = table.slice(full).combine_chunks().to_batches(), 0
        if held:
            yield from decide(pa.Table.from_batches(held))

    # a number of partitions, as time and not size is what a partition takes
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "key").sortWithinPartitions("key", F.desc("lead")).mapInArrow(go, "r long, place long")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _places): the stretches of each row's windows that repeat, null for none."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = docs.select(F.monotonically_increasing_id().alias("r"), "doc_id", "text")
    texts = common.bucketed(numbered.repartition(n, "r"), "substring_texts", "r")
    rows, places = common.stored(all_runs(texts), "runs"), None
    for size in (*GROUPS, None):
        copies, asked = judged(rows, "substrings")
        asked = common.stored(asked, "substrings-asked")
        few = asked.filter(F.col("kinds") <= KINDS).select("r", "place", "key", F.lit(-1).cast("long").alias("witness"), F.lit(-1).cast("long").alias("at"))
        both = common.stored(few.unionByName(copies.select("r", "place", F.lit(0).cast("long").alias("key"), "witness", "at")), "substrings-places")
        places = both if places is None else places.unionByName(both)
        common.discard(rows)
        hot = asked.filter(F.col("kinds") > KINDS).select("r", "place")
        if size is None or hot.isEmpty():
            break
        rows = common.stored(smaller(texts, hot, size), "groups")
    found = decided(strings(texts, places.select("r", "place", "key", "witness", "at")))
    lists = found.groupBy("r").agg(F.collect_list("place").alias("_places"))
    return texts.join(lists.hint("merge"), "r", "left").select("doc_id", "text", "_places")


def spans(place: np.ndarray) -> np.ndarray:
    """Starts and ends of the maximal removed runs of bytes, as rows of two."""
    if not len(place):
        return np.empty((0, 2), np.int64)
    place = np.sort(place)
    first = place >> 16
    stop = np.maximum.accumulate(first + (place & 0xFFFF) + LENGTH - 1)
    apart = np.nonzero(first[1:] > stop[:-1])[0]
    return np.stack([first[np.concatenate([[0], apart + 1])], stop[np.concatenate([apart, [len(stop) - 1]])]], 1)


def _left(text: bytes, cut: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in cut.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def removed(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of docs (doc_id, text); with keep also the remaining bytes and the spans as offsets."""

    def go(batches):
        for batch in batches:
            for part in common.slices(batch):
                rows = []
                for t, places in zip(common.texts(part), part.column("_places").to_pylist(), strict=True):
                    t = t.encode()
                    cut = spans(np.array(places or (), np.int64))
                    left = _left(t, cut)
                    rows.append((len(t), len(t) - len(left), len(cut), hashlib.sha256(left).hexdigest(), *((left, cut.tolist()) if keep else ())))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *_OUT[: len(columns)]])

    return repeats(docs).mapInArrow(go, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<array<long>>" * keep)


_OUT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed bytes and spans, and the digest of what is left."""
    return removed(common.table(spark, sf_dir, "documents"))


#: Texts as two hexadecimal digits a byte; windows are cut out of blocks, as cutting takes time with the length of the whole.
OP2_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), b AS (
  SELECT doc_id, n, block, substr(h, 2 * block + 1, 2398) AS part FROM (SELECT *, unnest(range(0, greatest(n - 199, 0), 1000)) AS block FROM d)
), w AS (
  SELECT doc_id, block + unnest(range(least(1000, n - 199 - block))) AS pos, unnest(list_transform(range(least(1000, n - 199 - block)), lambda k: md5_number(substr(part, 2 * k + 1, 400)))) AS s FROM b
), r AS (
  SELECT doc_id, pos FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)
), e AS (
  SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 200, true) AS fresh FROM r
), g AS (
  SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM e
), s AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 200 AS z FROM g GROUP BY doc_id, span
), k AS (
  SELECT doc_id, z AS start, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS stop FROM s
  UNION ALL SELECT d.doc_id, 0, (SELECT min(a) FROM s WHERE s.doc_id = d.doc_id) FROM d
), t AS (
  SELECT d.doc_id, unhex(string_agg(substr(h, 2 * k.start + 1, 2 * (coalesce(k.stop, n) - k.start)), '' ORDER BY k.start)) AS kept FROM d JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
), c AS (
  SELECT doc_id, sum(z - a) AS gone, count(*) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(kept) AS kept_sha256
FROM d JOIN t ON t.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
