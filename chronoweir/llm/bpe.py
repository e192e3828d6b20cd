"""Byte-level BPE: encoding and decoding, one rank array a word.

A text is split into words by the vocabulary's pattern. A short word is an array of part boundaries, and beside it the rank of each part's merge with its right neighbour; the least rank (leftmost of equals) is sought by a scan, its boundary deleted, and the ranks at both sides are made anew (merging.py, for all new words of some documents together). Words above SHORT bytes use a heap over a linked list instead, with the same result, since the scan takes quadratic time. Ids of words are kept in a table of bounded size, so a word that comes again costs one look-up.

Cases: null ids: rows like others. Null text: empty, no ids. Special tokens of the vocabulary file inside a text are that token, as the tokenizers library has it by default. White space, long runs without white space and texts of any length are encoded whole. Repeated rows: each is encoded. Empty table: empty result. Other columns are ignored by the query.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common, merging

#: Bytes up to which a word is merged by scanning.
SHORT = 96
#: Words whose ids are kept.
KEPT_WORDS = 400_000
#: Code points which newer versions of Unicode than the vocabulary's library count as letters or digits.
NEWER = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f 11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
_NEWER = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\\s+(?!\\S)|\\s+"
COMMON = regex.compile(_SPLIT.format(L=r"\p{L}", N=r"\p{N}", O=r"[^\s\p{L}\p{N}]"))
EXACT = regex.compile("(?V1)" + _SPLIT.format(L=rf"[\p{{L}}--[{_NEWER}]]", N=rf"[\p{{N}}--[{_NEWER}]]", O=rf"[[^\s\p{{L}}\p{{N}}]||[{_NEWER}]]"))


#: The same for texts without characters from U+0240 on.
_GAP = "\\t-\\r \\x85\\xa0"
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u023f", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_GAP}{_L}{_N}]+|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]+")


def words(text: str) -> list[str]:
    """text split as the vocabulary's library does, without special tokens."""
    top = int(np.frombuffer(text.encode(), np.uint8).max(initial=0))  # the greatest first byte of a character
    return (LATIN if top <= 0xC8 else COMMON if top <= 0xD4 else EXACT).findall(text)


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """ids: token bytes to ids; ranks: bytes of a merged pair to the merge's place; tokens: ids to bytes; special: text of special tokens to ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        chars = _byte_chars()
        raw = lambda s: bytes(map(chars.__getitem__, s))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {raw(s): i for s, i in file["model"]["vocab"].items() if s not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in merges]
        self.ranks = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self._pairs = merging.Pairs([self.ids[a] for a, _ in merges], [self.ids[b] for _, b in merges], range(len(merges)), [self.ids[a + b] for a, b in merges])
        self._bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {i: s for s, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._packed = _Packed(self)

    def parts(self, word: bytes) -> list[bytes]:
        """The tokens of a word."""
        if word in self.ids and len(word) == 1:
            return [word]
        return merged_by_scan(word, self.ranks) if len(word) <= SHORT else merged_by_heap(word, self.ranks)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        packed = self._packed
        if len(packed) > KEPT_WORDS:
            packed.clear()
        split = [[words(x) if i % 2 == 0 else x for i, x in enumerate(self._split.split(t) if self._split else [t])] for t in texts]
        fresh: set[str] = set()
        for pieces in split:
            for piece in pieces[::2]:
                fresh.update(piece)
        self._learn([w for w in fresh if w not in packed])
        special = {s: struct.pack("<I", i) for s, i in self.special.items()}
        return [b"".join(b"".join(map(packed.__getitem__, x)) if i % 2 == 0 else special[x] for i, x in enumerate(pieces)) for pieces in split]

    def _learn(self, fresh: list[str]) -> None:
        """Merges all short words of a list together and keeps their ids; long ones are merged when they are asked for."""
        raw = [w.encode() for w in fresh]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        places = np.nonzero((lengths > 0) & (lengths <= SHORT))[0]
        symbols = self._bytes[np.frombuffer(b"".join([raw[i] for i in places.tolist()]), np.uint8)]
        packed = self._packed

        def done(numbers, ids, counts):
            flat, at = ids.astype("<u4").tobytes(), 0
            for i, n in zip(places[numbers].tolist(), (counts * 4).tolist(), strict=True):
                packed[fresh[i]] = flat[at : at + n]
                at += n

        merging.merge(symbols, lengths[places], self._pairs, done)

    def encode(self, text: str) -> list[int]:
        (p,) = self.packed([text])
        return list(struct.unpack(f"<{len(p) // 4}I", p))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


class _Packed(dict):
    """Words to their ids as bytes, made when they are asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        v = self.vocabulary
        ids = [v.ids[p] for p in v.parts(word.encode())]
        out = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return out


_NONE = 1 << 60


def merged_by_scan(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merges by boundaries and adjacent ranks: bounds[i] starts part i, adjacent[i] is the rank of parts i and i + 1 merged."""
    bounds = list(range(len(word) + 1))
    get = ranks.get
    adjacent = [get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while adjacent:
        least = min(adjacent)
        if least == _NONE:
            break
        i = adjacent.index(least)
        del bounds[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            adjacent[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges for long words: candidates in a heap by rank and place, parts in a linked list."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at a place; 0 where none starts
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop or middle >= stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := ranks.get(word[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary file at a path, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the column ids, array<int>; a column of that name is replaced."""
    docs = docs.drop(ids)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in common.slices(batch, text):
                found = pa.array([v.encode(t) for t in common.texts(part, text)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; a column of that name is replaced."""
    rows = rows.drop(text)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            found = pa.array([v.decode(x or ()) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs (doc_id, text); ids and decoded texts don't leave the workers."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for part in common.slices(batch):
                n, a, b = [], [], []
                for p in v.packed(common.texts(part)):
                    n.append(len(p) // 4)
                    a.append(hashlib.sha256(p).hexdigest())
                    b.append(hashlib.sha256(v.decode(struct.unpack(f"<{n[-1]}I", p)).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its ids and of their decoding."""
    return digests(common.table(spark, sf_dir, "documents"), default_path())
