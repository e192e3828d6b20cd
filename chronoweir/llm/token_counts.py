"""Token counts by a piece vocabulary, with a short cut for words that are one token.

The vocabulary merges characters by score, with bytes for characters it lacks. A space is written as U+2581 and one is put before the text. Which words can be cut apart, and which encode alone as one token, is proved from the vocabulary when it is loaded: no piece holds U+2581 after another character or a line feed beside one, so merges never cross the start of a run of spaces or a line feed; and every vocabulary string of that shape is merged once, and those that end as one token cost one from then on. Only other words are merged (merging.py, all new words of some documents together), and their costs kept in a table of bounded size.

Cases: null ids: rows like others. Null text: empty, 0 bytes, 0 tokens. Strings of control tokens inside a text are ordinary text, as in the library. Texts of any length are counted whole; long words use a heap. Repeated rows: each is counted. Empty table: empty result. Other columns are ignored by the query.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, merging

LIMIT = 4096
KEPT_WORDS = 400_000
GAP = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(number, value) of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return value, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Pieces:
    """score: pieces to scores; whole: words that are one token, a proved part of the pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.score: dict[str, float] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.score[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                elif kind in (USER, UNUSED):
                    raise ValueError("vocabularies with user-defined or unused pieces aren't supported")
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("only merges with bytes for unknown characters are supported")
            elif number == 3:
                normal = dict(_fields(value))
                if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1):
                    raise ValueError("only the identity with a space before the text is supported")
        inner = re.compile(f"[^{GAP}]{GAP}|.\n|\n.", re.S)
        if any(inner.search(p) for p in self.score):
            raise ValueError("a piece crosses the start of a word")
        self.words = re.compile(f"{GAP}+[^{GAP}\n]*|[^{GAP}\n]+|\n")
        shape = [p for p in self.score if self.words.fullmatch(p)]
        self.whole = frozenset(p for p in shape if self.merged(p) == [p])
        self._cost = _Costs(self)
        self._tables()

    def _tables(self) -> None:
        """Symbols for merging.py: pieces by number, then characters that are in pieces without being one; other characters are -2 and never merge."""
        number = {p: i for i, p in enumerate(self.score)}
        for c in sorted({c for p in self.score for c in p} - self.score.keys()):
            number[c] = len(number)
        levels = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        rows = [(number[p[:k]], number[p[k:]], levels[s], number[p]) for p, s in self.score.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self._pairs = merging.Pairs(*zip(*rows, strict=True))
        self._chars = np.full(0x110000, -2, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self._chars[ord(c)] = i
        self._costs = np.array([1 if p in self.score else len(p.encode()) for p in number], np.int32)

    def learn(self, fresh: list[str]) -> None:
        """Merges all short words of a list together and keeps their costs."""
        fresh = [w for w in fresh if len(w) <= merging.WIDTHS[-1]]
        points = np.frombuffer("".join(fresh).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        # a character that is no piece costs its bytes
        bytes_ = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
        symbols = self._chars[points]
        unknown = np.nonzero(symbols == -2)[0]
        extra = np.bincount(np.searchsorted(np.cumsum(lengths), unknown, "right"), bytes_[unknown], len(fresh)).astype(np.int64)

        def done(numbers, ids, counts):
            each = np.where(ids < 0, 0, self._costs[np.maximum(ids, 0)])
            n = np.add.reduceat(each, np.concatenate([[0], np.cumsum(counts)[:-1]])) + extra[numbers]
            self._cost.update(zip([fresh[i] for i in numbers.tolist()], n.tolist(), strict=True))

        merging.merge(symbols, lengths, self._pairs, done)

    def merged(self, word: str) -> list[str]:
        """The parts of a word after all merges: the best score first, the leftmost of equals."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.score
        heap = [(-s, i, i + 2) for i in range(n - 1) if (s := score.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (s := score.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (-s, i, end[stop]))
            if (j := before[i]) >= 0 and (s := score.get(word[j:stop])) is not None:
                heapq.heappush(heap, (-s, j, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if len(self._cost) > KEPT_WORDS + len(self.whole):
            self._cost.restart()
        split = [self.words.findall(GAP + t.replace(" ", GAP)) if t else [] for t in texts]
        fresh: set[str] = set()
        for found in split:
            fresh.update(found)
        self.learn([w for w in fresh if w not in self._cost])
        return [sum(map(self._cost.__getitem__, found)) for found in split]


class _Costs(dict):
    """Words to their number of tokens."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.pieces.whole, 1))

    def __missing__(self, word: str) -> int:
        known = self.pieces.score
        self[word] = n = sum(1 if p in known else len(p.encode()) for p in self.pieces.merged(word))
        return n


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary at a path, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of docs (doc_id, text)."""

    def run(batches):
        p = pieces(path)
        for batch in batches:
            for part in common.slices(batch):
                found = common.texts(part)
                n = p.count(found)
                columns = [part.column("doc_id"), pa.array([len(t.encode()) for t in found], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens, and whether it has over 4096 tokens."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
