"""Toxicity by a linear-chain conditional random field over words.

Labels are given for documents only, so words get theirs first: a feature (the word, its beginnings and ends) is marked when documents that have it are toxic far more often than chance allows, and in toxic documents the words with a marked feature are labelled. The field has two labels, weights for features and for label pairs, and is trained by gradient steps on all words of clean documents and on the stretches of toxic ones that are around labelled words (whether words far from these are toxic is not known). Sequences are cut every STRETCH words, without leaving any out. Forward and backward passes give each word's probability of being toxic; runs of words above one half are the offending spans, and the sum of squared probabilities, through a logistic curve fitted on the training documents, is the document's score.

Training uses at most MAX_TOXIC toxic and MAX_CLEAN clean labelled documents and MAX_BYTES of their texts, those with the least hashes of their ids; nothing else is bounded. Scores come from texts alone.

Cases: null ids: scored like others, never trained on. Null or empty text: scored like a text without any toxic word. Documents without labels are scored, not trained on; labels without a document are ignored; null labels are ignored. No labelled document, only one class, or no word that tells them apart: every score is 0. Very long texts are scored whole. Repeated rows are scored each; of rows with one id, the least text is trained on. Empty table: empty result. Other columns are passed through by score(), whatever their names; only columns score and spans are replaced.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .minhash import sets, sketches

MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1000, 2500, 64 << 20
THRESHOLD = 0.3
#: Words on each side of a labelled one in a toxic document's training stretch, and the most of a stretch.
AROUND, STRETCH = 8, 64
STEPS = 60
#: Evidence that says as little as none: below it the curve is flat.
LITTLE = 0.3
KEPT_WORDS = 400_000
#: Texts that are sketched or scored together while learning, and places of training sequences that are worked on together.
TOGETHER, PLACES = 500, 100_000
_WORD = re.compile(f"[^{re.escape(common.SPACE)}]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """The features of a word: itself without case and punctuation at its ends, its beginnings and its ends."""
    w = _EDGE.sub("", word.lower())
    n = len(w)
    return [w + "."] + [w[:k] + "-" for k in (3, 4, 5, 6) if k < n] + ["-" + w[-k:] for k in (3, 4, 5) if k < n]


@dataclass
class Model:
    """weights: of features, for toxic against not; pair: log weights of label pairs [before, after]; curve: logistic coefficients, None if there was nothing to learn from."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] | None = None

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "bias": self.bias, "pair": self.pair.tolist(), "curve": self.curve})

    @staticmethod
    def from_json(text: str) -> Model:
        m = json.loads(text)
        return Model(m["weights"], m["bias"], np.array(m["pair"]), m["curve"] and tuple(m["curve"]))

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word.decode()))

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log(LITTLE + evidence), -30, 30)))


class Emissions(dict):
    """Words to their emissions, made when they are asked for."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: bytes) -> float:
        self[word] = x = self.model.emission(word)
        return x


def laid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences laid end to end: where each place stands if all first places come first, then all second ones, longer sequences before shorter ones; and where each of these steps begins, and the last ends."""
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.concatenate([[0], np.cumsum(np.bincount(step))]).astype(np.int64)
    return begin[step] + np.repeat(rank, counts), begin


def ratios(emissions: np.ndarray, layout: tuple[np.ndarray, np.ndarray], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios of label 1 to label 0 at each place of sequences laid end to end, for all sequences together; the forward one has the place's own emission in it."""
    at, begin = layout
    m = np.exp(pair)
    e = np.empty(len(at))
    e[at] = np.exp(np.clip(emissions, -30, 30))
    ahead, behind, begin = e.copy(), np.ones(len(at)), begin.tolist()
    for a, b, c in zip(begin, begin[1:], begin[2:], strict=False):
        r = ahead[a : a + c - b]
        ahead[b:c] *= (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
    for a, b, c in reversed(list(zip(begin, begin[1:], begin[2:], strict=False))):
        x = e[b:c] * behind[b:c]
        behind[a : a + c - b] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    return ahead[at], behind[at]


def marginals(emissions: np.ndarray, counts: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The probability of label 1 at each place."""
    ahead, behind = ratios(emissions, laid(counts), pair)
    both = ahead * behind
    return both / (1 + both)


def _distinct(texts: list[str]) -> list[int]:
    """Places of texts that aren't copies or near copies of an earlier one: under half of the coordinates of their sketches have come before. Copies would make any word of theirs look frequent."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, row in enumerate(row for k in range(0, len(texts), TOGETHER) for row in sketches(*sets(texts[k : k + TOGETHER], 3), 8).tolist()):
        known = sum((j, x) in seen for j, x in enumerate(row))
        seen.update(enumerate(row))
        if known < 4:
            out.append(i)
    return out


def _numbered(split: Iterable[Sequence[str]]) -> tuple[list[np.ndarray], list[str]]:
    """The words of each text as numbers, in the order in which words are first met, and the words."""
    number: dict[str, int] = {}
    word = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)) for words in split]
    return word, list(number)


def _featured(names: Iterable[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The features of words as numbers, word after word; where each word's begin, and the last word's end; and the features."""
    number: dict[str, int] = {}
    ends = [0]

    def each():
        for w in names:
            found = features(w)
            ends.append(ends[-1] + len(found))
            yield from (number.setdefault(f, len(number)) for f in found)

    flat = np.fromiter(each(), np.int32)
    return flat, np.array(ends), list(number)


def _marked(split: Iterable[Sequence[str]], toxic: np.ndarray) -> set[str]:
    """Words with a feature that toxic documents have too often for chance, and clean ones hardly: once in a document, or twice at least.

    Features are taken from the most telling on, and each must hold for the words that no earlier one has: so the beginning of a telling word doesn't count by that word alone.
    """
    word, words = _numbered(split)
    feature, begin, names = _featured(words)
    seen = {(y, k): np.zeros(len(names), np.int64) for y in (True, False) for k in (1, 2)}
    for at, y in zip(word, toxic.tolist(), strict=True):
        at, times = np.unique(at, return_counts=True)
        size = begin[at + 1] - begin[at]
        mine, which = np.unique(feature[np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())], return_inverse=True)
        seen[y, 1][mine] += 1
        seen[y, 2][mine[np.bincount(which, np.repeat(times, size), len(mine)) > 1]] += 1
    n, m = int(toxic.sum()), int((~toxic).sum())
    base = n / (n + m)
    limit = max(np.log(1e-3 / (np.count_nonzero(seen[True, 1]) + 1)), np.log(1e-4) if n < 100 else -np.inf)

    def chance(k: int, c: int) -> float:
        """A bound for the logarithm of the chance of k toxic documents or more out of k + c; 0 if clean ones have it too."""
        if k < 3 or (k + 0.5) / (n + 1) < 12 * (c + 0.5) / (m + 1):
            return 0.0
        share = k / (k + c)
        return -(k * np.log(share / base) + (c * np.log((1 - share) / (1 - base)) if c else 0))

    some = np.flatnonzero(seen[True, 1] >= 3).tolist()
    good = {f: x for f in some if (x := min(chance(int(seen[True, k][f]), int(seen[False, k][f])) for k in (1, 2))) < limit}
    telling = np.zeros(len(names), bool)
    telling[list(good)] = True
    held = np.flatnonzero(telling[feature])
    words_of: dict[int, set[int]] = {}
    for w, f in zip((np.searchsorted(begin, held, "right") - 1).tolist(), feature[held].tolist(), strict=True):
        words_of.setdefault(f, set()).add(w)
    told = np.zeros(len(words), bool)
    told[[w for ws in words_of.values() for w in ws]] = True
    places: dict[int, list[tuple[int, int]]] = {}
    for i, at in enumerate(word):
        for w, times in zip(*(x.tolist() for x in np.unique(at[told[at]], return_counts=True)), strict=True):
            places.setdefault(w, []).append((i, times))
    marked: set[int] = set()
    for f in sorted(good, key=lambda f: (good[f], -len(names[f]), names[f])):
        rest, docs = words_of[f] - marked, Counter()
        for w in rest:
            for i, times in places[w]:
                docs[i] += times
        for least in (1, 2):
            held = [i for i, times in docs.items() if times >= least]
            k = sum(bool(toxic[i]) for i in held)
            if chance(k, len(held) - k) < limit:
                marked |= rest
                break
    return {words[w] for w in marked}


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The field and the curve from labelled texts."""
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        return Model()
    apart = _distinct(texts)
    if not y[apart].any() or y[apart].all():
        apart = list(range(len(texts)))
    texts, y = [texts[i] for i in apart], y[apart]
    # split anew for each use: all words as strings take seven times the texts' memory
    marked = _marked(map(_WORD.findall, texts), y)
    if not marked:
        return Model()
    model = _trained(map(_WORD.findall, texts), y, marked)
    emit = Emissions(model)
    evidence = np.concatenate([_evidence([t.encode().split() for t in texts[k : k + TOGETHER]], emit, model)[0] for k in range(0, len(texts), TOGETHER)])
    return _curved(model, np.log(LITTLE + evidence), y)


def _sequences(split: Iterable[Sequence[str]], toxic: np.ndarray, marked: set[str]):
    """Training sequences laid end to end: the word of each place as a number, the words, whether the place is labelled, and the sequences' lengths."""
    word, names = _numbered(split)
    hit = np.fromiter((w in marked for w in names), bool, len(names))
    places, labels, lengths = [np.empty(0, np.int32)], [np.empty(0, bool)], [0]
    for at, t in zip(word, toxic.tolist(), strict=True):
        near = np.ones(len(at), bool)
        if t:
            step = np.zeros(len(at) + 1, np.int64)
            mine = np.flatnonzero(hit[at])
            np.add.at(step, np.maximum(mine - AROUND, 0), 1)
            np.add.at(step, np.minimum(mine + AROUND + 1, len(at)), -1)
            near = np.cumsum(step[:-1]) > 0
        kept = np.flatnonzero(near)
        places.append(at[kept]), labels.append(hit[at[kept]] & t)
        cut = np.append(np.flatnonzero(np.diff(kept) > 1) + 1, len(kept))
        for n in np.diff(cut, prepend=0).tolist():
            lengths += [STRETCH] * (n // STRETCH) + [n % STRETCH] * (n % STRETCH > 0)
    return np.concatenate(places), names, np.concatenate(labels), np.array(lengths, np.int64)


def _parts(counts: np.ndarray):
    """Sequences laid end to end in parts of about PLACES places: for each part its places, their layout, and those with one before them."""
    ends = np.cumsum(counts)
    cuts = np.append(np.flatnonzero(np.diff(ends // PLACES, prepend=-1)), len(counts))
    for a, b in itertools.pairwise(cuts.tolist()):
        mine = counts[a:b]
        start, stop = int(ends[a] - counts[a]), int(ends[b - 1])
        first = np.zeros(stop - start + 1, bool)
        first[np.cumsum(mine) - mine] = True
        at, begin = laid(mine)
        yield slice(start, stop), (at.astype(np.int32), begin), np.flatnonzero(~first[:-1]).astype(np.int32)


def _trained(split: Iterable[Sequence[str]], toxic: np.ndarray, marked: set[str]) -> Model:
    word, names, label, counts = _sequences(split, toxic, marked)
    often = np.bincount(word, minlength=len(names))
    held = np.flatnonzero(often)
    feature, begin, known = _featured(names[i] for i in held.tolist())
    rows = np.repeat(held, np.diff(begin))
    kept = np.bincount(feature, often[rows], len(known)) >= 3  # places that have a feature
    rows, columns = rows[kept[feature]], (np.cumsum(kept) - 1)[feature[kept[feature]]]
    number = {f: i for i, f in enumerate(itertools.compress(known, kept.tolist()))}
    words = len(names)
    del feature, begin, known, names
    parts, pair = list(_parts(counts)), np.array([[0.5, 0.0], [0.0, 0.5]])
    flat = np.concatenate([np.zeros(len(number)), [-4.0], pair.ravel()])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    seen_pairs = np.zeros((2, 2))
    for place, _, prior in parts:
        mine = label[place].astype(int)
        np.add.at(seen_pairs, (mine[prior - 1], mine[prior]), 1)
    wrong_at = np.empty(len(label))
    scale = max(1.0, label.sum())
    for step in range(1, STEPS + 1):
        weights, bias, pair = flat[: len(number)], flat[len(number)], flat[len(number) + 1 :].reshape(2, 2)
        emissions, edges = bias + np.bincount(rows, weights[columns], words), np.zeros((2, 2))
        for place, layout, prior in parts:
            p, mine = _expected(emissions[word[place]], layout, pair, prior)
            wrong_at[place] = label[place] - p
            edges += mine
        wrong = np.bincount(word, wrong_at, words)  # summed by word, then by feature
        gradient = np.concatenate([np.bincount(columns, wrong[rows], len(number)) - 0.05 * weights, [wrong.sum()], (seen_pairs - edges - 0.05 * pair).ravel()]) / scale
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        flat = flat + 0.25 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
    weights = flat[: len(number)]
    kept = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 0.05}
    return Model(kept, float(flat[len(number)]), flat[len(number) + 1 :].reshape(2, 2).copy())


def _expected(emissions, layout, pair, prior):
    """Marginals, and the expected number of each label pair."""
    ahead, behind = ratios(emissions, layout, pair)
    m = np.exp(pair)
    a, x = ahead[prior - 1], np.exp(np.clip(emissions[prior], -30, 30)) * behind[prior]
    joint = np.stack([np.full(len(prior), m[0, 0]), m[0, 1] * x, a * m[1, 0], a * m[1, 1] * x], 1)
    joint /= joint.sum(1, keepdims=True)
    return ahead * behind / (1 + ahead * behind), joint.sum(0).reshape(2, 2)


def _curved(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """model with the logistic curve of y over x, by Newton's steps with a small penalty."""
    w, design = np.zeros(2), np.stack([np.ones(len(x)), x], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-3, 1e-1])
        step = np.linalg.solve(hessian, design.T @ (y - p) - np.array([1e-3, 1e-1]) * w)
        w = w + np.clip(step, -2, 2)
    return Model(model.weights, model.bias, model.pair, (float(w[0]), float(w[1])))


def _evidence(words: list[list[bytes]], emit: Emissions, model: Model):
    """The sum of squared probabilities of each text, the probabilities, and the number of words."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((x for w in words for x in map(emit.__getitem__, w)), float, int(counts.sum()))
    p = marginals(flat, counts, model.pair)
    total = np.concatenate([[0], np.cumsum(p * p)])
    ends = np.cumsum(counts)
    return np.maximum(total[ends] - total[ends - counts], 0), p, counts


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> DataFrame:
    """(doc_id, text, _toxic) to train on: of labelled documents that aren't held out, those with the least hashes, up to a bound for each class."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    rows = rows.groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
    pick = lambda y, n: rows.filter(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, max_toxic).unionByName(pick(0, max_clean))
    # at most max_toxic + max_clean ids
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("_toxic"))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of words with a probability of one half or more, as character offsets."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1]["stop"], out[-1]["p"] = m.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": m.start(), "stop": m.end(), "p": float(p[i])})
            last = i
    return out


def scored(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """For each row of docs itself as the struct _row, with score, and spans: array<struct<start, stop, p>>."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        emit = Emissions(model)
        for batch in batches:
            rows = batch.column("_row")
            whole = pa.RecordBatch.from_arrays([rows, rows.field("text")], names=["_row", "text"])
            for part in common.slices(whole):
                if len(emit) > KEPT_WORDS:
                    emit.clear()
                found = common.texts(part)
                evidence, p, counts = _evidence([t.encode().split() for t in found], emit, model)
                columns, names = [part.column("_row"), pa.array(model.scores(evidence))], ["_row", "score"]
                if with_spans:
                    ends = np.cumsum(counts)
                    some = np.maximum.reduceat(np.append(p, 0), np.minimum(ends - counts, len(p))) >= 0.5 if len(counts) else []
                    columns.append(pa.array([spans(t, p[b - n : b]) if s and n else [] for t, b, n, s in zip(found, ends, counts, some, strict=True)], kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = T._parse_datatype_string("score double" + ", spans array<struct<start:int,stop:int,p:double>>" * with_spans)
    rows = docs.select(F.struct("*").alias("_row"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *extra.fields]))


def score(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """docs with score, and spans: array<struct<start, stop, p>>."""
    made = scored(docs, model, with_spans)
    return made.select(*(common.of("_row", c) for c in docs.columns if c not in made.columns), *made.columns[1:])


def trained(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """The model of a sample's documents, which one task learns; the driver gets its weights."""

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for i, t, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_toxic")), strict=True):
                size += len(t.encode())
                if size <= MAX_BYTES or not rows:
                    rows.append((i, t, y))
        rows.sort()
        yield pa.RecordBatch.from_arrays([pa.array([fit([r[1] for r in rows], [r[2] for r in rows]).to_json()])], names=["model"])

    sample = training_sample(docs, labels, max_toxic, max_clean)
    learned = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(run, "model string").first()
    return Model.from_json(learned[0]) if learned else Model()


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score and prediction, and the offending spans."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = trained(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
