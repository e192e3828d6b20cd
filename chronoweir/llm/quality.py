"""Quality rules with repetition found by a suffix array of words.

The words of some documents form one array of numbers, equal for equal words and only for them; suffixes are sorted by doubling, documents apart, and only those whose rank isn't single yet are sorted again. The ranks of all rounds give the longest common prefix of neighbours in the sorted order. At a word, the greater of the two common prefixes with its neighbours is the longest substring that starts there and repeats: the deepest interval of common prefixes that the suffix belongs to. Repeated substrings of at least MIN_WORDS words are united to spans; a document is dropped when they cover over MAX_COVERED of its words, or when one repeat is longer than MAX_LONGEST words.

Cases: null ids: rows like others. Null or empty text, or no words: all counts 0, base_failed (under 50 words), not kept. One word many times, and texts of any length, take a number of rounds that is the logarithm of the longest repeat. Repeated rows: each is judged by itself. Empty table: empty result. Other columns are ignored by the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .words import exact_words

MIN_WORDS = 8
MAX_COVERED = 0.4
MAX_LONGEST = 100
SYMBOLS = b"#*$%&|<>"
_WHITE = common.SPACE.encode()


def longest_repeats(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur at another place of its document too (places may overlap)."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    # ranks by (document, word): equal pairs have one rank, the place of the first of them
    by_word = np.argsort(words, kind="stable")
    order = by_word[np.argsort(doc[by_word], kind="stable")]
    rank, open_ = _ranked(order, (doc[order[1:]] == doc[order[:-1]]) & (words[order[1:]] == words[order[:-1]]), np.empty(n, np.int64), 0)
    levels, k = [rank.copy()], 1
    while len(open_):
        # open_: places in the order, in runs of equal ranks, that are not yet told apart
        suffix = order[open_]
        far = suffix + k
        second = np.where(far < end[suffix], rank[np.minimum(far, n - 1)] + 1, 0)
        first = rank[suffix]
        again = np.lexsort((second, first))
        suffix, first, second = suffix[again], first[again], second[again]
        order[open_] = suffix
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        fresh = np.concatenate([[True], ~same])
        rank = rank.copy()
        rank[suffix] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(suffix)), 0))]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        # a suffix that ends within the compared words can't tie with another, so ties shrink to nothing
        open_ = open_[tied]
        k *= 2
        levels.append(rank)
    common_ = _common_prefixes(order, levels, end)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, order[1:], common_)
    np.maximum.at(out, order[:-1], common_)
    return out


def _ranked(order, same, rank, base):
    fresh = np.concatenate([[True], ~same])
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) + base
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    return rank, np.nonzero(tied)[0]


def _common_prefixes(order, levels, end):
    """Words that neighbours in the order have in common: ranks equal at level i mean 2**i words are equal."""
    a, b = order[:-1].copy(), order[1:].copy()
    stop_a, stop_b = end[a], end[b]
    length = np.zeros(len(a), np.int64)
    live = np.arange(len(a))[levels[0][a] == levels[0][b]] if len(a) else np.empty(0, np.int64)
    for i in range(len(levels) - 1, -1, -1):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x < stop_a[live]) & (y < stop_b[live])
        x, y, at = x[inside], y[inside], live[inside]
        equal = (levels[i][x] == levels[i][y]) & (x + (1 << i) <= stop_a[at]) & (y + (1 << i) <= stop_b[at])
        length[at[equal]] += 1 << i
    return length


def covered(repeats: np.ndarray, counts: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """By document, the words inside repeated substrings of at least `least` words; with width, inside such substrings of just so many."""
    n = len(repeats)
    at = np.nonzero(repeats >= least)[0]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + (width or repeats[at]), -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    ends = np.cumsum(counts)
    return inside[ends] - inside[ends - counts]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
    return len(lines) - len(set(lines))


def measures(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts by text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of the repeats n_covered and longest."""
    raw = [t.encode() for t in texts]
    words, counts = exact_words(raw)
    repeats = longest_repeats(words, counts)
    longest = np.zeros(len(raw), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(raw)), counts), repeats)
    return {
        "n_words": counts,
        "word_chars": np.array([len(t) - len(b) + len(b.translate(None, _WHITE)) for t, b in zip(texts, raw, strict=True)], np.int64),
        "n_symbols": np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64),
        "n_dup_lines": np.array([duplicate_lines(b) for b in raw], np.int64),
        "n_repeat_words": covered(repeats, counts, 3, 3),
        "n_covered": covered(repeats, counts, MIN_WORDS),
        "longest": longest,
    }


def judge(docs: DataFrame, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id with the measures, base_failed and kept, of docs (doc_id, text)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest")

    def run(batches):
        for batch in batches:
            for part in common.slices(batch):
                m = measures(common.texts(part))
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & (m["n_covered"] <= max_covered * m["n_words"]) & (m["longest"] <= max_longest)
                columns = [part.column("doc_id"), *(pa.array(m[x], pa.int64()) for x in names), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict on it."""
    return judge(common.table(spark, sf_dir, "documents"))


def op6_rows(spark, sf_dir: str) -> DataFrame:
    """The same without the longest repeat, which the SQL doesn't have."""
    return op6_quality(spark, sf_dir).drop("longest")


#: A repeated substring of MIN_WORDS words or more is made of repeated windows of MIN_WORDS, and there is one of over MAX_LONGEST words if a window of one word more repeats.
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{common.WORD}') AS w FROM documents
), x AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: md5_number(array_to_string(w[i : i + k - 1], ' ')))) AS h
  FROM d, (VALUES (3), ({MIN_WORDS}), ({MAX_LONGEST + 1})) s(k) WHERE len(w) >= k
), r AS (
  SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, h) AS c FROM x) WHERE c > 1
), c AS (
  SELECT doc_id, k, sum(least(k, coalesce(following - i, k)))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS following FROM r) GROUP BY doc_id, k
), p AS (
  SELECT doc_id, max(n) FILTER (k = 3) AS n3, max(n) FILTER (k = {MIN_WORDS}) AS n8, max(n) FILTER (k = {MAX_LONGEST + 1}) AS n101 FROM c GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{common.WORD}') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n8, 0)::BIGINT AS n_covered, n101 IS NOT NULL AS too_long
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
)
SELECT * EXCLUDE (too_long), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= {MAX_COVERED}::DOUBLE * n_words AND NOT too_long AS kept
FROM m
"""
