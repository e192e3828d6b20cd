"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Round j inserts, for each string that has j symbols or more, its suffix of j symbols: one symbol a string. The suffix starts with the symbol that stands in the transform beside the string's last inserted suffix, so its place is the rank of that symbol among its equals up to there. Its common prefix with the neighbour before is one more than the least common prefix between the two places that hold this symbol, and so is that of the neighbour behind it. All places are taken in one sequential pass over the transform as it stands, which is then written anew with the round's symbols in it.

Strings are in order of nothing: equal suffixes of different strings stand as the strings do.
"""

from __future__ import annotations

import numpy as np

from .words import mixed

#: Bytes of a symbol where stretches of bytes are compared at all their places.
WORD = 50
#: Symbols that a collection may have, so that their numbers have 16 bits.
MOST = 65_535


def transform(before: np.ndarray, previous: np.ndarray, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of strings in sorted order, as places, and the common prefix of each with the one above, up to cap (under 256).

    Symbols stand at places, and a string ends at a place behind them. before[p] is the symbol before place p in its string, or 0 where p is the string's first, and previous[p] is its place.
    """
    m = len(ends)
    place = ends.astype(np.int32)
    symbol, prefix, bottom = before[place], np.zeros(m, np.uint8), before[place]
    last = np.arange(m)[symbol > 0]  # where each string's last suffix stands
    while len(last):
        order = np.argsort(symbol, kind="stable")[len(symbol) - np.count_nonzero(symbol) :].astype(np.int32)
        is_last = np.zeros(len(symbol), bool)
        is_last[last] = True
        fresh = is_last[order]
        at = np.flatnonzero(fresh)
        # common prefixes change at the fresh places and behind them; where two neighbours start with different symbols they are 0
        changed = np.zeros(len(order) + 1, bool)
        changed[at] = changed[at + 1] = True
        changed[0] = changed[-1] = False
        changed = np.flatnonzero(changed)
        above, here = order[changed - 1], order[changed]
        value = np.zeros(len(changed), np.uint8)
        same = np.flatnonzero(symbol[above] == symbol[here])
        if len(same):
            value[same] = 1
            apart = np.cumsum(prefix == 0, dtype=np.int32)
            same = same[apart[above[same]] == apart[here[same]]]  # else a common prefix of 0 lies between
            if len(same):
                between = np.stack([above[same] + 1, here[same] + 1], 1).ravel()
                value[same] = np.minimum(np.minimum.reduceat(np.append(prefix, np.uint8(0)), between)[::2], cap - 1) + np.uint8(1)
        grown = np.zeros(m + len(order), np.uint8)
        np.logical_not(fresh, out=fresh)
        grown[m:][fresh] = prefix[m:]
        grown[changed + m] = value
        grown[at[at == 0] + m] = 0
        prefix = grown
        found = previous[place[order]]
        place = np.concatenate([place[:m], found])
        symbol = np.concatenate([bottom, before[found]])
        last = at[symbol[at + m] > 0] + m
    return place[m:], prefix[m:]


def numbered(data: np.ndarray) -> np.ndarray:
    """A number from 1 on for the word of WORD bytes at each place; equal words, and only they, have equal numbers: those with one hash are compared by their bytes."""
    eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    n = len(data) - WORD + 1
    parts = [eights[at : at + n] for at in (*range(0, WORD - 8, 8), WORD - 8)]
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            value = mixed(value * np.uint64(3) + part)
    order = np.argsort(value)
    value = value[order]
    fresh = np.concatenate([[True], value[1:] != value[:-1]])
    group = np.cumsum(fresh, dtype=np.int32)
    model = order[np.flatnonzero(fresh)][group - 1]
    out = np.empty(n, np.uint16)
    if all((part[order] == part[model]).all() for part in parts):
        out[order] = group
        return out
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WORD)).view(f"V{WORD}").ravel()
    table: dict[bytes, int] = {}
    return np.array([table.setdefault(w.tobytes(), len(table) + 1) for w in words], np.uint16)


def repeated(data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """For the windows of `width` bytes of stretches laid end to end in data (each has at least one window), stretch after stretch, whether such a window also starts at another place. owner and place say where each stretch comes from: windows of one owner at one place are the same window, even if they stand in data twice.

    A stretch makes WORD strings, one for each remainder of a place by WORD, whose symbols are the words of WORD bytes at every WORD-th place; so a window is width / WORD whole symbols, and a round inserts WORD bytes of every string. There may be MOST places, and stretches have at least 2 * WORD - 1 bytes.
    """
    n, total, w = len(lengths), int(lengths.sum()), width // WORD
    stops = np.cumsum(lengths)
    starts = stops - lengths
    number = numbered(data)  # those of words across stretches stand before no place that counts
    # places 0 to total - 1 are those of data, and behind them are the ends of strings, WORD for each stretch
    before = np.zeros(total + WORD * n, np.uint16)
    before[WORD : WORD + len(number)][: total - WORD] = number[: total - WORD]
    before[(starts[:, None] + np.arange(WORD)).ravel()] = 0
    tail = (stops[:, None] + np.arange(1 - 2 * WORD, 1 - WORD)).ravel()  # the last words
    before[total:] = number[tail]
    previous = np.arange(-WORD, len(before) - WORD, dtype=np.int32)
    previous[total:] = tail
    at, prefix = transform(before, previous, np.arange(total, len(before)), w)
    fresh = np.flatnonzero(np.concatenate([[True], prefix[1:] < w])) if len(at) else np.empty(0, np.int64)
    size = np.diff(np.append(fresh, len(at)))
    fresh, size = fresh[size > 1], size[size > 1]
    out = np.zeros(total, bool)
    if len(fresh):
        group = np.cumsum(size) - size
        found = at[np.repeat(fresh - group, size) + np.arange(size.sum())]
        which = np.searchsorted(stops, found, "right")
        who = (owner[which].astype(np.int64) << 40) | (place[which] + found - starts[which])
        several = np.minimum.reduceat(who, group) != np.maximum.reduceat(who, group)
        out[found[np.repeat(several, size)]] = True
    inside = np.ones(total, bool)
    inside[(stops[:, None] - np.arange(1, width)).ravel()] = False
    return out[inside]
