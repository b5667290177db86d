"""Suffix arrays by induced sorting, and permuted longest common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; the
leftmost S of a run (LMS) starts a substring that ends with the next one. LMS substrings are
sorted and named; equal names are resolved by recursion on the string of names, at every
level in the same way. The order of the LMS suffixes then induces that of all others: a
suffix is decided by its letters and types up to the next LMS suffix, and by that one's
rank. Of strings of letters with their types none is a prefix of another, since the types
say where a string ends. So an induction is no scan of buckets but a sort of machine words
that hold several letters, and works alike on a few letters and on many names.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of fewer than 2**21 non-negative integers whose last is 0 and occurs nowhere else."""
    n = len(s)
    if n >= 1 << 21:
        raise ValueError("a shard is to be smaller")
    if n == 1:
        return np.zeros(1, np.int64)
    small = _small(s)
    symbol, bits = _symbols(s, small)
    word = words(symbol, bits, 64 // bits) << np.uint64(64 % bits)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    order, new = ordered(word, bits, lms, np.diff(lms, append=n) + 1, None)
    name = np.empty(len(lms), np.int64)
    name[order] = np.cumsum(new) - 1
    rank = name
    if not new.all():
        rank = np.empty(len(lms), np.int64)
        rank[suffix_array(name)] = np.arange(len(lms))
    following = np.cumsum(is_lms)
    following[-1] -= 1
    return ordered(word, bits, None, lms[following] - np.arange(n) + 1, rank[following])[0]


def _small(s: np.ndarray) -> np.ndarray:
    """True for S suffixes. The type of a run of equal letters is that of its last one."""
    step = s[1:] != s[:-1]
    ends = np.flatnonzero(step)
    rising = s[ends + 1] > s[ends]
    return np.append(np.repeat(rising, np.diff(ends, prepend=-1)), True)


def _symbols(s: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense letters with their types in the lowest bit, and the bits of each."""
    used = np.zeros(int(s.max()) + 1, bool)
    used[s] = True
    dense = np.cumsum(used) - 1
    return (dense[s] << 1 | small).astype(np.uint64), max(1, int(2 * dense[-1] + 1).bit_length())


def words(symbol: np.ndarray, bits: int, count: int) -> np.ndarray:
    """For each place count symbols from there on as one number, zeros behind the last."""
    out, have = None, 0
    block, size = symbol, 1
    while count:
        if count & 1:
            out, have = (block, size) if out is None else (out << np.uint64(bits * size) | _shifted(block, have), have + size)
        count >>= 1
        if count:
            block, size = block << np.uint64(bits * size) | _shifted(block, size), size * 2
    return out


def _shifted(a: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[: max(len(a) - by, 0)] = a[by:]
    return out


def ordered(word: np.ndarray, bits: int, start: np.ndarray | None, length: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of length symbols from start (None: from every place), equal ones by last, and where in it a string differs from the one before.

    word: 64 // bits symbols from each place on. Strings are compared by as much of a word as
    fits beside what is needed to put it back in its place; only strings that are still equal
    and no longer than what was compared go on to their next word, the others to last. What
    lies behind a string's end may take part: it is in the order of the suffixes as well.
    """
    m = len(length)
    low = max(1, int(m - 1).bit_length())
    mask = np.uint64((1 << low) - 1)
    v = (word if start is None else word[start]) & ~mask
    v |= np.arange(m, dtype=np.uint64)
    v.sort()
    order = (v & mask).astype(np.int64)
    v >>= np.uint64(low)
    new = np.concatenate([[True], v[1:] != v[:-1]])
    depth = (64 - low) // bits
    live = _tied(new)
    both = length << 21 | (0 if last is None else last)  # fetched at once
    while len(live):
        who = order[live]
        value = both[who]
        done = value >> 21 <= depth
        if last is None:
            live, who = live[~done], who[~done]
            if not len(live):
                break
            done = np.zeros(len(live), bool)
        first = new[live]
        first[0] = True
        group = np.cumsum(first) - 1
        low, top = max(1, int(len(live) - 1).bit_length()), max(1, int(group[-1]).bit_length())
        room = 64 - low - top
        value = (value if last is not None else np.zeros(len(live), np.int64)).view(np.uint64) & np.uint64((1 << 21) - 1)
        longer = np.flatnonzero(~done)
        at = who[longer] if start is None else start[who[longer]]
        value[longer] = word[np.minimum(at + depth, len(word) - 1)] >> np.uint64(64 - room)
        v = (group.astype(np.uint64) << np.uint64(room) | value) << np.uint64(low) | np.arange(len(live), dtype=np.uint64)
        v.sort()
        order[live] = who[(v & np.uint64((1 << low) - 1)).astype(np.int64)]
        v >>= np.uint64(low)
        new[live[1:][v[1:] != v[:-1]]] = True
        depth += room // bits
        live = live[_tied(new[live])]
    return order, new


def _tied(new: np.ndarray) -> np.ndarray:
    """Places in groups of two or more."""
    return np.flatnonzero(~(new & np.append(new[1:], True)))


#: Letters compared at once: words of LETTERS letters of BITS bits.
LETTERS, BITS = 7, 9


def permuted_lcp(s: np.ndarray, sa: np.ndarray, fresh: np.ndarray, room: np.ndarray) -> np.ndarray:
    """plcp[i]: letters that suffix i shares with the one before it in sa, room[i] at most.

    A value is one less than its left neighbour's where both suffixes follow the same letter;
    the others, and those at fresh places (sorted, the first is 0), are compared, LETTERS
    letters below 2**BITS at a time. room falls by one from place to place but at fresh ones.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    alone = np.ones(n, bool)
    ok = before[1:] > 0
    alone[1:][ok] = s[:-1][ok] != s[before[1:][ok] - 1]
    alone[fresh] = True
    places = np.flatnonzero(alone)
    word = words(s.astype(np.uint64), BITS, LETTERS)
    value = np.zeros(len(places), np.int64)
    live = np.flatnonzero(before[places] >= 0)
    a, b, depth, most = places[live], before[places[live]], 0, room[places[live]]
    while len(live):
        inside = np.maximum(a, b) + depth < n
        x = np.ones(len(live), np.uint64) << np.uint64(BITS * LETTERS - 1)
        x[inside] = word[a[inside] + depth] ^ word[b[inside] + depth]
        more = (x == 0) & (depth + LETTERS < most)
        value[live[more]] = depth + LETTERS
        end = ~more
        same = np.full(int(end.sum()), LETTERS, np.int64)
        for k in range(LETTERS):
            same -= x[end] >> np.uint64(BITS * k) != 0
        value[live[end]] = np.minimum(depth + same, most[end])
        live, a, b, most = live[more], a[more], b[more], most[more]
        depth += LETTERS
    filled = (value + places)[np.cumsum(alone) - 1] - np.arange(n)
    return np.where(before >= 0, np.maximum(filled, 0), 0)
