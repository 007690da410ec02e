"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai common prefixes over many strings at once."""

from __future__ import annotations

import numpy as np


def remaining(lengths: np.ndarray) -> np.ndarray:
    """For strings laid end to end: symbols from each position to the end of its string, itself included."""
    ends = np.cumsum(lengths)
    return np.repeat(ends, lengths) - np.arange(int(lengths.sum()))


def first_symbols(symbols: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """The next symbols of every position packed into one integer, and how many; past the end counts as 0."""
    width, n = max(1, 63 // bits), len(symbols)
    sym = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        key |= np.where(left > j, sym[j:n + j], 0)
    return key, width


def suffix_array(symbols: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of strings laid end to end, and the rank of each position.

    Symbols are at least 1 and below 2**bits. Every string ends in a mark of its own
    that sorts before all symbols, earlier strings first, so no comparison crosses
    strings and the order is total. Suffixes are sorted by a packed prefix; after that
    only groups that are still tied are sorted again, by the rank of what follows the
    part already compared, which doubles that part each time.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = remaining(lengths)
    key, h = first_symbols(symbols, left, bits)
    sa = np.argsort(key)
    key = key[sa]
    rank = np.empty(n, np.int64)
    at = np.arange(n)  # places in the order that are not settled
    new = np.empty(n, bool)
    new[0], new[1:] = True, key[1:] != key[:-1]
    while True:
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        group = np.repeat(start, size)
        rank[sa[at]] = at[group]
        keep = np.repeat(size > 1, size)
        if not keep.any():
            return sa, rank
        at, first = at[keep], at[group[keep]]
        suf = sa[at]
        follow = np.minimum(suf + h, n - 1)
        # past its end a suffix meets its own mark: below every rank, in text order
        nxt = np.where(left[suf] > h, rank[follow] + n, suf)
        key = first * (2 * n) + nxt
        order = np.argsort(key)
        sa[at] = suf[order]
        key = key[order]
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, key[1:] != key[:-1]
        h *= 2


def common_prefixes(symbols: np.ndarray, lengths: np.ndarray, sa: np.ndarray, most: int, stride: int = 32) -> np.ndarray:
    """For each place in the suffix array, symbols shared with the suffix before it, counted up to `most`.

    Kasai's rule in steps: what position p shares with the suffix sorted before it is
    at least what p - 1 shares, less one. Every `stride`-th position is compared from
    the start, the others from the bound that rule gives them.
    """
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    left = remaining(lengths)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate([symbols, np.zeros(8, symbols.dtype)])
    if symbols.dtype == np.uint8:
        word = np.empty(n + 8, np.uint64)
        for r in range(8):
            part = pad[r:r + (len(pad) - r) // 8 * 8].view(np.uint64)
            word[r::8][:len(part)] = part
            word[r::8][len(part):] = 0
        step = 8
    else:
        word, step = pad, 1
    shared = np.zeros(n, np.int64)

    def extend(pos: np.ndarray, have: np.ndarray, cap: int) -> None:
        other = before[pos]
        ok = other >= 0
        pos, have, other = pos[ok], have[ok], other[ok]
        top = np.minimum(np.minimum(left[pos], left[other]), cap)
        shared[pos] = np.minimum(have, top)
        live = np.flatnonzero(have < top)
        while len(live):
            p, o, k = pos[live], other[live], have[live]
            same = word[np.minimum(p + k, n - 1)] == word[np.minimum(o + k, n - 1)]
            if step > 1:
                differ = word[p[~same] + k[~same]] ^ word[o[~same] + k[~same]]
                low = differ & (~differ + np.uint64(1))
                gain = np.where(same, 8, 0)
                gain[~same] = np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
            else:
                gain = same.astype(np.int64)
            k = np.minimum(k + gain, top[live])
            have[live] = k
            shared[p] = k
            live = live[same & (k < top[live])]

    sampled = np.arange(0, n, stride)
    extend(sampled, np.zeros(len(sampled), np.int64), most + stride)
    rest = np.setdiff1d(np.arange(n), sampled, assume_unique=True)
    bound = np.maximum(shared[rest // stride * stride] - rest % stride, 0)
    bound = np.where(left[rest] + rest % stride == left[rest // stride * stride], bound, 0)  # same string only
    extend(rest, bound, most)
    lcp[:] = np.minimum(shared[sa], most)
    return lcp
