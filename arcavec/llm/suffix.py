"""Suffix arrays by Larsson-Sadakane refinement and common prefixes by Kasai's bound, in numpy."""

from __future__ import annotations

import numpy as np

from arcavec.llm.kernels import prefix_hash, slice_hash


def suffix_array(seq: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of a sequence of non-negative integers.

    Suffixes are first sorted by one symbol, then by 2, 4, 8, ... symbols: a group of suffixes
    that still tie is sorted by the rank of the suffix h places on, and suffixes that are alone in
    their group are never touched again, which is the refinement. A rank is the last place of its
    group. With ``depth`` the refinement stops when ties agree on at least that many symbols.
    """
    n = len(seq)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    seq = np.asarray(seq)
    h = 1
    if seq.dtype == np.uint8:  # eight bytes at once save the first three rounds
        padded = np.concatenate([seq, np.zeros(8, np.uint8)])
        seq = np.zeros(n, np.uint64)
        for j in range(8):
            seq = (seq << np.uint64(8)) | padded[j : n + j]
        h = 8
    order = np.argsort(seq).astype(np.int64)
    key = seq[order]
    last = np.flatnonzero(np.append(key[1:] != key[:-1], True))
    sizes = np.diff(last, prepend=-1)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(last, sizes)
    place = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in order that aren't settled
    while len(place) and (depth is None or h < depth):
        at = order[place]
        ahead = np.minimum(at + h, n)
        group = rank[at]
        second = np.where(at + h < n, rank[np.minimum(ahead, n - 1)] + 1, n - at - h)  # of suffixes that end here the shorter is less
        by = np.argsort(group * np.int64(n + h + 1) + second + h) if n < 2_000_000_000 else np.lexsort((second, group))
        at, group, second = at[by], group[by], second[by]
        order[place] = at
        end = np.append((group[1:] != group[:-1]) | (second[1:] != second[:-1]), True)
        where = np.flatnonzero(end)
        sizes = np.diff(where, prepend=-1)
        rank[at] = np.repeat(place[where], sizes)
        place = place[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, in bytes and at most ``limit``; 0 for the first.

    Kasai's bound says that the prefix at text position i + d is at least the one at i less d. It is
    taken level by level: positions 512 apart come first, then those halfway between, each starting
    from the bound that its left neighbour gives, so that numpy extends a whole level at once. Where
    the array was refined to a depth only, ties can break the bound; so it is checked by hashes of
    both slices, and where they differ the comparison starts from nothing.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    known = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(n + 1, np.uint64)
    for j in range(8):
        eight[:n] = (eight[:n] << np.uint64(8)) | padded[j : n + j]
    prefix = prefix_hash(data)
    for step in (0, 256, 128, 64, 32, 16, 8, 4, 2, 1):
        at = np.arange(step, n, 2 * step) if step else np.arange(0, n, 512)
        prior = before[at]
        at, prior = at[prior >= 0], prior[prior >= 0]
        most = np.minimum(limit, n - np.maximum(at, prior))
        size = np.minimum(np.maximum(known[at - step] - step, 0), most) if step else np.zeros(len(at), np.int64)
        size[slice_hash(prefix, at, at + size) != slice_hash(prefix, prior, prior + size)] = 0
        live = np.flatnonzero(size < most)
        while len(live):
            a, b = at[live] + size[live], prior[live] + size[live]
            differ = eight[a] ^ eight[b]
            whole = differ == 0
            size[live[whole]] += 8
            rest = live[~whole]
            high = np.frexp((differ[~whole] >> np.uint64(11)).astype(np.float64))[1]  # bit length, enough for the leading byte but for the last 11 bits
            lead = np.where(high > 0, (53 - high) // 8, np.where(differ[~whole] >> np.uint64(8), 6, 7))
            size[rest] += lead
            live = live[whole]
            live = live[size[live] < most[live]]
        known[at] = np.minimum(size, most)
    out = np.zeros(n, np.int64)
    out[1:] = known[order[1:]]
    return out
