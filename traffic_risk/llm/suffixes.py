"""Suffix arrays by linear grouping, and repeated byte strings in a set of segments.

Baier: Linear-time Suffix Sorting - A New Approach for Suffix Array Construction (2016). The first phase groups
suffixes by their Lyndon prefix: groups are taken from the highest down; every member points to the last suffix
before it in a lower group; the suffixes pointed to move up within their own group, by how many members point to them.
The second phase emits the order: each suffix in order puts those that end where it starts, found along the
same pointers, to the front of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
"""Bytes to a symbol."""


def suffix_array(symbols: list[int]) -> list[int]:
    """Start of every suffix, in order; symbols are any integers that can be compared."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    members = sorted(range(n), key=symbols.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(members):
        if symbols[i] != symbols[members[start]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1

    before = [-1] * n
    stop = n
    while stop > 0:
        first = group[members[stop - 1]]
        pointing: dict[int, int] = {}
        own = members[first:stop] if stop - first == 1 else sorted(members[first:stop])
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointing[j] = pointing.get(j, 0) + 1
        stop = first
        if not pointing:
            continue
        by_count: dict[int, list[int]] = {}
        for j, times in pointing.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[times]:
                moved.setdefault(group[j], []).append(j)
            for low, chosen in moved.items():
                if len(chosen) == size[low]:
                    continue
                to = low + size[low]
                size[low] -= len(chosen)
                begin = low + size[low]
                size[begin] = len(chosen)
                for j in chosen:
                    # the last place of the group that is not taken yet
                    to -= 1
                    other, at = members[to], place[j]
                    members[at], place[other] = other, at
                    members[to], place[j] = j, to
                    group[j] = begin
    order, free, done = [0] * n, group[:], [False] * n
    next_free = list(range(n))
    at, suffix = 0, n
    while True:
        i = suffix - 1
        while i >= 0 and not done[i]:
            g = free[i]
            order[next_free[g]] = i
            next_free[g] += 1
            done[i] = True
            i = before[i]
        if at == n:
            return order
        suffix = order[at]
        at += 1


def repeated_starts(segments: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For every segment, which of its first starts begin a string of ``length`` bytes that also begins elsewhere.

    A segment is (bytes, anchor, starts): strings begin at its first ``starts`` places, of which the last ends with
    the segment. The same string must stand at the same distance from the anchor wherever it occurs, up to
    multiples of ``BLOCK``. Symbols are blocks of bytes counted from the anchor; a string is then known by
    the rest of the block it begins in, and by the class, in the suffix array, of the suffix after it among
    those that agree on the bytes left.
    """
    joined, segment_first, at = [], [], 0
    for data, anchor, _ in segments:
        lead = -anchor % BLOCK
        total = lead + len(data)
        joined.append(b"\0" * lead + data + b"\0" * (-total % BLOCK + BLOCK))  # the last block is the separator
        segment_first.append(at + lead)
        at += len(joined[-1])
    raw = b"".join(joined)
    halves = np.frombuffer(raw, dtype=">u8").astype(np.uint64).reshape(-1, 2)
    n = len(halves)
    separators = np.cumsum([len(j) for j in joined]) // BLOCK - 1
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    ranked = halves[order]
    fresh = np.append(False, (ranked[1:] != ranked[:-1]).any(axis=1))
    symbols = np.empty(n, dtype=np.int64)
    symbols[order] = np.cumsum(fresh)
    symbols[separators] = n + np.arange(len(separators))
    sa = np.array(suffix_array(symbols.tolist()), dtype=np.int64)
    common = _common_bytes(sa, symbols, halves, length)

    starts = np.concatenate([f + np.arange(k) for f, (_, _, k) in zip(segment_first, segments, strict=True)])
    found = np.zeros(len(starts), dtype=bool)
    rest = starts % BLOCK
    for r in range(BLOCK):
        these = np.flatnonzero(rest == r)
        if not len(these):
            continue
        block = starts[these] // BLOCK
        depth = length if r == 0 else length - (BLOCK - r)
        classes = np.empty(n, dtype=np.int64)
        classes[sa] = np.cumsum(np.append(True, common < depth)) - 1
        own = classes[block if r == 0 else block + 1]
        if r == 0:
            found[these] = np.bincount(classes[block], minlength=n)[own] > 1
            continue
        several = np.bincount(own, minlength=n)[own] > 1
        these, block, own = these[several], block[several], own[several]
        high, low = _without_first(halves[block], r)
        by = np.lexsort((low, high, own))
        same = (own[by[1:]] == own[by[:-1]]) & (high[by[1:]] == high[by[:-1]]) & (low[by[1:]] == low[by[:-1]])
        found[these[by]] = np.append(same, False) | np.append(False, same)
    return np.split(found, np.cumsum([k for _, _, k in segments])[:-1])


def _without_first(halves: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as two numbers, their first ``r`` bytes set to zero."""
    top = np.uint64((1 << (64 - 8 * min(r, 8))) - 1)
    bottom = np.uint64((1 << (64 - 8 * max(r - 8, 0))) - 1)
    return halves[:, 0] & top, halves[:, 1] & bottom


def _common_bytes(sa: np.ndarray, symbols: np.ndarray, halves: np.ndarray, most: int) -> np.ndarray:
    """Common first bytes of neighbours in the suffix array, at least up to ``most``."""
    a, b = sa[:-1], sa[1:]
    out = np.zeros(len(a), dtype=np.int64)
    left = np.arange(len(a))
    for step in range(most // BLOCK + 1):
        x, y = a[left] + step, b[left] + step
        inside = (x < len(symbols)) & (y < len(symbols))
        left, x, y = left[inside], x[inside], y[inside]
        equal = symbols[x] == symbols[y]
        differ = left[~equal]
        if len(differ):
            separated = np.maximum(symbols[x[~equal]], symbols[y[~equal]]) >= len(symbols)
            apart = halves[x[~equal]] ^ halves[y[~equal]]
            out[differ] += np.where(separated, 0, _leading_zero_bytes(apart))
        left = left[equal]
        out[left] += BLOCK
        if not len(left):
            break
    return out


def _leading_zero_bytes(pairs: np.ndarray) -> np.ndarray:
    as_bytes = np.ascontiguousarray(pairs.astype(">u8")).view(np.uint8).reshape(-1, BLOCK)
    return np.argmax(as_bytes != 0, axis=1)
