"""Suffix order of many short strings by linear grouping construction, vectorised.

A suffix's Lyndon prefix runs up to its next smaller suffix; its children are the suffixes inside it
whose previous smaller suffix it is, from left to right. Suffixes with one Lyndon prefix make a
group. Groups get their numbers from the largest words to the smallest, a group as soon as the
children of its members have theirs, and hand them to their previous smaller suffixes. Then each
group's order is emitted from that of its members' next smaller suffixes. All groups that are ready
are handled together.

Symbols must differ inside a string for that. Where one of eight bytes occurs twice in any string
of a batch, all symbols of the batch are renamed by prefix doubling, to 16, 32 and more bytes; on
very repetitive strings that goes to the full width and has sorted the suffixes by itself.
"""

from __future__ import annotations

import numpy as np

#: Bytes packed into one symbol.
BLOCK = 8


def blocks(data: np.ndarray, width: int) -> np.ndarray:
    """The eight bytes from each of the first ``width`` columns on, as big-endian numbers."""
    out = np.zeros((len(data), width), np.uint64)
    for k in range(BLOCK):
        out = out << np.uint64(8) | data[:, k:k + width].astype(np.uint64)
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Numbers from 1 in the order of the keys, equal ones alike."""
    order = np.argsort(keys)
    new = np.concatenate([[1], keys[order][1:] != keys[order][:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _symbols(packed: np.ndarray, size: np.ndarray, valid: np.ndarray, zeros: bool) -> np.ndarray:
    """Symbols (strings, places), 0 beyond the end. In no string a symbol occurs twice: where that
    happens, symbols of twice as many bytes are taken. ``zeros``: strings may hold zero bytes."""
    out = np.zeros((len(packed), packed.shape[1]), np.int64)
    columns = np.arange(packed.shape[1])
    first = _dense(packed[valid])
    if zeros:  # a zero byte is more than the end
        rest = np.minimum(size[:, None] - columns, BLOCK)[valid]
        first = _dense(first * (BLOCK + 1) + rest)
    out[valid] = first
    width = BLOCK
    while True:
        placed = np.sort(np.where(valid, out, -1 - columns), axis=1)
        if width >= packed.shape[1] or not (placed[:, 1:] == placed[:, :-1]).any():
            return out
        after = np.zeros_like(out)
        after[:, :-width] = out[:, width:]
        out[valid] = _dense(out[valid] * (out.max() + 1) + after[valid])
        width *= 2


def _smaller(symbol: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next and previous smaller place of each place, ``size`` and -1 where there is none. Strings
    come longest first; ``symbol`` has a column of zeros at its end."""
    width = symbol.shape[1] - 1
    after = np.zeros((len(size), width), np.int64)
    before = np.full((len(size), width), -1, np.int64)
    alive = [int((size > c).sum()) for c in range(width)]
    for c in range(width - 1, -1, -1):
        k = alive[c]
        at, mine = np.full(k, c + 1), symbol[:k, c]
        act = np.flatnonzero(symbol[:k, c + 1] > mine)
        while len(act):
            at[act] = after[act, at[act]]
            act = act[symbol[act, at[act]] > mine[act]]
        after[:k, c] = at
    for c in range(1, width):
        k = alive[c]
        at, mine = np.full(k, c - 1), symbol[:k, c]
        act = np.flatnonzero(symbol[:k, c - 1] > mine)
        while len(act):
            at[act] = before[act, at[act]]
            act = act[at[act] >= 0]
            act = act[symbol[act, at[act]] > mine[act]]
        before[:k, c] = at
    return after, before


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + count, count)


def _refined(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Groups named by how many elements come before them, split by value."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    first_of_group = np.concatenate([[True], g[1:] != g[:-1]])
    at = np.arange(len(g))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    base = np.maximum.accumulate(np.where(first_of_group, at, 0))
    out = np.empty_like(group)
    out[order] = g + begin - base
    return out


def suffix_ranks(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranks (strings, places) of all suffixes of the strings, from 1; 0 beyond their ends.

    ``data`` has the bytes, zeros beyond the ends and eight columns more than the longest string;
    strings come longest first. Suffixes of equal bytes have equal ranks.
    """
    width = data.shape[1] - BLOCK
    valid = np.arange(width) < size[:, None]
    zeros = not data[:, :width][valid].all()
    symbol = _symbols(blocks(data, width), size, valid, zeros)
    after, before = _smaller(np.pad(symbol, ((0, 0), (0, 1))), size)

    # From here on places are numbers in one row, the last of them standing for an end.
    flat = np.flatnonzero(valid.ravel())
    place = np.full(valid.size, -1, np.int64)
    place[flat] = np.arange(len(flat))
    n = end = len(flat)
    row = (flat // width) * width
    sym = symbol.ravel()[flat]
    nss = after.ravel()[flat]
    inside = nss < np.repeat(size, size)  # rows of ``flat`` come string by string
    nss = np.where(inside, place[np.minimum(row + nss, valid.size - 1)], end)
    pss = before.ravel()[flat]
    pss = np.where(pss >= 0, place[row + np.maximum(pss, 0)], end)

    # Groups by symbol, and in each the words told apart by the numbers of their children.
    members = np.argsort(sym)
    count = np.bincount(sym)
    start = np.cumsum(count) - count
    number = np.zeros(n + 1, np.int64)
    single = count[sym] == 1
    number[:n][single] = start[sym[single]] + 1
    waiting = np.zeros(len(count), np.int64)
    child = np.flatnonzero((pss < end) & ~single)
    np.add.at(waiting, sym[pss[child]], 1)
    many = np.flatnonzero(count > 1)
    ready = many[waiting[many] == 0]
    following = np.append(np.arange(1, n + 1), end)
    stop = np.append(nss, end)
    while len(ready):
        size_of = count[ready]
        who = members[_ranges(start[ready], size_of)]
        base = np.repeat(start[ready], size_of)
        group = base.copy()
        at = np.where(pss[np.minimum(following[who], n - 1)] == who, following[who], end)
        at[following[who] >= n] = end
        act = np.arange(len(who))
        while len(act):
            group[act] = _refined(group[act], number[at[act]])
            onward = stop[at[act]]
            on = (at[act] < end) & (onward < end)
            on &= onward != stop[who[act]]
            at[act] = np.where(on, onward, end)
            # Only groups of several members, one of them with a child left, go on.
            held = np.bincount(group[act], minlength=1)
            left = np.bincount(group[act], weights=at[act] < end, minlength=1)
            act = act[(held[group[act]] > 1) & (left[group[act]] > 0)]
        number[who] = group + 1
        parent = pss[who]
        parent = sym[parent[parent < end]]
        np.subtract.at(waiting, parent, 1)
        ready = np.unique(parent)
        ready = ready[(waiting[ready] == 0) & (count[ready] > 1)]

    # Each group's order from that of the next smaller suffixes.
    members = np.argsort(number[:n])
    count = np.bincount(number[:n], minlength=n + 2)
    rank = np.zeros(n + 1, np.int64)
    single = count[number[:n]] == 1
    rank[:n][single] = number[:n][single]
    due = np.flatnonzero(~single & (nss < end))
    due = due[single[nss[due]] == 0]
    waiting = np.bincount(number[due], minlength=n + 2)
    by_target = due[np.argsort(nss[due])]
    sources = np.bincount(nss[due], minlength=n + 1)
    source_start = np.cumsum(sources) - sources
    many = np.flatnonzero(count > 1)
    ready = many[waiting[many] == 0]
    while len(ready):
        who = members[_ranges(ready - 1, count[ready])]
        rank[who] = _refined(number[who], rank[nss[who]])
        touched = number[by_target[_ranges(source_start[who], sources[who])]]
        np.subtract.at(waiting, touched, 1)
        ready = np.unique(touched)
        ready = ready[waiting[ready] == 0]
    out = np.zeros(valid.size, np.int64)
    out[flat] = rank[:n]
    return out.reshape(valid.shape)
