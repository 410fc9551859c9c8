"""Suffix sorting by grouping, for many short strings at a time.

Suffixes are first grouped by their Lyndon prefixes: groups are taken in descending order, and the
suffixes that the members' previous-smaller pointers name move to new groups right above their old
ones. Then every suffix, in ascending order, emits those whose Lyndon prefix ends where it starts
into their groups; nothing is renamed and no level is repeated. All rows of a matrix advance
together, so each step is one array operation.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(text: np.ndarray) -> np.ndarray:
    """The start, in sorted order, of the group of each suffix; ``text`` is (rows, length)."""
    rows, length = text.shape
    every = np.arange(rows)[:, None]
    # Groups of first symbols: how many symbols of the row are smaller.
    counts = np.zeros((rows, int(text.max(initial=0)) + 2), np.int64)
    np.add.at(counts, (np.broadcast_to(every, text.shape), text + 1), 1)
    group = np.take_along_axis(np.cumsum(counts, axis=1), text.astype(np.int64), axis=1).astype(np.int32)
    size = np.zeros((rows, length + 1), np.int32)
    np.add.at(size, (np.broadcast_to(every, text.shape), group), 1)
    done = np.zeros((rows, length), bool)
    columns = np.arange(length, dtype=np.int32)
    active = np.arange(rows)
    while len(active):
        part = group[active]
        live = np.where(done[active], -1, part)
        current = live.max(axis=1)
        member = live == current[:, None]
        lower = (live >= 0) & ~member
        previous = np.maximum.accumulate(np.where(lower, columns, -1), axis=1)
        r, c = np.nonzero(member)
        p = previous[r, c]
        named = p >= 0
        moved, times = np.unique(r[named].astype(np.int64) * length + p[named], return_counts=True)
        if len(moved):
            mr, mc = moved // length, moved % length
            old = part[mr, mc]
            order = np.lexsort((times, old, mr))
            mr, mc, old, times = mr[order], mc[order], old[order], times[order]
            edge = np.r_[True, (mr[1:] != mr[:-1]) | (old[1:] != old[:-1])]
            split = edge | np.r_[True, times[1:] != times[:-1]]
            first, start = np.flatnonzero(edge), np.flatnonzero(split)
            ends = np.r_[first[1:], len(mr)]
            end = np.repeat(ends, ends - first)
            total = size[active[mr[start]], old[start]]
            new = old[start] + total - (end[start] - start)
            held = np.diff(np.r_[start, len(mr)])
            size[active[mr[first]], old[first]] -= (ends - first).astype(np.int32)
            size[active[mr[start]], new] = held
            group[active[mr], mc] = np.repeat(new, held)
        done[active] |= member
        active = active[~done[active].all(axis=1)]
    return group


def suffix_arrays(text: np.ndarray) -> np.ndarray:
    """Suffix array of every row. Rows are small non-negative integers of equal length."""
    rows, length = text.shape
    group = lyndon_groups(text)
    every = np.arange(rows)
    # The suffix that follows the Lyndon prefix: the next one whose group is not larger.
    after = np.full((rows, length + 1), length, np.int32)
    floor = np.concatenate([group, np.full((rows, 1), -1, group.dtype)], axis=1)
    for i in range(length - 1, -1, -1):
        at = np.full(rows, i + 1, np.int32)
        more = np.flatnonzero(floor[every, at] > group[:, i])
        while len(more):
            at[more] = after[more, at[more]]
            more = more[floor[more, at[more]] > group[more, i]]
        after[:, i] = at
    ends = (every[:, None] * (length + 1) + after[:, :length]).ravel()
    by_end = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[by_end], np.arange(rows * (length + 1) + 1))
    out = np.full((rows, length), -1, np.int32)
    free = np.tile(np.arange(length + 1, dtype=np.int32), (rows, 1))
    for step in range(-1, length):
        suffix = np.full(rows, length) if step < 0 else out[:, step]
        where = every * (length + 1) + suffix
        start, n = first[where], first[where + 1] - first[where]
        r = np.repeat(every, n)
        emitted = by_end[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)] % length
        slot = group[r, emitted]
        out[r, free[r, slot]] = emitted
        free[r, slot] += 1
    return out
