"""Suffix arrays by linear grouping, of many short texts in step.

The construction is the published one that sorts suffixes by their Lyndon prefixes (Baier, "Linear-time suffix sorting", CPM 2016).
First phase: suffixes are grouped by their first character and groups are taken in descending order. Each suffix i of a
group points to prev(i), the last suffix before it in a smaller group; suffixes that are pointed at by l suffixes of the
group leave their own group for a new one right above it, above those with fewer. In the end a group holds the suffixes of one
Lyndon prefix. Second phase: suffixes are emitted in ascending order; the one before an emitted suffix, and the chain
of its prev pointers, take the next free places of their groups. Nothing is renamed and nothing recurses.

Here the texts are blocks of one array. Every step takes one group of each block that still has one, so that the
array operations of a step work for thousands of blocks.
"""

from __future__ import annotations

import numpy as np


def _ramp(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count numbers each."""
    first = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(start - first, count)


def suffix_groups(code: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First phase. code: characters; 0 separates texts, and every block starts and ends with one. blocks: where blocks start, and
    the end. Returns group (the place of its first suffix in the suffix array), prev, and the array by groups."""
    n = len(code)
    block = np.repeat(np.arange(len(blocks) - 1), np.diff(blocks))
    key = block * 512 + code
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    first = np.flatnonzero(new)
    size = np.zeros(n + 1, np.int64)
    size[first] = np.diff(np.concatenate((first, [n])))
    group = np.empty(n, np.int64)
    group[order] = first[np.cumsum(new) - 1]
    prev = np.arange(n) - 1
    moved = np.zeros(n, bool)
    low, end = blocks[:-1].copy(), blocks[1:].copy()
    while True:
        start = group[order[end - 1]]
        live = start > low  # the lowest group is that of the separators
        if not live.all():
            low, end, start = low[live], end[live], start[live]
            if not len(low):
                return group, prev, order
        count = end - start
        own = order[_ramp(start, count)]
        at, least = own - 1, np.repeat(start, count)
        todo = np.flatnonzero(group[at] >= least)
        while len(todo):
            at[todo] = prev[at[todo]]
            prev[own[todo]] = at[todo]
            todo = todo[group[at[todo]] >= least[todo]]
        prev[own] = at
        end = start
        to = np.sort(at[code[at] > 0])
        if not len(to):
            continue
        edge = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        j, times = to[edge], np.diff(np.concatenate((edge, [len(to)])))
        source = group[j]
        rank = np.lexsort((times, source))
        j, times, source = j[rank], times[rank], source[rank]
        head = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1])))
        many = np.diff(np.concatenate((head, [len(j)])))
        which = source[head]
        tail = which + size[which] - many  # moved suffixes take the end of their group
        slot = _ramp(tail, many)
        moved[j] = True
        there = order[slot]
        stay = there[~moved[there]]
        left = place[j]
        left = left[left < np.repeat(tail, many)]
        order[left], place[stay] = stay, left
        order[slot], place[j] = j, slot
        moved[j] = False
        size[which] -= many
        run = np.flatnonzero(np.concatenate(([True], (source[1:] != source[:-1]) | (times[1:] != times[:-1]))))
        length = np.diff(np.concatenate((run, [len(j)])))
        size[slot[run]] = length
        group[j] = np.repeat(slot[run], length)


def suffix_arrays(code: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The suffixes of each block in order, from its start in the result; suffixes end at their text's separator."""
    if len(blocks) < 2:
        return np.zeros(0, np.int64)
    group, prev, order = suffix_groups(code, blocks)
    out = np.full(len(code), -1)
    seen = code == 0
    free = np.arange(len(code) + 1)
    low, end = blocks[:-1].copy(), blocks[1:].copy()
    # the separators come first
    seps = np.flatnonzero(seen)
    count = np.add.reduceat(seen, blocks[:-1]).astype(np.int64)
    out[_ramp(low, count)] = seps
    at = low.copy()
    while len(at):
        j = out[at] - 1
        j = j[j >= low]
        j = j[~seen[j]]
        while len(j):
            slot = free[group[j]]
            out[slot] = j
            free[group[j]] = slot + 1
            seen[j] = True
            j = prev[j]
            j = j[~seen[j]]
        at = at + 1
        live = at < end
        if not live.all():
            at, low, end = at[live], low[live], end[live]
    return out
