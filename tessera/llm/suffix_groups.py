"""Suffix orders of many short strings at once, by grouping suffixes by their Lyndon prefixes.

The construction is linear and doesn't recurse. First, groups of suffixes are processed from the highest down: each
suffix of a group finds its previous smaller suffix (places between belong to higher groups, whose own pointers jump
over them), and the suffixes so pointed at, whose Lyndon prefix thereby grows by the group's, move into new groups
just above their old ones, by how often they are pointed at. When all are processed, a group holds the suffixes of
one longest Lyndon prefix. Second, places are emitted in suffix order: what follows the Lyndon prefix of a suffix is
its next smaller suffix, so when that one is emitted, the suffix takes the next place of its group; the suffixes that
wait for one are found along the pointers. No names are made anew.

A step is one group (then one place) of every string at once, in arrays over all strings; so the number of steps
is that of the longest string, and strings of like length should come together.
"""

from __future__ import annotations

import numpy as np


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` many."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def suffix_orders(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of ``symbols``, string by string, in the order of the suffixes that begin there.

    ``symbols`` holds strings of ``lengths``, longest first, one after another. Each ends with a 0 that it has
    nowhere else; other symbols are larger. Suffixes end with their strings.
    """
    if not len(symbols):
        return np.zeros(0, np.int64)
    # One place is put before all; it ends the search of the first string, as their ends do for the others.
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + 1
    text = np.concatenate([[0], symbols]).astype(np.int64)
    link, prev = _grouped(text, base, lengths)
    return _emitted(text, base, lengths, link, prev) - 1


def _grouped(text: np.ndarray, base: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the first rank of its suffix's group, and its previous smaller suffix (an end, where there is none)."""
    n = len(text)
    string = np.concatenate([[-1], np.repeat(np.arange(len(lengths)), lengths)])
    key = (string + 1) * (int(text.max()) + 1) + text
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    head = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    size = np.zeros(n, np.int64)
    size[head] = np.diff(np.append(head, n))
    link = np.empty(n, np.int64)
    link[order] = np.repeat(head, size[head])
    prev, moves = np.zeros(n, np.int64), np.zeros(n, bool)
    live = np.flatnonzero(lengths > 1)
    top, low = (base + lengths)[live], base[live] + 1
    while len(top):
        first = link[order[top - 1]]
        many = top - first
        own = order[ranges(first, many)]
        group = np.repeat(first, many)
        # Higher groups are jumped over.
        p = own - 1
        far = np.flatnonzero(link[p] > group)
        while len(far):
            p[far] = prev[p[far]]
            far = far[link[p[far]] > group[far]]
        prev[own] = p
        # Those of the same group form chains, all of which point where their first does.
        same = np.flatnonzero(link[p] == group)
        while len(same):
            p[same] = prev[p[same]]
            prev[own[same]] = p[same]
            same = same[link[p[same]] == group[same]]
        q = np.sort(p[text[p] != 0])
        if len(q):
            new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            count, q = np.diff(np.append(new, len(q))), q[new]
            _move(q, count, link[q], order, rank, link, size, moves)
        keep = first > low
        top, low = first[keep], low[keep]
    return link, prev


def _move(q, count, old, order, rank, link, size, moves) -> None:
    """Suffixes ``q`` go to the upper end of their groups, into a new group for each count, larger counts above."""
    by = np.lexsort((count, old))
    q, count, old = q[by], count[by], old[by]
    fresh = np.concatenate([[True], old[1:] != old[:-1]])
    head = np.flatnonzero(fresh)
    many = np.diff(np.append(head, len(q)))
    group = old[head]
    tail = group + size[group] - many
    to = ranges(tail, many)
    moves[q] = True
    there = order[to]
    stays = there[~moves[there]]
    moves[q] = False
    was = rank[q]
    holes = was[was < np.repeat(tail, many)]
    order[holes], rank[stays] = stays, holes
    order[to], rank[q] = q, to
    size[group] -= many
    start = np.flatnonzero(fresh | np.concatenate([[True], count[1:] != count[:-1]]))
    sizes = np.diff(np.append(start, len(q)))
    size[to[start]] = sizes
    link[q] = np.repeat(to[start], sizes)


def _emitted(text: np.ndarray, base: np.ndarray, lengths: np.ndarray, link: np.ndarray, prev: np.ndarray) -> np.ndarray:
    """All places in the order of their suffixes, from the groups and pointers."""
    n = len(text)
    out, put, done = np.zeros(n, np.int64), np.arange(n), text == 0
    out[base] = base + lengths - 1
    some = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # strings longer than each number of steps
    for step in range(int(lengths[0])):
        e = out[base[: some[step]] + step] - 1
        e = e[~done[e]]
        while len(e):
            group = link[e]
            at = put[group]
            out[at] = e
            put[group] = at + 1
            done[e] = True
            e = prev[e]
            e = e[~done[e]]
    return out[1:]
