"""Suffix sorting by grouping, and partitioned suffix trees."""

from __future__ import annotations

from collections import Counter

import numpy as np


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of symbols whose last is less than all others, in linear time without recursion.

    First all suffixes are grouped by their longest Lyndon prefix. Groups start out
    as those of one first symbol and are processed in descending order. For each
    member of a group the previous smaller suffix is that of the nearest place
    before it in a lower group; places on the way are in groups that were
    processed, whose own pointers are followed. The places so pointed at have
    their Lyndon prefix extended by the group's; they leave their groups for new
    ones right above, those that are extended more often higher.

    Then suffixes are emitted: each that gets its rank puts the ones that end their
    Lyndon prefix just before it, along the same pointers, in their groups' next places.
    """
    n = len(symbols)
    group, begin = [0] * n, {}
    at = 0
    for symbol, count in sorted(Counter(symbols).items()):
        begin[symbol] = at
        at += count
    members: list[list[int] | None] = [None] * n
    size = [0] * n
    for i, symbol in enumerate(symbols):
        g = group[i] = begin[symbol]
        if members[g] is None:
            members[g] = [i]
        else:
            members[g].append(i)
        size[g] += 1
    before = [-1] * n
    for g in range(n - 1, -1, -1):
        if members[g] is None:
            continue
        times: dict[int, int] = {}
        for i in sorted(members[g]):
            if group[i] != g:
                continue  # it has left for a higher group
            p = i - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            if p >= 0 and group[p] == g:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        members[g] = None
        if not times:
            continue
        leaving: dict[tuple[int, int], list[int]] = {}
        for p, count in times.items():
            leaving.setdefault((-count, group[p]), []).append(p)
        for (_, h), places in sorted(leaving.items()):
            size[h] -= len(places)
            new = h + size[h]
            members[new] = places
            size[new] = len(places)
            for p in places:
                group[p] = new
    order = [-1] * n
    placed = [False] * n
    following = list(range(n))
    order[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        s = order[r] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[following[g]] = s
            following[g] += 1
            placed[s] = True
            s = before[s]
    return order


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each count."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def suffix_arrays(symbols: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The suffix arrays of many texts, those from each edge to the next, by the same construction in step.

    A text begins and ends with symbol 0, which is less than all others, and may
    have more of them between its strings; suffixes that begin with one are not
    sorted. Each step processes the next group in descending order of every text
    at once, so the Python work is a few array operations a step, and there are as many steps as the
    text with most different Lyndon prefixes has.

    A group is named by its first place in the order. Places whose prefix is
    extended move to the end of their group's part, those extended more often last.
    """
    n = len(symbols)
    count = np.diff(edges)
    key = np.repeat(np.arange(len(count)), count) * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key)
    new = np.ones(n, dtype=bool)
    new[1:] = np.diff(key[order]) != 0
    begin = np.flatnonzero(new).astype(np.int64)
    size = np.zeros(n, dtype=np.int64)
    size[begin] = np.diff(np.append(begin, n))
    group, at, before, tally = (np.zeros(n, dtype=np.int64) for _ in range(4))
    group[order] = np.repeat(begin, size[begin])
    at[order] = np.arange(n, dtype=np.int64)
    length = np.ones(n, dtype=np.int64)
    mark = np.zeros(n, dtype=bool)
    lowest = (edges[:-1] + size[edges[:-1]]).astype(np.int64)

    def extend(places: np.ndarray, word: np.ndarray) -> None:
        """Move the places that were pointed at, once for each member that did, into groups of their own."""
        turn = np.arange(len(places))
        tally[places] = turn
        chosen = np.flatnonzero(tally[places] == turn)  # of equal places the last one
        if len(chosen) < len(places):
            times = np.bincount(tally[places], minlength=len(places))[chosen]
            places, word = places[chosen], word[chosen] * times
        else:
            times = np.ones(len(places), dtype=np.int64)
        length[places] += word
        old = group[places]
        by = np.argsort(old * (int(times.max()) + 1) + times)
        places, old, times = places[by], old[by], times[by]
        fresh = np.ones(len(old), dtype=bool)
        fresh[1:] = old[1:] != old[:-1]
        start = np.flatnonzero(fresh)
        gone = np.diff(np.append(start, len(old)))
        left = old[start]
        to = np.repeat(left + size[left] - gone, gone) + spread(gone)
        source = at[places]
        mark[to] = True
        vacant = source[~mark[source]]
        mark[to] = False
        mark[source] = True
        moved = order[to[~mark[to]]]
        mark[source] = False
        order[vacant], at[moved] = moved, vacant
        order[to], at[places] = places, to
        size[left] -= gone
        fresh[1:] |= times[1:] != times[:-1]
        start = np.flatnonzero(fresh)
        named = to[start]
        size[named] = np.diff(np.append(start, len(old)))
        group[places] = np.repeat(named, size[named])

    live = np.flatnonzero(lowest < edges[1:])
    now = group[order[edges[live + 1] - 1]]
    while len(live):
        held = size[now]
        own = np.repeat(now, held)
        member = order[own + spread(held)]
        p = member - 1
        todo = np.flatnonzero(group[p] > own)
        while len(todo):
            p[todo] = before[p[todo]]
            todo = todo[group[p[todo]] > own[todo]]
        before[member] = p
        todo = np.flatnonzero(group[p] == own)
        while len(todo):
            p[todo] = before[p[todo]]
            before[member[todo]] = p[todo]
            todo = todo[group[p[todo]] == own[todo]]
        inside = np.flatnonzero(symbols[p])
        if len(inside):
            extend(p[inside], length[member[inside]])
        more = now > lowest[live]
        live, now = live[more], group[order[now[more] - 1]]

    # emit: groups of several in ascending order, each by how often the prefix repeats and the rank of what follows
    several = np.flatnonzero(size > 1)
    several = several[group[order[several]] == several]
    text = np.searchsorted(edges, several, side="right") - 1
    several, text = several[several >= lowest[text]], text[several >= lowest[text]]
    turn = spread(np.bincount(text, minlength=len(count)))
    several = several[np.argsort(turn, kind="stable")]
    times = np.zeros(n, dtype=np.int64)
    for now in np.split(several, np.cumsum(np.bincount(turn))[:-1]) if len(several) else []:
        now = np.sort(now)
        held = size[now]
        slot = np.repeat(now, held) + spread(held)
        own = np.repeat(now, held)
        member = order[slot]
        before[member], times[member] = member + length[member], 1  # the pointers now lead forwards
        todo = np.flatnonzero(group[before[member]] == own)
        while len(todo):
            ahead = before[member[todo]]
            more, end = times[ahead], before[ahead]
            times[member[todo]] += more
            before[member[todo]] = end
            todo = todo[group[end] == own[todo]]
        member = member[np.lexsort((at[before[member]], times[member], own))]
        order[slot], at[member] = member, slot
    return order


def prefix_groups(suffixes: np.ndarray, starts: np.ndarray, depth: int, limit: int) -> list[np.ndarray]:
    """Suffixes in groups of at most ``limit``, each of one or several whole prefixes of variable length.

    A prefix is lengthened only where more than ``limit`` suffixes begin with it, down
    to ``depth``, where they are equal; short groups are put together.
    """
    out: list[np.ndarray] = []
    loose: list[np.ndarray] = []
    held = 0
    work = [(starts, 0)]
    while work:
        own, length = work.pop()
        if len(own) > limit and length < depth:
            token = suffixes[own + length]
            order = np.argsort(token, kind="stable")
            cut = np.flatnonzero(np.diff(token[order])) + 1
            work += [(part, length + 1) for part in np.split(own[order], cut)]
        elif len(own) > limit:
            out.append(own)
        else:
            if held + len(own) > limit:
                out.append(np.concatenate(loose))
                loose, held = [], 0
            loose.append(own)
            held += len(own)
    return out + ([np.concatenate(loose)] if loose else [])


def deep_nodes(suffixes: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The group's subtree down to ``depth``: suffixes in order and, for each, the number of its node at that depth.

    Leaves stand in lexical order; the common prefix of neighbours is the depth of
    the node that joins them, and leaves joined at ``depth`` repeat.
    """
    rows = suffixes[starts[:, None] + np.arange(depth)]
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    joined = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1)
    node = np.zeros(len(starts), dtype=np.int64)
    node[1:] = np.cumsum(joined < depth)
    return order, node
