import random

import numpy as np

from graphloom.llm import suffixes


def test_suffix_array_by_grouping():
    r = random.Random(5)
    for n in [*range(0, 40), *[200] * 20]:
        for k in (1, 2, 3, 20):
            s = [r.randint(1, k) for _ in range(n)] + [0]
            assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([3, 1] * 50 + [0], [1, 2, 1, 1, 2, 1, 1, 1, 2, 1, 1, 2, 1, 0], [5] * 300 + [0]):
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_prefix_groups_and_subtrees():
    r = np.random.default_rng(1)
    text = r.integers(0, 3, 3000).astype(np.uint64)
    starts = np.arange(len(text) - 6)
    truth = {}
    for i in starts.tolist():
        truth.setdefault(tuple(text[i : i + 6]), set()).add(i)
    for limit in (1, 10, 400, 5000):
        groups = suffixes.prefix_groups(text, starts, 6, limit)
        assert sorted(np.concatenate(groups).tolist()) == starts.tolist()
        found = []
        for own in groups:
            order, node = suffixes.deep_nodes(text, own, 6)
            for k in range(node.max() + 1):
                found.append(frozenset(own[order][node == k].tolist()))
        assert set(found) == set(map(frozenset, truth.values()))


def test_suffix_arrays_in_step():
    r = random.Random(6)
    for _ in range(150):
        symbols, edges = [], [0]
        for _ in range(r.randint(1, 5)):
            base = [r.randint(1, 3) for _ in range(r.randint(1, 25))]
            for _ in range(r.randint(0, 5)):
                symbols += [0, *(base if r.random() < 0.5 else r.choices(range(1, r.choice((3, 5))), k=r.randint(0, 40)))]
            symbols.append(0)
            edges.append(len(symbols))
        order = suffixes.suffix_arrays(np.array(symbols), np.array(edges)).tolist()
        for lo, hi in zip(edges, edges[1:]):
            found = [i for i in order[lo:hi] if symbols[i]]
            assert sorted(order[lo:hi]) == list(range(lo, hi))
            rest = [symbols[i : symbols.index(0, i)] for i in found]
            assert rest == sorted(rest)
