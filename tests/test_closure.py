"""Ancestor closures against a search from every node."""

import random

from cohortry.operators import concepts as K


def search(edges):
    below = {}
    for a, d in edges:
        if a is not None and d is not None:
            below.setdefault(a, set()).add(d)
    out = set()
    for a in below:
        seen, todo = set(), list(below[a])
        while todo:
            d = todo.pop()
            if d not in seen:
                seen.add(d)
                todo += below.get(d, ())
        out |= {(a, d) for d in seen}
    return sorted(out)


def test_closure_of_chains_cycles_and_random_edges(frame, rows):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(40)]
    cycle = [(100, 101), (101, 102), (102, 100), (102, 103), (104, 104)]
    tangle = [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(45)]
    edges = chain + cycle + tangle + [(1, 2), (None, 5), (5, None)]
    assert sorted(rows(K.closure(frame(edges, "p int, c int"), "p", "c"))) == search(edges)
    assert rows(K.closure(frame([], "p string, c string"), "p", "c")) == []
    assert rows(K.closure(frame([("x", "y"), ("y", "z")], "c string, p string"), "p", "c")) == [("y", "x"), ("z", "x"), ("z", "y")]
