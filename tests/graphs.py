"""Small graphs with known answers, and union-find as the brute-force answer."""

import random

EXAMPLE = [(1, 2), (1, 3), (2, 4), (3, 5), (4, 6), (7, 8)]

NAMED = {
    "example": EXAMPLE,
    "singleton": [(5, 5)],
    "loop_at_min": [(1, 1), (1, 2)],
    "minus_one": [(-1, 2), (2, 3)],
    "all_negative": [(-1, -2), (-2, -3), (-3, -4)],
    "duplicates": [(1, 2), (2, 1), (1, 2)],
    "two_loops": [(3, 3), (3, 4), (4, 4), (9, 9)],
    "path": [(i, i + 1) for i in range(12)],
    "star_min": [(0, i) for i in range(1, 13)],
    "star_max": [(12, i) for i in range(12)],
    "clique": [(i, j) for i in range(6) for j in range(i)],
    "extremes": [(-(2**63), 2**63 - 1), (2**63 - 1, 0)],
}


def components(edges, vertices=()):
    """Vertex to least id of its component."""
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for v in vertices:
        find(v)
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in parent}


def random_graph(rng):
    ids = rng.randint(2, 41)
    offset = rng.choice((0, -1, -20))
    return [
        (offset + rng.randrange(ids), offset + rng.randrange(ids))
        for _ in range(rng.randint(1, 50))
    ]


def side_by_side(graphs, gap=1000):
    """Many graphs as one, each in its own range of ids; the first keeps its ids."""
    return [(a + gap * i, b + gap * i) for i, edges in enumerate(graphs) for a, b in edges]


def many_graphs(seed=7, count=80):
    rng = random.Random(seed)
    small = [edges for name, edges in NAMED.items() if name != "extremes"]
    return side_by_side(small + [random_graph(rng) for _ in range(count)])


def powerlaw_graph(seed=3, vertices=400, edges=900):
    """Few vertices hold most edges; one of them a third."""
    rng = random.Random(seed)
    hubs = [rng.randrange(vertices) for _ in range(5)]
    found = [(hubs[0], rng.randrange(vertices)) for _ in range(edges // 3)]
    found += [(rng.choice(hubs), rng.randrange(vertices)) for _ in range(edges // 3)]
    found += [(rng.randrange(vertices), rng.randrange(vertices)) for _ in range(edges // 3)]
    return found
