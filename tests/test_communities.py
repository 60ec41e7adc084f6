"""Communities against exact modularity on small graphs, and against the partition that is known."""

import random
from itertools import combinations

import pytest

from kindred.operators import graph


def modularity(links, label, resolution=1.0):
    total = 2 * sum(w for *_, w in links)
    inside, mass = {}, {}
    for s, t, w in links:
        for x in (s, t):
            mass[label[x]] = mass.get(label[x], 0.0) + w
        if label[s] == label[t]:
            inside[label[s]] = inside.get(label[s], 0.0) + 2 * w
    return sum(inside.get(k, 0.0) / total - resolution * (m / total) ** 2 for k, m in mass.items())


def partitions(nodes):
    if not nodes:
        yield []
        return
    first, rest = nodes[0], nodes[1:]
    for p in partitions(rest):
        yield [[first], *p]
        for i in range(len(p)):
            yield [*p[:i], [first, *p[i]], *p[i + 1 :]]


def connected(links, members):
    members, seen, stack = set(members), set(), [min(members)]
    while stack:
        x = stack.pop()
        seen.add(x)
        stack += [b for s, t, _ in links for a, b in ((s, t), (t, s)) if a == x and b in members and b not in seen]
    return seen == members


@pytest.mark.parametrize("seed", range(12))
def test_near_the_best_modularity(seed):
    rng = random.Random(seed)
    nodes = list(range(8))
    links = [(a, b, rng.choice([0.85, 0.95, rng.random()])) for a, b in combinations(nodes, 2) if rng.random() < 0.45]
    links += [(i, i + 1, 0.1) for i in range(7)]  # one component
    found = graph.communities_of(nodes, links)
    best = max(modularity(links, {x: i for i, part in enumerate(p) for x in part}) for p in partitions(nodes))
    assert modularity(links, found) > best - 0.03
    groups = {c: [x for x in nodes if found[x] == c] for c in set(found.values())}
    assert all(min(g) == c and connected(links, g) for c, g in groups.items())


@pytest.mark.parametrize("weights", [(0.95,), (0.85, 0.95, 0.96)])
def test_cliques_stay_whole(spark, weights):
    links, k = [], 0
    for clique in range(6):
        base = 10 * clique
        for a, b in combinations(range(base, base + 6), 2):
            links.append((a, b, weights[k % len(weights)]))
            k += 1
        links.append((base + 5, (base + 10) % 60, 0.05))  # a ring of cliques
    links += [(100, 101, 0.95), (101, 102, 0.95), (100, 102, 0.95)]  # a flat component of its own
    df = spark.createDataFrame(links, "source_id long, target_id long, weight double")
    got = {r.id: r.community for r in graph.communities(df).collect()}
    assert got == {x: x // 10 * 10 for x in {e for s, t, _ in links for e in (s, t)}}


def test_order_of_links_changes_nothing():
    rng = random.Random(5)
    links = [(a, b, round(rng.random(), 3)) for a, b in combinations(range(40), 2) if rng.random() < 0.15]
    nodes = sorted({x for s, t, _ in links for x in (s, t)})
    first = graph.communities_of(nodes, links)
    rng.shuffle(links)
    second = graph.communities_of(nodes[::-1], [(t, s, w) for s, t, w in links])
    assert modularity(links, first) == pytest.approx(modularity(links, second), abs=0.05)
    assert graph.communities_of([1], []) == {1: 1} and graph.communities_of([2, 1], [(1, 2, 0.0)])
