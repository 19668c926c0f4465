import random

import pytest

from tidemark.operators import cycles as c


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def brute_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for u, v in edges:
            reach[u] |= reach[v]
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def brute_cycles(edges, comp):
    """By the definition: breadth-first ways from the smallest node and back to it, cut where they meet."""
    inner = {(u, v) for u, v in edges if u != v and comp[u] == comp[v]}
    out = {(u, u) for u, v in edges if u == v}
    for root in {comp[u] for u, _ in inner}:
        own = {e for e in inner if comp[e[0]] == root}

        def ways(links):
            found, level = {root: [root]}, [root]
            while level:
                new = {}
                for a, b in links:
                    if a in level and b not in found:
                        new[b] = min(new.get(b, a), a)
                found |= {b: [*found[a], b] for b, a in new.items()}
                level = list(new)
            return found

        there, back = ways(own), {n: w[::-1] for n, w in ways({(v, u) for u, v in own}).items()}
        for u, v in own:
            x = next(n for n in back[v] if n in there[u])
            cycle = there[u][there[u].index(x) :] + back[v][: back[v].index(x)]
            k = cycle.index(min(cycle))
            cycle = cycle[k:] + cycle[:k]
            out.add((*cycle, cycle[0]))
    return out


@pytest.mark.parametrize("small", [50_000, 0])
def test_random_graphs_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(c, "SMALL", small)
    r = random.Random(4)
    edges = [(r.randrange(20), r.randrange(20)) for _ in range(26)] + [(100 + r.randrange(6), 100 + r.randrange(6)) for _ in range(9)] + [(k, k + 1) for k in range(200, 206)] + [(5, 5), (300, 300)]
    edges = edges if not small else edges + [(400 + r.randrange(300), 400 + r.randrange(300)) for _ in range(500)]
    df = edges_of(spark, edges + edges[:10] + [(None, 1), (2, None)])
    comp = brute_components(edges)
    assert {x["node"]: x["component"] for x in c.strong_components(df).collect() if x["node"] in comp} == comp
    got = [tuple(x["cycle"]) for x in c.cycles(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_cycles(edges, comp)


def test_a_ring_of_200_a_chain_and_nothing(spark):
    ring = [(k, (k + 1) % 200) for k in range(200)]
    chain = [(1000 - k, 999 - k) for k in range(60)]
    got = {x["node"]: x["component"] for x in c.strong_components(edges_of(spark, ring + chain)).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[n] == n for n in range(940, 1001))
    assert [list(x["cycle"]) for x in c.cycles(edges_of(spark, ring + chain)).collect()] == [[*range(200), 0]]
    assert c.cycles(edges_of(spark, [])).count() == 0
    assert c.strong_components(edges_of(spark, [(1, 1)])).collect() == [(1, 1)]


def test_every_edge_inside_a_component_of_the_orders_is_on_a_cycle(spark):
    rows = c.handover_cycles(spark, "/root/testdata/sf0.01").collect()
    edges = {tuple(r) for r in c.handovers(spark, "/root/testdata/sf0.01").collect()}
    comp = {r["node"]: r["component"] for r in c.component_sizes(spark, "/root/testdata/sf0.01").collect()}
    seen = set()
    for r in rows:
        nodes = [int(n) for n in r["cycle"].split(">")]
        steps = set(zip(nodes, nodes[1:]))
        assert len(nodes) - 1 == r["length"] == len(set(nodes)) and steps <= edges
        seen |= steps
    assert seen == {(u, v) for u, v in edges if comp[u] == comp[v]} and seen
