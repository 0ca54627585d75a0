import random

import pytest

from sylva.operators import hierarchy as H


def reachable(links):
    down = {}
    for p, c in links:
        down.setdefault(p, set()).add(c)
    result = {}
    for start in {x for link in links for x in link}:
        seen, todo = set(), list(down.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += down.get(n, ())
        result[start] = seen
    return result


def brute_cycles(links):
    reach = reachable(links)
    return {(min(y for y in reach[x] if x in reach[y]), x) for x in reach if x in reach[x]}


def frame(spark, links):
    return spark.createDataFrame(links, "parent long, child long")


CASES = {
    "empty": [],
    "self": [(1, 1), (1, 2)],
    "pair": [(1, 2), (2, 1), (2, 3)],
    "tail": [(0, 1), (1, 2), (2, 3), (3, 1), (3, 4), (4, 5)],
    "two cycles sharing a node": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)],
    "branching core": [(a, b) for a in range(1, 6) for b in range(1, 6) if a != b] + [(5, 6), (6, 7), (7, 6)],
    "long": [(k, k + 1) for k in range(60)] + [(60, 0)],
    "repeated": [(1, 2), (1, 2), (2, 1)],
    # side by side: a ring linked both ways, a thick ring, two dense cores with links between them, a directed torus
    "cores": [(k, (k + 1) % 40) for k in range(40)] + [((k + 1) % 40, k) for k in range(40)] + [(7, 50), (50, 51)]
    + [(100 + k, 100 + (k + j) % 60) for k in range(60) for j in (1, 2)]
    + [(a, b) for base in (200, 220) for a in range(base, base + 6) for b in range(base, base + 6) if (b - a) % 6 in (1, 2)] + [(202, 221), (203, 222)]
    + [(300 + 6 * r + c, 300 + x) for r in range(6) for c in range(6) for x in (6 * r + (c + 1) % 6, 6 * ((r + 1) % 6) + c)],
}


@pytest.mark.parametrize("name", CASES)
def test_cycles(spark, name):
    found = H.cycle_members(frame(spark, CASES[name])).collect()
    assert sorted((r.cycle_key, r.node_key) for r in found) == sorted(brute_cycles(CASES[name]))


def test_cycles_of_random_graphs(spark):
    rng = random.Random(5)
    links = []
    for base in range(0, 400, 20):  # twenty graphs side by side
        links += [(base + rng.randrange(12), base + rng.randrange(12)) for _ in range(rng.randrange(4, 22))]
    found = H.cycle_members(frame(spark, links)).collect()
    assert {(r.cycle_key, r.node_key) for r in found} == brute_cycles(links)
    assert len(found) == len(brute_cycles(links))


def test_hierarchy_paths(spark):
    rng = random.Random(3)
    parent = {k: rng.randrange(max(0, k - 4), k) for k in range(1, 80) if k not in (30, 55)}
    links = [(p, c) for c, p in parent.items()] + [(200, 201), (201, 200), (201, 202), (202, 203)] + [(79, 5)]
    keys = spark.createDataFrame([(k,) for k in [*range(80), 200, 201, 202, 203, 300]], "node_key long")
    rows = {r.node_key: r for r in H.hierarchy(keys, frame(spark, links)).collect()}
    assert len(rows) == 85
    for k in range(80):
        path = [k]
        while path[0] in parent:
            path.insert(0, parent[path[0]])
        assert rows[k].path == path and rows[k].depth == len(path) - 1 and rows[k].root_key == path[0]
    assert rows[300].path == [300] and rows[300].parent_key is None
    assert [rows[k].status for k in (200, 201, 202, 203)] == ["cycle", "cycle", "below_cycle", "below_cycle"]
    assert rows[203].path is None


def test_descendants_over_all_links(spark):
    rng = random.Random(8)
    links = [(rng.randrange(max(0, k - 6), k), k) for k in range(1, 60)]
    links += [(rng.randrange(0, 40), rng.randrange(40, 60)) for _ in range(14)] + [(3, 3), (100, 101), (101, 100), (101, 102)]
    want = brute_distances(links)
    keys = spark.createDataFrame([(k,) for k in [*range(60), 100, 101, 102]], "node_key long")
    rows = H.descendants(keys, frame(spark, links)).collect()
    assert len(rows) == len(want) and {(r.node_key, r.descendant_key): r.distance for r in rows} == want
    assert H.descendants(keys, frame(spark, [])).collect() == []


def test_cycle_status_follows_all_links(spark):
    links = [(1, 2), (2, 5), (5, 6), (6, 5), (6, 7)]  # 5 hangs under 2, and reaches itself through its other parent 6
    keys = spark.createDataFrame([(k,) for k in (1, 2, 5, 6, 7)], "node_key long")
    rows = {r.node_key: r for r in H.hierarchy(keys, frame(spark, links)).collect()}
    assert {k: r.status for k, r in rows.items()} == {1: "ok", 2: "ok", 5: "cycle", 6: "cycle", 7: "ok"}
    assert rows[5].path == [1, 2, 5] and rows[7].path == [1, 2, 5, 6, 7] and rows[7].depth == 4


def brute_distances(links):
    down, want = {}, {}
    for p, c in links:
        down.setdefault(p, set()).add(c)
    for start in down:
        level, d, seen = {start}, 0, set()
        while level:
            d += 1
            level = {c for p in level for c in down.get(p, ())} - seen
            seen |= level
            want |= {(start, c): d for c in level}
    return want


@pytest.mark.parametrize("name", ["self", "tail", "two cycles sharing a node", "branching core", "random"])
def test_descendants_through_cycles(spark, name):
    rng = random.Random(11)
    links = CASES.get(name) or [(rng.randrange(50), rng.randrange(50)) for _ in range(58)] + [(60, 0), (0, 61), (61, 60)]
    keys = spark.createDataFrame([(k,) for k in {x for link in links for x in link}], "node_key long")
    rows = H.descendants(keys, frame(spark, links)).collect()
    want = brute_distances(links)
    assert len(rows) == len(want) and {(r.node_key, r.descendant_key): r.distance for r in rows} == want


def test_links_tidy_relationships(spark):
    edges = spark.createDataFrame(
        [(1, 2, " Contains", "x"), (3, 1, "PART_OF ", "x"), (1, 9, "contains", "x"), (None, 2, "contains", "x"), (1, 2, None, "x"), (1, 3, "calls", "x")],
        "source_key long, target_key long, relationship string, node_key string",
    )
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "node_key long")
    found = {(r.parent, r.child) for r in H.containment_links(edges, keys).collect()}
    assert found == {(1, 2), (1, 3)}


def test_rounds_of_rings_do_not_follow_their_length(spark, monkeypatch):
    monkeypatch.setattr(H, "_colour", None)  # would be called for a core that merging does not shrink
    links = [(k, (k + 1) % 100) for k in range(100)] + [((k + 1) % 100, k) for k in range(100)]
    found = H.cycle_members(frame(spark, links)).collect()
    assert {(r.cycle_key, r.node_key) for r in found} == {(0, k) for k in range(100)}
