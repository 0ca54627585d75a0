import numpy as np
import pytest

from sylva.llm import clusters, posting
from sylva.operators.centroids import unit

D = 16


def data(seed=1, groups=12, noise=150):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=D)
        for _ in range(rng.integers(2, 25)):
            rows.append(centre / np.linalg.norm(centre) + rng.normal(size=D) * rng.uniform(0.01, 0.08))
    rows += list(rng.normal(size=(noise, D)))
    rows += [rows[0]] * 30  # copies
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


BAD = [(9001, None), (9002, []), (9003, [1.0] * (D - 1)), (9004, [float("nan")] * D), (9005, [0.0] * D), (9006, [float("inf")] + [1.0] * (D - 1)), (None, [1.0] * D)]


def brute_neighbours(rows, k, least):
    u = unit(np.array([v for _, v in rows])).astype("f8")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    found = {}
    for i in range(len(rows)):
        order = sorted((j for j in range(len(rows)) if j != i and s[i, j] >= least), key=lambda j: (-round(s[i, j], 12), j))
        found[i] = order[:k]
    return found, s


@pytest.mark.parametrize("small", [False, True])
def test_neighbours_equal_brute_force(spark, monkeypatch, small):
    if small:  # several lists and groups
        monkeypatch.setattr(posting, "LIST", 40)
        monkeypatch.setattr(posting, "GROUP", 100)
    rows = data()
    df = spark.createDataFrame(rows + rows[:20] + BAD, "key long, vector array<float>")
    got = posting.neighbours(df, 5, D, least=0.9).collect()
    want, s = brute_neighbours(rows, 5, 0.9)
    pairs = {(r.key, r.neighbour) for r in got}
    truth = {(a, b) for a, near in want.items() for b in near}
    assert len(got) == len(pairs) and all(abs(r.cosine - s[r.key, r.neighbour]) < 1e-6 for r in got)
    assert len(pairs & truth) >= 0.99 * len(truth) and len(pairs - truth) <= 0.01 * len(truth)
    assert posting.neighbours(df.limit(0), 5, D).collect() == []


def brute_sets(rows, label, least, smallest):
    _, s = brute_neighbours(rows, 1, 2)
    seen, found = set(), set()
    for i in range(len(rows)):
        if i in seen or label[i] is None:
            continue
        todo, part = [i], {i}
        while todo:
            a = todo.pop()
            for b in range(len(rows)):
                if b not in part and label[b] == label[i] and s[a, b] >= least:
                    part.add(b)
                    todo.append(b)
        seen |= part
        if len(part) >= smallest:
            found |= {(min(part), x) for x in part}
    return found


def test_sets(spark):
    rows = data(3)
    rng = np.random.default_rng(0)
    label = [[None, "a", " A", "b"][int(rng.choice(4, p=[0.1, 0.5, 0.2, 0.2]))] for _ in rows]
    plain = [x and x.strip().lower() for x in label]
    df = spark.createDataFrame([(k, label[k], v) for k, v in rows] + [(k, "a", v) for k, v in BAD], "key long, label string, vector array<float>")
    got = {(r.cluster_key, r.key) for r in clusters.sets(df, D).collect()}
    assert got == brute_sets(rows, plain, 0.85, 5)
    assert clusters.sets(df.limit(0), D).collect() == []


def brute_clusters(rows, label, least, samples, smallest):
    """Top-down over all pairs: a part loses its longest link, again and again; {key: (cluster, persistence)} and the forest's weight."""
    _, s = brute_neighbours(rows, 1, 2)
    n = len(rows)
    far = [sorted(1 - s[i, j] for j in range(n) if label[j] == label[i] is not None and s[i, j] >= least) for i in range(n)]
    core = [max(0.0, far[i][samples - 1]) if len(far[i]) >= samples else None for i in range(n)]
    links = sorted(
        (max(core[i], core[j], 1 - s[i, j]), i, j)
        for i in range(n) for j in range(i) if label[i] == label[j] is not None and s[i, j] >= least and None not in (core[i], core[j])
    )
    up, forest = list(range(n)), []

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for w, i, j in links:
        if root(i) != root(j):
            up[root(i)] = root(j)
            forest.append((max(w, 0.0), i, j))
    at = {}
    for e in forest:
        at.setdefault(root(e[1]), []).append(e)
    strength = lambda w: 1 / max(w, clusters.CLOSEST)

    def parts(edges, nodes):
        w, i, j = max(edges)
        rest, side = [e for e in edges if e != (w, i, j)], {i}
        while more := {y for _, a, b in rest for x, y in ((a, b), (b, a)) if x in side and y not in side}:
            side |= more
        return w, [([e for e in rest if (e[1] in p)], p) for p in (side, nodes - side)]

    def walk(edges, nodes, born):
        """The members of the best choice: (stability, {node: (cluster, leaves)}) of a part that begins at ``born``."""
        left, mine, inner, name = 0.0, {}, None, frozenset(nodes)
        while True:
            if not edges:
                left += sum(strength(0) - born for _ in nodes)
                mine |= {x: strength(0) for x in nodes}
                break
            w, ((e1, p1), (e2, p2)) = parts(edges, nodes)
            if min(len(p1), len(p2)) >= smallest:
                left += (strength(w) - born) * len(nodes)
                inner = [walk(e1, p1, strength(w)), walk(e2, p2, strength(w))]
                break
            gone = [p for p in (p1, p2) if len(p) < smallest]
            for p in gone:
                left += (strength(w) - born) * len(p)
                mine |= {x: strength(w) for x in p}
            if len(gone) == 2:
                break
            edges, nodes = (e1, p1) if len(p2) < smallest else (e2, p2)
        deep = {k: v for r in inner or () for k, v in r[2].items()}
        below = sum(r[0] for r in inner or ())
        if inner is None or left >= below:
            return left, {x: (min(name), v) for x, v in {**mine, **deep}.items()}, {**mine, **deep}
        return below, {k: v for r in inner for k, v in r[1].items()}, {**mine, **deep}

    result = {}
    for edges in at.values():
        nodes = {x for e in edges for x in e[1:]}
        if len(nodes) >= smallest:
            result |= walk(edges, nodes, 1 / (1 - least))[1]
    return {k: (c, 1 - 1 / v) for k, (c, v) in result.items()}, sum(e[0] for e in forest)


@pytest.mark.parametrize("piece", [100_000, 9])
def test_clusters_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(clusters, "PIECE", piece)
    rows = data(6, groups=16, noise=40)[:-30]  # without copies, so that no two merges are equal
    label = [[None, "a", " A", "b"][k % 7 % 4] for k, _ in rows]
    plain = [x and x.strip().lower() for x in label]
    df = spark.createDataFrame([(k, label[k], v) for k, v in rows] + [(k, "a", v) for k, v in BAD], "key long, label string, vector array<float>")
    found = clusters.clusters(df, D, least=0.6, samples=2).collect()
    want, _ = brute_clusters(rows, plain, 0.6, 2, 5)
    assert len({c for c, _ in want.values()}) > 4 and len(found) == len({r.key for r in found})
    by = {}
    for r in found:
        by.setdefault(r.cluster_key, []).append(r)
    for key, members in by.items():
        assert key == min(m.key for m in members) and all(m.size == len(members) >= 5 for m in members)
        assert sorted(m.key for m in members if m.exemplar) == sorted(sorted((-m.persistence, m.key) for m in members)[k][1] for k in range(3))
    parts = {}
    for k, (c, _) in want.items():
        parts.setdefault(c, set()).add(k)
    assert {frozenset(m.key for m in members) for members in by.values()} == set(map(frozenset, parts.values()))
    assert all(abs(r.persistence - want[r.key][1]) < 1e-5 for r in found)


def test_density_and_copies(spark, monkeypatch):
    rows = data(3)
    plain = [None if k % 9 == 0 else "ab"[k % 9 % 2] for k, _ in rows]
    df = spark.createDataFrame([(k, plain[k], v) for k, v in rows], "key long, label string, vector array<float>")
    _, edges = clusters.linked(df, D, 0.8, 5)
    _, tree = clusters.spanning_forest(edges)
    assert abs(sum(r.w for r in tree.collect()) - brute_clusters(rows, plain, 0.8, 5, 5)[1]) < 1e-5 * len(rows)
    once = {(r.cluster_key, r.key, r.size, round(r.persistence, 9), r.exemplar) for r in clusters.clusters(df, D, least=0.8).collect()}
    monkeypatch.setattr(clusters, "PIECE", 7)
    assert once and {(r.cluster_key, r.key, r.size, round(r.persistence, 9), r.exemplar) for r in clusters.clusters(df, D, least=0.8).collect()} == once
    assert clusters.clusters(df.limit(0), D).collect() == []


def test_overfull_lists_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(posting, "MOST", 2)
    monkeypatch.setattr(posting, "LIST", 25)
    rows = data()
    df = spark.createDataFrame(rows, "key long, vector array<float>")
    truth = {(a, b) for a, near in brute_neighbours(rows, 5, 0.9)[0].items() for b in near}
    got = {(r.key, r.neighbour) for r in posting.neighbours(df, 5, D, least=0.9).collect()}
    assert len(got & truth) >= 0.97 * len(truth)


def test_local_forest_equals_the_union():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    w = rng.integers(0, 5, 300) / 4
    ok = a != b
    a, b, w = a[ok], b[ok], w[ok]
    kept = clusters.local_forest(a, b, w, 40)
    total, parent = 0.0, list(range(40))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in np.argsort(w, kind="stable"):
        if root(a[k]) != root(b[k]):
            parent[root(a[k])] = root(b[k])
            total += w[k]
    assert np.isclose(w[kept].sum(), total)
    assert len(clusters.local_forest(a[:0], b[:0], w[:0], 3)) == 0
