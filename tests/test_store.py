import json
import os
import random
from collections import deque

import pytest

from sylva import model as M
from sylva.operators.traverse import traverse
from sylva.store import Store, StoreBuilder


def node(i, scope=None, attributes="{}", name=None, kind="function"):
    return (f"node-{i}", scope, kind, name or f"n{i}", "", attributes)


def one_hot(i, n=8):
    return [1.0 if k == i % n else 0.0 for k in range(n)]


@pytest.fixture
def store(spark, tmp_path):
    with StoreBuilder(str(tmp_path / "s"), 8).node_attribute_indexes(["$.g"]).build(spark) as s:
        yield s


def test_life_of_a_store(spark, store):
    assert store.generation() == 0 and store.node_count() == 0
    a = store.get_or_create_scope("a").first()["id"]
    assert store.get_or_create_scope("a").first()["id"] == a and store.generation() == 0
    receipt = store.apply_batch(
        M.WriteBatch(
            nodes=[node(0, a, '{"g":1,"n":null}'), node(1, a), node(2)],
            edges=[("e1", "node-0", "node-1", "calls", 1.0, "{}"), ("e2", "node-1", "node-1", "calls", 1.0, "{}")],
            embeddings=[(f"node-{i}", one_hot(i)) for i in range(3)],
            catalog=[("alpha", "b", "1"), ("alpha", "a", '"x"')],
        )
    )
    assert receipt.generation == 1 and receipt.index_ready
    assert [r.id for r in store.list_nodes(limit=2).collect()] == ["node-0", "node-1"]
    assert [r.id for r in store.get_nodes(["node-2", "no", "node-0"]).collect()] == ["node-2", "node-0"]
    assert [r.id for r in store.find_nodes_by_attribute("$.g", True).collect()] == ["node-0"]
    assert [r.id for r in store.get_edges("node-1").collect()] == ["e1", "e2"]
    assert [r.id for r in store.traverse("node-0", max_hops=3).collect()] == ["node-1"]
    assert [r.record_key for r in store.catalog_list("alpha").collect()] == ["a", "b"]
    # merge: a null scope keeps the scope, attributes are patched, null members go
    store.apply_batch(M.WriteBatch(nodes=[("node-0", None, "class", "x", "", '{"h":2,"n":null}')]))
    row = store.get_node("node-0").first()
    assert row.scope_id == a and row.kind == "class" and json.loads(row.attributes) == {"g": 1, "h": 2}
    hits = store.search(one_hot(1), 2)
    assert hits.backend is M.Backend.EXACT and hits.hits.first()["id"] == "node-1"
    near = store.search(one_hot(1), 1, backend=M.Backend.APPROXIMATE)
    assert near.backend is M.Backend.APPROXIMATE and near.hits.first()["id"] == "node-1"
    assert store.verify_integrity().is_healthy
    gone = store.delete_nodes(["node-1", "unknown"])
    assert gone.deleted == 1 and store.stats().edges == 0 and store.embedding_count() == 2
    assert store.delete_nodes(["unknown"]).deleted == 0 and store.generation() == 3
    assert store.clear_embeddings() == 2 and store.clear_embeddings() == 0 and store.generation() == 4
    assert store.vacuum() > 0 and store.node_count() == 2
    assert store.truncate() == 2 and store.generation() == 5 and store.node_count() == 0


def test_rejected_batches_change_nothing(spark, store):
    a, b = (store.get_or_create_scope(k).first()["id"] for k in "ab")
    store.apply_batch(M.WriteBatch(nodes=[node(0, a), node(1, a), node(2, b)], edges=[("e", "node-0", "node-1", "r", 1.0, "{}")]))
    bad = [
        M.WriteBatch(),
        M.WriteBatch(nodes=[node(5), node(5)]),
        M.WriteBatch(nodes=[node(5, None, "[1]")]),
        M.WriteBatch(edges=[("x", "node-0", "node-2", "r", 1.0, "{}")]),
        M.WriteBatch(edges=[("x", "node-0", "nobody", "r", 1.0, "{}")]),
        M.WriteBatch(edges=[("x", "node-0", "node-1", "r", float("nan"), "{}")]),
        M.WriteBatch(nodes=[node(0, b)]),
        M.WriteBatch(embeddings=[("node-0", [1.0])]),
        M.WriteBatch(embeddings=[("node-0", [float("inf")] * 8)]),
        M.WriteBatch(catalog=[("n", " ", "1")]),
        M.WriteBatch(catalog=[("n", "k", "1")], catalog_deletes=[("n", "k")]),
    ]
    for batch in bad:
        with pytest.raises(M.InvalidInput):
            store.apply_batch(batch)
    for batch in (M.WriteBatch(nodes=[node(9, 99)]), M.WriteBatch(edges=[("e", "node-1", "node-0", "r", 1.0, "{}")])):
        with pytest.raises(M.ConstraintViolation):
            store.apply_batch(batch)
    assert store.generation() == 1 and store.stats().nodes == 3
    store.apply_batch(M.WriteBatch(nodes=[node(0, b), node(1, b)]))  # both ends move together
    # an id that the batch frees first may be used again
    store.apply_batch(M.WriteBatch(edges=[("e9", "node-0", "node-1", "r", 2.0, '{"k":1}'), ("e", "node-1", "node-0", "r", 1.0, "{}")]))
    assert sorted(r.id for r in store.get_edges("node-0").collect()) == ["e", "e9"]


def test_many_commits_keep_few_segments(spark, tmp_path):
    with StoreBuilder(str(tmp_path / "s"), 8).durability(M.Durability.NORMAL).build(spark) as s:
        want = {}
        for turn in range(6):
            rows = [(f"node-{k}", None, "k", f"{turn}", "", "{}") for k in range(turn, turn + 4)]
            s.apply_batch(M.WriteBatch(nodes=rows, embeddings=[(r[0], one_hot(turn + k)) for k, r in enumerate(rows)]))
            want |= {r[0]: f"{turn}" for r in rows}
            if turn == 3:
                s.delete_nodes(["node-1", "node-5"])
                want = {k: v for k, v in want.items() if k not in ("node-1", "node-5")}
        nodes = s._table("nodes").collect()
        assert {r.id: r.name for r in nodes} == want and len({r.node_key for r in nodes}) == len(nodes) == s.embedding_count()
        manifest = s._manifest()
        assert all(len(x) <= 3 for x in manifest["tables"].values()) and len(manifest["index"]["cells"]) <= 3
        assert sorted(r.node_key for r in s._index_parts(manifest)[1].collect()) == sorted(r.node_key for r in nodes)
        assert s.search(one_hot(3), 1, backend=M.Backend.APPROXIMATE).hits.first()["id"] == "node-3"
        assert s.vacuum() > 0 and s.verify_integrity().is_healthy


def test_lock_read_only_and_formats(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(M.StorageError):
        StoreBuilder(path, 8).read_only().build(spark)
    first = Store.open(spark, path, 8)
    with pytest.raises(M.WriterLocked):
        Store.open(spark, path, 8)
    reader = StoreBuilder(path, 8).read_only().build(spark)
    with pytest.raises(M.ReadOnly):
        reader.truncate()
    first.apply_batch(M.WriteBatch(nodes=[node(1)]))
    assert reader.node_count() == 1 and reader.is_read_only
    first.close()
    with pytest.raises(M.InvalidInput):
        Store.open(spark, path, 4)
    manifest = os.path.join(path, "manifest.json")
    state = json.load(open(manifest))
    for version, writable, read_only in ((99, M.UnsupportedFormat, M.UnsupportedFormat), (1, M.ReindexRequired, M.UnsupportedFormat)):
        json.dump(state | {"format_version": version}, open(manifest, "w"))
        with pytest.raises(writable):
            Store.open(spark, path, 8)
        with pytest.raises(read_only):
            StoreBuilder(path, 8).read_only().build(spark)


def test_killed_writer_leaves_a_whole_generation(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store.open(spark, path, 8) as s:
        s.apply_batch(M.WriteBatch(nodes=[node(0)]))
        manifest = s._manifest()
        # what a dead writer leaves: a staged table that no manifest names
        os.makedirs(os.path.join(path, "nodes-2-dead"))
    with Store.open(spark, path, 8) as s:
        assert s.generation() == 1 and s.node_count() == 1 and s._manifest()["tables"] == manifest["tables"]
        s.vacuum()
        assert not os.path.exists(os.path.join(path, "nodes-2-dead"))


def test_search_falls_back_when_the_index_is_lost(spark, tmp_path):
    with StoreBuilder(str(tmp_path / "s"), 8).exact_search_threshold(0).build(spark) as s:
        s.apply_batch(M.WriteBatch(nodes=[node(i) for i in range(4)], embeddings=[(f"node-{i}", one_hot(i)) for i in range(4)]))
        assert s.search(one_hot(2), 1).backend is M.Backend.APPROXIMATE
        s._publish(s._manifest() | {"index": None})
        assert s.search(one_hot(2), 1).backend is M.Backend.EXACT
        assert not s.verify_integrity().is_healthy and not s.verify_integrity().issues
        s.repair_index()
        assert s.verify_integrity().is_healthy
        for bad in ([0.0] * 8, [1.0], [float("nan")] * 8):
            with pytest.raises(M.InvalidInput):
                s.search(bad, 1)


def queue_order(edges, scope, start, hops, most):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, found, todo = {start}, [], deque([(start, 0)])
    while todo:
        n, d = todo.popleft()
        if d == hops:
            continue
        for m in sorted(out.get(n, [])):
            if m in seen:
                continue
            seen.add(m)
            if scope[m] != scope[start]:
                continue
            found.append(m)
            if len(found) == most:
                return found
            todo.append((m, d + 1))
    return found


def test_traversal_order_of_random_graphs(spark):
    rng = random.Random(1)
    for most in (4, 100):
        scope = {k: rng.choice([None, 1, 1, 1]) for k in range(14)}
        edges = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(40)})
        nodes = spark.createDataFrame([(k, f"n{k}", scope[k]) for k in scope], "node_key long, id string, scope_id long")
        links = spark.createDataFrame([(a, b, "r") for a, b in edges], "source_key long, target_key long, relationship string")
        got = [r.node_key for r in traverse(nodes, links, "n3", M.Direction.OUT, None, 3, most).collect()]
        assert got == queue_order(edges, scope, 3, 3, most)
    assert traverse(nodes, links, "unknown", M.Direction.OUT, None, 0, 5).collect() == []
    with pytest.raises(M.InvalidInput):
        traverse(nodes, links, "unknown", M.Direction.OUT, None, 1, 5)


def test_hostile_names(spark, store):
    store.apply_batch(M.WriteBatch(nodes=[node(0, name=r"a\path%_x"), node(1, name="ÄB plain")]))
    for text, want in ((r"\PATH", ["node-0"]), ("%_", ["node-0"]), ("äb", []), ("Äb", ["node-1"]), ("_p", [])):
        assert [r.id for r in store.find_nodes_by_name(text).collect()] == want
    with pytest.raises(M.InvalidInput):
        store.find_nodes_by_name("  ")
    with pytest.raises(M.InvalidInput):
        store.list_nodes(limit=0)
