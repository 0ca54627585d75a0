from collections import Counter

from sylva.operators import skew as S
from sylva.operators.spanning import spanning_forest


def test_overfull_and_stats(spark):
    rows = [(1, 2.0)] * 60 + [(2, None)] * 30 + [(3, float("nan"))] * 9 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "source_key long, weight double")
    assert [r[0] for r in S.overfull_keys(df, "source_key", 0.3).orderBy("key_value").collect()] == [1, 2]
    assert S.overfull_keys(df.limit(0), "source_key", 0.3).collect() == []
    got = {r.source_key: (r.n_edges, r.n_weights, r.weight_sum) for r in S.source_stats(df).collect()}
    assert got == {1: (60, 60, 120), 2: (30, 0, None), 3: (9, 0, None)}


def test_rollup_multiplies_counts(spark):
    edges = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (9, 1.0)], "source_key long, weight double")
    nodes = spark.createDataFrame([(1, 7), (1, 7), (2, None)], "node_key long, scope_id long")
    got = {r.scope_id: (r.n_edges, float(r.weight_sum)) for r in S.join_rollup(edges, nodes).collect()}
    assert got == {7: (4, 6.0), None: (1, 5.0)}


def test_weights_of_any_size_count(spark):
    rows = [(1, 2e12), (1, 5.0), (1, 1e-7), (1, float("inf")), (1, float("-inf")), (2, 1e300), (2, -1e300), (3, 2.5e-12)]
    edges = spark.createDataFrame(rows, "source_key long, weight double")
    got = {r.source_key: (r.n_edges, r.n_weights, r.weight_sum) for r in S.source_stats(edges).collect()}
    assert got[1][:2] == (5, 3) and abs(got[1][2] - 2000000000005.0000001) < 1e-3
    assert got[2] == (2, 2, 0.0) and got[3] == (1, 1, 2.5e-12)


def test_states_count_every_row_once(spark):
    edges = spark.createDataFrame([(1, 1.0)] * 6 + [(2, 1.0)] * 3 + [(None, 1.0)], "source_key long, weight double")
    nodes = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (3, 7), (None, 7), (4, None)], "node_key long, scope_id long")
    states = S.joined_states(edges, nodes)
    assert {tuple(r) for r in S.source_counts(states).collect()} == {(1, 6), (2, 3), (None, 1)}
    assert {tuple(r) for r in S.scope_counts(states).collect()} == {(7, 3), (8, 2), (None, 1)}
    assert [r[0] for r in S.overfull(S.source_counts(states), 0.59999).collect()] == [1]
    assert S.overfull(S.source_counts(states), 0.60001).collect() == []
    assert S.overfull(S.source_counts(S.joined_states(edges.limit(0), nodes.limit(0))), 0.1).collect() == []


def test_lists_are_chunked_and_whole(spark):
    pairs = [(1, k) for k in range(500)] + [(2, k) for k in range(3)] + [(k, 1) for k in range(100, 140)]
    rows = S.neighbour_lists(spark.createDataFrame(pairs, "key_value long, neighbour long"), chunk=50).collect()
    assert Counter((r.key_value, x) for r in rows for x in r.neighbours) == Counter(pairs)
    assert max(r.n for r in rows) < 120 and all(r.neighbours == sorted(r.neighbours) for r in rows)


def test_spanning_forest(spark):
    edges = [(1, 2, 3.0), (2, 3, 1.0), (1, 3, 2.0), (3, 1, 2.0), (5, 6, 1.0), (7, 7, 0.0), (6, 8, 1.0), (8, 5, 1.0), (None, 1, 0.0)]
    labels, tree = spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"))
    assert {r.node: r.component for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 5}
    assert sorted(tuple(r) for r in tree.distinct().collect()) == [(1, 3, 2.0), (2, 3, 1.0), (5, 6, 1.0), (5, 8, 1.0)]
    labels, tree = spanning_forest(spark.createDataFrame([], "a long, b long, w double"))
    assert labels.collect() == [] and tree.collect() == []


def test_long_chain_is_one_component(spark):
    chain = [(k, k + 1, float(k % 7)) for k in range(200)]
    labels, tree = spanning_forest(spark.createDataFrame(chain, "a long, b long, w double"))
    assert {r.component for r in labels.collect()} == {0} and tree.distinct().count() == 200
