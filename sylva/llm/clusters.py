"""Hierarchical density clustering of vectors within labels.

1. Neighbour graph: pairs of one label at or above the least cosine that share a posting list (``posting``). The core
   distance of a vector is that to its ``samples``-th nearest key, itself included; an edge weighs the mutual
   reachability of its ends, the greatest of its length and of their core distances. With two samples no end of an
   edge is farther from its nearest neighbour than from the other end, so the weight is the length, and the pass that
   would find core distances is left out.
2. Each list and each group keeps only the minimum spanning forest of its edges, which loses no edge of the whole
   forest, so a dense set of n vectors hands on fewer than n edges instead of n squared.
3. Distributed Boruvka rounds join the forests into one (``spanning``).
4. ``sets`` cuts the hierarchy for two samples at the least cosine. ``clusters`` condenses the tree of all merges, selects
   clusters by stability and names their most persistent members. Trees are condensed in tasks; one with more than
   ``PIECE`` edges is cut by weight into pieces first, whose results are joined, so no task holds an unbounded tree.

Equal vectors of one label are one class until the end, so copies cost nothing; sizes count all keys.

Defined cases: as in ``posting``; vectors without a label or a key are in no result; labels are compared without outer blanks
and case; merges of equal weight go by a hash of their ends; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylva.llm import posting
from sylva.operators.spanning import spanning_forest
from sylva.runtime import Scratch, is_empty, release

#: Edges of a tree that is condensed in one task, at most; also about the edges of one task.
PIECE = 100_000
#: Distances below this count as this where strength is one over distance.
CLOSEST = 1e-3
#: Stabilities that differ by no more than this share of a cluster's strength are equal, whatever the order of sums.
EVEN = 1e-9


def local_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges of a minimum spanning forest over nodes 0 ... n - 1; equal weights go by their ends."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    a, b = a[order], b[order]
    left, component, kept = np.arange(len(order)), np.arange(n), []
    while True:
        x, y = component[a[left]], component[b[left]]
        open_ = x != y
        left, x, y = left[open_], x[open_], y[open_]
        if not len(left):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        has = np.flatnonzero(best < len(order))
        edge = best[has]
        kept.append(np.unique(edge))
        pointer = np.arange(n)
        u, v = component[a[edge]], component[b[edge]]
        pointer[has] = np.where(u == has, v, u)
        mutual = has[(pointer[pointer[has]] == has) & (has < pointer[has])]
        pointer[mutual] = mutual
        while True:
            ahead = pointer[pointer]
            if (ahead == pointer).all():
                break
            pointer = ahead
        component = pointer[component]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def linked(vectors: DataFrame, dimensions: int, least: float, samples: int = 2) -> tuple[DataFrame, DataFrame]:
    """``key, class`` of all labelled vectors, and forest edges ``a, b, w`` between classes, w the mutual reachability by cosine distance."""
    scratch = Scratch(vectors.sparkSession, "linked")
    tidy = F.lower(F.regexp_replace("label", r"^\s+|\s+$", ""))
    labelled = vectors.where("label is not null and key is not null").withColumn("label", F.xxhash64(tidy))
    valid = scratch.save(labelled.where(posting.is_valid("vector", dimensions) & ~posting.is_zero("vector")).select("key", "vector", "label"), "valid")
    lists = posting.fit_lists(valid, dimensions)
    placed = posting.place(valid, lists, dimensions, 1, "label")
    dense = samples > 2
    if dense:
        near = scratch.save(posting.nearest_keys(valid, lists, dimensions, samples, least, "label"), "near")
        release(vectors.sparkSession)
        # Vectors with fewer than ``samples`` keys in reach have no edges.
        core = near.where(F.size("best") >= samples).select("class", (F.element_at("best", samples)["d"] + 1).alias("core"))
        named = valid.withColumn("class", F.xxhash64("vector", "label")).join(core, "class")
        placed = posting.place(named, lists, dimensions, 1, "label", "core")

    def search(table):
        import pyarrow as pa

        held = posting.Held.of(table, dimensions, 1)
        wide = held.vectors.astype(np.float64)
        wide /= np.sqrt((wide**2).sum(1, keepdims=True))
        n, parts, waiting, size = len(wide), [], [], 0
        core = np.zeros(n)
        if dense:
            core[np.searchsorted(held.name, table.column("class").to_numpy())] = table.column("extra").to_numpy()

        def reach(a, b, s):
            return np.maximum(np.maximum(core[a], core[b]), np.maximum(1 - s, 0))

        def reduce(rows):
            a, b, s = (np.concatenate(x) for x in zip(*rows))
            kept = local_forest(a, b, reach(a, b, s), n)
            return a[kept], b[kept], s[kept]

        for q, m in held.blocks():
            near = held.vectors[q] @ held.vectors[m].T
            near[held.label[q][:, None] != held.label[m][None, :]] = -2
            r, c = np.nonzero(near >= least - 1e-5)
            a, b, s = q[r], m[c], near[r, c].astype(np.float64)
            edge = np.flatnonzero(s < least + 1e-5)
            if len(edge):
                s[edge] = np.einsum("ij,ij->i", wide[a[edge]], wide[b[edge]])
            ok = (a != b) & (s >= least)
            waiting.append((a[ok], b[ok], s[ok]))
            size += int(ok.sum())
            if size > 1_000_000:
                parts.append(reduce(waiting))
                waiting, size = [], 0
        if waiting:
            parts.append(reduce(waiting))
        if parts:
            a, b, _ = reduce(parts)
        else:
            a = b = np.zeros(0, np.int64)
        w = reach(a, b, np.einsum("ij,ij->i", wide[a], wide[b]))
        return pa.Table.from_arrays([pa.array(held.name[a]), pa.array(held.name[b]), pa.array(w)], ["a", "b", "w"])

    found = posting.grouped(placed, lists).applyInArrow(search, "a long, b long, w double")
    edges = scratch.save(found, "edges")
    keys = scratch.save(valid.select("key", F.xxhash64("vector", "label").alias("class")).distinct(), "keys")
    scratch.drop("valid", "near")
    release(vectors.sparkSession)
    return keys, edges


def _sized(keys: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """``key, class, component`` of the keys whose component has at least ``least`` keys."""
    named = keys.join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
    large = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).where(F.col("n") >= least)
    return named.join(large.select("component", "first", "n"), "component")


def sets(vectors: DataFrame, dimensions: int, least: float = 0.85, smallest: int = 5) -> DataFrame:
    """``cluster_key, key`` of ``key, label, vector`` rows: the hierarchy for two samples cut at ``least``."""
    keys, edges = linked(vectors, dimensions, least)
    labels, _ = spanning_forest(edges)
    return _sized(keys, labels, smallest).select(F.col("first").alias("cluster_key"), "key")


_CONDENSED = "kind int, id long, c long, lambda double, acc double, size long, parent long, next long"
_FINAL, _POINT, _WAITING, _SEGMENT = 0, 1, 2, 3


def condense(table, smallest: int, birth: float):
    """The condensed tree of the pieces in ``table`` (piece, whole, top, a, b, na, nb, sa, sb, w, h), merges in order of weight.

    A piece is a tree of merges; ``a`` and ``b`` are classes, or (``sa``, ``sb``) pieces further down that count as one
    node. Whole components are finished here: their points come with the cluster that is selected. Of other pieces come
    segments of clusters, points with their segment, and what waits for the piece above.
    """
    import pyarrow as pa

    col = {c: table.column(c).to_numpy() for c in ("piece", "a", "b", "na", "nb", "w", "h")}
    flag = {c: np.array(table.column(c).to_pylist(), bool) for c in ("whole", "top", "sa", "sb")}
    order = np.lexsort((col["h"], col["w"]))
    nodes, both = np.unique(np.concatenate([col["a"], col["b"]]), return_inverse=True)
    n, m = len(nodes), len(order)
    size, inner = np.zeros(n, np.int64), np.zeros(n, bool)
    whole, top = np.zeros(n, bool), np.zeros(n, bool)
    for at, sizes, subs in ((both[:m], col["na"], flag["sa"]), (both[m:], col["nb"], flag["sb"])):
        size[at], inner[at], whole[at], top[at] = sizes, subs, flag["whole"], flag["top"]
    size, parent, cluster = size.tolist(), list(range(n)), [-1] * n
    waiting: list[list[int]] = [[k] for k in range(n)]
    name, acc, held, up, born, points = [], [], [], [], [], []
    root_name = nodes.tolist()

    def new(id_: int, acc_: float, size_: int) -> int:
        name.append(id_), acc.append(acc_), held.append(size_), up.append(-1), born.append(None)
        return len(name) - 1

    for k in range(n):
        if size[k] >= smallest:  # copies alone make a cluster; a piece further down goes on as the one it has become
            cluster[k] = new(~int(nodes[k]) if inner[k] else int(nodes[k]), 0.0 if inner[k] else size[k] / CLOSEST, size[k])
            if not inner[k]:
                points.append((k, cluster[k], 1 / CLOSEST))
            waiting[k] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = both[:m][order].tolist(), both[m:][order].tolist()
    for x, y, w, h in zip(a, b, col["w"][order].tolist(), col["h"][order].tolist()):
        x, y = root(x), root(y)
        strength, total = 1 / max(w, CLOSEST), size[x] + size[y]
        one, two = cluster[x], cluster[y]
        if one >= 0 and two >= 0:
            c = new(h, total * strength, total)
            up[one] = up[two] = c
            born[one] = born[two] = strength
        elif one < 0 and two < 0 and total < smallest:
            c = -1
        elif one < 0 and two < 0:
            c = new(h, total * strength, total)
            points += [(k, c, strength) for k in waiting[x] + waiting[y]]
        else:
            c, small = (one, y) if one >= 0 else (two, x)
            acc[c] += size[small] * strength
            held[c] = total
            points += [(k, c, strength) for k in waiting[small]]
        if size[x] < size[y]:
            x, y = y, x
        parent[y] = x
        size[x], cluster[x], root_name[x] = total, c, h
        waiting[x] = waiting[x] + waiting[y] if c < 0 else []
        waiting[y] = []

    after, complete, out = [None] * len(name), [False] * len(name), []
    for x in range(n):
        if parent[x] != x:
            continue
        c = cluster[x]
        if c >= 0 and top[x]:
            born[c] = birth
            complete[c] = bool(whole[x])
        elif c >= 0:
            after[c] = ~root_name[x]  # its last merge may have its name already
        elif not top[x]:
            out += [(_WAITING, int(nodes[k]), None, None, None, None, None, root_name[x]) for k in waiting[x]]
    # Children stand before parents: the better of a cluster and of its children together, then the first from above.
    best, below = [0.0] * len(name), [0.0] * len(name)
    chosen = [-1] * len(name)
    for c in range(len(name)):
        if born[c] is not None:
            own = acc[c] - held[c] * born[c]
            chosen[c] = c if own >= below[c] - EVEN * acc[c] else -1
            best[c] = max(own, below[c])
            if up[c] >= 0:
                below[up[c]] += best[c]
    for c in range(len(name) - 1, -1, -1):
        if up[c] >= 0:
            complete[c] = complete[up[c]]
            if chosen[up[c]] >= 0:
                chosen[c] = chosen[up[c]]
    for k, c, strength in points:
        if not complete[c]:
            out.append((_POINT, int(nodes[k]), name[c], strength, None, None, None, None))
        elif chosen[c] >= 0:
            out.append((_FINAL, int(nodes[k]), name[chosen[c]], strength, None, None, None, None))
    for c in range(len(name)):
        if not complete[c]:
            out.append((_SEGMENT, name[c], None, born[c], acc[c], held[c], name[up[c]] if up[c] >= 0 else None, after[c]))
    cols = list(zip(*out)) or [()] * 8
    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["kind", "id", "c", "lambda", "acc", "size", "parent", "next"])


def _pieces(scratch: Scratch, tree: DataFrame, labels: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """The forest's edges in pieces of at most ``PIECE``, and the number of levels below the top.

    A larger tree is cut at a middle weight: the parts that its lighter edges join become pieces of their own, and
    each of them is one node of the piece that its heavier edges make. Equal weights are ordered by a hash.
    """
    ends = lambda c, n: sizes.select(F.col("class").alias(c), F.col("n").alias(n))
    rows = tree.join(labels.select(F.col("node").alias("a"), F.col("component").alias("piece")), "a").join(ends("a", "na"), "a").join(ends("b", "nb"), "b")
    no, yes = F.lit(False), F.lit(True)
    columns = ["piece", "whole", "top", "a", "b", "na", "nb", "sa", "sb", "w", "h"]
    rows = rows.select("piece", yes.alias("whole"), yes.alias("top"), "a", "b", "na", "nb", no.alias("sa"), no.alias("sb"), "w", F.xxhash64("a", "b").alias("h"))
    rows, done, level = scratch.save(rows, "pieces0"), None, 0
    while True:
        about = rows.groupBy("piece").agg(
            F.count(F.lit(1)).alias("edges"), F.min("w").alias("w0"), F.max("w").alias("w1"), F.percentile_approx("w", 0.5).alias("wm"),
            F.max("h").alias("h1"), F.percentile_approx("h", 0.5).alias("hm"),
        ).where(F.col("edges") > PIECE)
        about = scratch.save(about, f"large{level}")
        if is_empty(about):
            return (rows if done is None else done.union(rows)), level
        rest = rows.join(about.select("piece"), "piece", "left_anti").select(*columns)
        done = rest if done is None else done.union(rest)
        by_w = F.when(F.col("wm") < F.col("w1"), F.col("w") <= F.col("wm")).otherwise(F.col("w") < F.col("w1"))
        by_h = F.when(F.col("hm") < F.col("h1"), F.col("h") <= F.col("hm")).otherwise(F.col("h") < F.col("h1"))
        cut = rows.join(about, "piece").withColumn("light", F.when(F.col("w0") < F.col("w1"), by_w).otherwise(by_h))
        cut = scratch.save(cut.withColumn("whole", no).select(*columns, "light"), f"cut{level}")
        light, heavy = cut.where("light"), cut.where("not light")
        parts, _ = spanning_forest(light.select("a", "b", F.lit(0).alias("w")))
        of = light.join(parts.withColumnRenamed("node", "a"), "a")
        roots = of.groupBy("component").agg(F.max(F.struct("w", "h"))["h"].alias("root"))
        held = light.select(F.col("a").alias("node"), F.col("na").alias("n")).union(light.select("b", "nb")).distinct()
        roots = roots.join(held.join(parts, "node").groupBy("component").agg(F.sum("n").alias("n")), "component")
        named = scratch.save(parts.join(roots, "component").select("node", "root", "n"), f"named{level}")
        lower = light.join(named.select(F.col("node").alias("a"), "root"), "a").select(
            F.col("root").alias("piece"), "whole", no.alias("top"), "a", "b", "na", "nb", "sa", "sb", "w", "h"
        )
        for side in ("a", "b"):
            heavy = heavy.join(named.select(F.col("node").alias(side), "root", "n"), side, "left").withColumns(
                {f"s{side}": F.col(f"s{side}") | F.col("root").isNotNull(), f"n{side}": F.coalesce("n", f"n{side}"), side: F.coalesce("root", side)}
            ).select(*columns)
        level += 1
        rows = scratch.save(lower.union(heavy), f"pieces{level}")


def _joined(scratch: Scratch, found: DataFrame, levels: int) -> DataFrame:
    """``id, c, lambda`` of the points of components that came in several pieces, with the clusters selected there."""
    part = lambda kind: found.where(F.col("kind") == kind)
    segments = part(_SEGMENT)
    last = segments.select("id", F.coalesce("next", "id").alias("to"))
    for k in range(levels):  # a cluster goes on through one piece a level at most
        ahead = last.select(F.col("id").alias("to"), F.col("to").alias("end"))
        last = scratch.save(last.join(ahead, "to").select("id", F.col("end").alias("to")), f"last{k}")
    tree = segments.join(last, "id").groupBy("to").agg(
        F.sum("acc").alias("acc"), F.max("size").alias("size"), F.max("parent").alias("parent"), F.max("lambda").alias("birth")
    )
    tree = tree.join(last.select(F.col("id").alias("parent"), F.col("to").alias("up")), "parent", "left").select(
        F.col("to").alias("c"), "up", (F.col("acc") - F.col("size") * F.col("birth")).alias("own"), (F.col("acc") * EVEN).alias("slack")
    )
    left = scratch.save(tree.withColumn("below", F.lit(0.0)), "tree")
    chosen, turn = None, 0
    while not is_empty(left):  # leaves hand the better of themselves and of what was below them on to their parents
        inner = left.where("up is not null").select(F.col("up").alias("c")).distinct()
        leaves = scratch.save(left.join(inner, "c", "left_anti").select("c", "up", "own", "slack", "below"), f"leaves{turn}")
        given = leaves.where("up is not null").groupBy(F.col("up").alias("c")).agg(F.sum(F.greatest("own", "below")).alias("more"))
        left = left.join(leaves.select("c"), "c", "left_anti").join(given, "c", "left")
        turn += 1
        left = scratch.save(left.select("c", "up", "own", "slack", (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below")), f"left{turn}")
        mark = leaves.select("c", "up", F.when(F.col("own") >= F.col("below") - F.col("slack"), F.col("c")).alias("pick"))
        chosen = mark if chosen is None else chosen.union(mark)
    if chosen is None:
        return part(_FINAL).select("id", "c", "lambda")
    way, k = scratch.save(chosen, "way0"), 0
    while not is_empty(way.where("up is not null")):  # the selected one nearest to the root stands
        over = way.select(F.col("c").alias("up"), F.col("up").alias("next"), F.col("pick").alias("higher"))
        k += 1
        way = scratch.save(way.join(over, "up", "left").select("c", F.col("next").alias("up"), F.coalesce("higher", "pick").alias("pick")), f"way{k}")
    points, waiting = part(_POINT).select("id", "c", "lambda"), part(_WAITING).select("id", "next")
    for k in range(levels):
        got = waiting.join(points.select(F.col("id").alias("next"), "c", "lambda"), "next").select("id", "c", "lambda")
        points = scratch.save(points.union(got).distinct(), f"points{k}")
    finals = last.select(F.col("id").alias("c"), "to").join(way.select(F.col("c").alias("to"), "pick"), "to").where("pick is not null")
    return points.join(finals, "c").select("id", F.col("pick").alias("c"), "lambda")


def clusters(
    vectors: DataFrame, dimensions: int, least: float = 0.85, samples: int = 5, smallest: int = 5, exemplars: int = 3
) -> DataFrame:
    """``cluster_key, key, size, persistence, exemplar``: the most stable clusters of the condensed hierarchy.

    The hierarchy is that of all merges of the spanning forest, by mutual reachability with ``samples`` samples. A
    cluster begins where a part reaches ``smallest`` keys and ends where it joins another such part. Strength is one
    over the distance (``CLOSEST`` at least); a cluster's stability is the sum over its members of the strength at
    which each leaves, less that at which the cluster ends; one that never joins another ends at ``least``. A cluster
    is selected unless those inside it are more stable together. ``persistence`` is the similarity at which the member
    leaves for good; the ``exemplars`` most persistent, smallest keys first, are marked. ``cluster_key`` is the smallest
    key of the cluster. Keys that are in no selected cluster are in no result.
    """
    spark = vectors.sparkSession
    keys, edges = linked(vectors, dimensions, least, samples)
    scratch = Scratch(spark, "clusters")
    labels, tree = spanning_forest(edges)
    sizes = scratch.save(keys.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "sizes")
    rows, levels = _pieces(scratch, tree, labels, sizes)
    groups = max(1, -(-rows.count() // PIECE))
    birth = 1 / (1 - least)
    found = rows.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups))).repartition(2 * groups, "g").groupBy("g").applyInArrow(
        lambda table: condense(table, smallest, birth), _CONDENSED
    )
    found = scratch.save(found, "condensed")
    points = found.where(F.col("kind") == _FINAL).select("id", "c", "lambda")
    if levels:
        points = points.union(_joined(scratch, found, levels))
    # Classes without an edge are clusters by their copies alone, as far as these are enough.
    alone = sizes.where(F.col("n") >= smallest).join(labels.select(F.col("node").alias("class")), "class", "left_anti")
    points = points.union(alone.select("class", F.col("class").alias("c"), F.lit(1 / CLOSEST).alias("lambda")))
    member = keys.join(points.withColumnRenamed("id", "class"), "class").select("c", "key", (1 - 1 / F.col("lambda")).alias("persistence"))
    member = scratch.save(member, "member")
    release(spark)
    order = F.struct((-F.col("persistence")).alias("p"), "key")
    about = member.groupBy("c").agg(F.min("key").alias("cluster_key"), F.count(F.lit(1)).alias("size"))
    typical, marks = member, None
    for k in range(exemplars):
        pick = typical.groupBy("c").agg(F.min(order).alias("o")).select("c", F.col("o.key").alias("key"))
        marks = pick if marks is None else marks.union(pick)
        typical = typical.join(pick, ["c", "key"], "left_anti")
    return (
        member.join(about, "c")
        .join(marks.withColumn("exemplar", F.lit(True)), ["c", "key"], "left")
        .select("cluster_key", "key", "size", "persistence", F.coalesce("exemplar", F.lit(False)).alias("exemplar"))
    )
