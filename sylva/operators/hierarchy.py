"""Parent-child links to full hierarchies by tree contraction.

Both operators alternate raking (leaves, and for cycles also roots, go) with compression (nodes with one parent and
one child are bypassed, no two neighbours in the same round), write each round's removals, and then read them in
reverse. The number of rounds is logarithmic in the number of nodes, whatever the depth, for trees, chains, rings and
links both ways; only a directed core in which every node branches and which does not shrink by merging takes as many
rounds as its diameter. Every round is a constant number of joins and aggregations on the links that are left; degree
counts combine before the shuffle, so a parent with a third of all links is no bottleneck.

Defined cases: null ends and repeated links are dropped; a self-link is a cycle of one; empty inputs give empty
results; further columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylva.operators.spanning import spanning_forest
from sylva.runtime import Scratch, is_empty

#: A core is merged on as long as a round takes at least one in so many of its nodes.
SHRINK = 16
_CONTAINS, _PART_OF = "contains", "part_of"


def containment_links(edges: DataFrame, node_keys: DataFrame) -> DataFrame:
    """Distinct ``parent, child`` of all edges that state containment between existing nodes.

    ``contains`` has the parent as its source, ``part_of`` as its target; case and outer blanks of the relationship
    are ignored. ``node_keys`` has one column ``node_key``.
    """
    rel = F.lower(F.regexp_replace("relationship", r"^\s+|\s+$", ""))
    forward = rel == _CONTAINS
    links = edges.where(
        rel.isin(_CONTAINS, _PART_OF) & F.col("source_key").isNotNull() & F.col("target_key").isNotNull()
    ).select(
        F.when(forward, F.col("source_key")).otherwise(F.col("target_key")).alias("parent"),
        F.when(forward, F.col("target_key")).otherwise(F.col("source_key")).alias("child"),
    )
    known = node_keys.select("node_key").where("node_key is not null").distinct()
    return (
        links.distinct()
        .join(known.withColumnRenamed("node_key", "parent"), "parent", "left_semi")
        .join(known.withColumnRenamed("node_key", "child"), "child", "left_semi")
        .select("parent", "child")
    )


def _independent(candidates: DataFrame, salt: int) -> DataFrame:
    """Of candidates ``v, prv, nxt`` those whose hash is below that of any neighbouring candidate."""
    rank = candidates.select(F.col("v").alias("n"), F.xxhash64("v", F.lit(salt)).alias("h"))
    before, after = rank.select(F.col("n").alias("prv"), F.col("h").alias("hp")), rank.select(
        F.col("n").alias("nxt"), F.col("h").alias("hn")
    )
    own = F.xxhash64("v", F.lit(salt))
    return (
        candidates.join(before, "prv", "left")
        .join(after, "nxt", "left")
        .where((F.col("hp").isNull() | (own < F.col("hp"))) & (F.col("hn").isNull() | (own < F.col("hn"))))
        .select("v", "prv", "nxt")
    )


def cycle_members(links: DataFrame) -> DataFrame:
    """``cycle_key, node_key``: every node that reaches itself over links, with the smallest key of its cycle group.

    A node may have any number of parents. Contraction removes what cannot lie on a cycle and shortens what can; a
    link that becomes a self-link proves its node cyclic. In a core in which every node branches, nodes that are
    surely in one group become one: those joined by links both ways, or the cycles that appear if every node keeps a
    single link. Only a core that these hardly shrink is labelled by colouring, whose rounds follow its diameter.
    Bypassed and merged nodes then return in reverse: a bypassed one belongs to its neighbours' group if both have the
    same, a merged one to that of the node that it became.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "cycles")
    plain = links.select("parent", "child").where("parent is not null and child is not null").distinct()
    left = scratch.save(plain, "links0")
    looped, undone, core, step = [left], [], None, 0
    while not is_empty(open_ := left.where("parent <> child")):
        none = F.lit(None).cast("long")
        ends = open_.select(
            F.col("parent").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("child").alias("nxt"), none.alias("prv")
        ).union(open_.select("child", F.lit(0), F.lit(1), none, "parent"))
        degree = ends.groupBy("v").agg(
            F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("nxt").alias("nxt"), F.max("prv").alias("prv")
        )
        status = scratch.save(degree.where("o = 0 or i = 0 or (o = 1 and i = 1)"), f"status{step}")
        if is_empty(status):
            merged = scratch.save(_cores_merged(open_, f"merged{step}"), f"merged{step}")
            if merged.count() * SHRINK < degree.count():
                core = _colour(open_)
                break
            step += 1
            to = merged.select(F.col("v").alias("end"), "to")
            following = open_.join(to.withColumnRenamed("end", "parent"), "parent", "left").select(F.coalesce("to", "parent").alias("parent"), "child")
            following = following.join(to.withColumnRenamed("end", "child"), "child", "left").select("parent", F.coalesce("to", "child").alias("child"))
            left = scratch.save(following.distinct(), f"links{step}")
            looped.append(left)
            undone.append(("merged", merged))
            continue
        bypass = _independent(status.where("o = 1 and i = 1").select("v", "prv", "nxt"), step)
        chosen = scratch.save(bypass, f"bypassed{step}")
        gone = status.where("o = 0 or i = 0").select("v", none.alias("to")).union(chosen.select("v", "nxt"))
        following = (
            open_.join(gone.select(F.col("v").alias("parent")), "parent", "left_anti")
            .join(gone.select(F.col("v").alias("child"), "to", F.lit(True).alias("hit")), "child", "left")
            .where("hit is null or to is not null")
            .select("parent", F.coalesce("to", "child").alias("child"))
            .distinct()
        )
        step += 1
        left = scratch.save(following, f"links{step}")
        looped.append(left)
        undone.append(("bypassed", chosen))

    labels = None if core is None else scratch.save(core, "core")
    own = looped[0]
    for more in looped[1:]:
        own = own.union(more)
    own = own.where("parent = child").select(F.col("parent").alias("v")).distinct()
    if labels is not None:
        own = own.join(labels, "v", "left_anti")
    own = own.select("v", F.col("v").alias("scc"))
    labels = scratch.save(own if labels is None else labels.union(own), "labels")
    if is_empty(labels):
        return labels.select(F.col("scc").alias("cycle_key"), F.col("v").alias("node_key"))
    for k in range(len(undone) - 1, -1, -1):
        what, nodes = undone[k]
        if what == "merged":
            back = nodes.join(labels.select(F.col("v").alias("to"), "scc"), "to").select("v", "scc")
        else:
            before = labels.select(F.col("v").alias("prv"), F.col("scc").alias("a"))
            after = labels.select(F.col("v").alias("nxt"), F.col("scc").alias("b"))
            back = nodes.join(before, "prv").join(after, "nxt").where("a = b").select("v", F.col("a").alias("scc"))
        # A node that returns with a self-link already has a label of its own; its group's label replaces it.
        both = labels.select("v", "scc", F.lit(0).alias("late")).union(back.select("v", "scc", F.lit(1)))
        labels = scratch.save(both.groupBy("v").agg(F.max_by("scc", "late").alias("scc")), f"labels{k}")
    scratch.keep_only("labels0" if undone else "labels")
    smallest = labels.groupBy("scc").agg(F.min("v").alias("cycle_key"))
    return labels.join(smallest, "scc").select("cycle_key", F.col("v").alias("node_key"))


def _cores_merged(links: DataFrame, label: str) -> DataFrame:
    """``v, to``: nodes of a core, all with links out, that share a cycle with another node and become that one.

    Links both ways are joined into components. Without any, each node keeps one link, chosen by a hash; following
    it for as many steps as there are nodes, doubled in each round, ends on a cycle, whose smallest key is gathered on
    the way.
    """
    spark = links.sparkSession
    mutual = links.join(links.select(F.col("child").alias("parent"), F.col("parent").alias("child")), ["parent", "child"], "left_semi")
    if not is_empty(mutual):
        labels, _ = spanning_forest(mutual.select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(0).alias("w")))
        return labels.where("node <> component").select(F.col("node").alias("v"), F.col("component").alias("to"))
    scratch = Scratch(spark, label)
    kept = F.min_by("child", F.xxhash64("child", F.lit(17))).alias("to")
    walk = scratch.save(links.groupBy(F.col("parent").alias("v")).agg(kept).withColumn("least", F.least("v", "to")), "walk0")
    n, steps, k = walk.count(), 1, 0
    while steps < n:
        ahead = walk.select(F.col("v").alias("to"), F.col("to").alias("end"), F.col("least").alias("l"))
        walk = walk.join(ahead, "to").select("v", F.col("end").alias("to"), F.least("least", "l").alias("least"))
        steps, k = steps * 2, k + 1
        walk = scratch.save(walk, f"walk{k}")
        scratch.drop(f"walk{k - 1}")
    ends = walk.select(F.col("to").alias("v")).distinct()
    return walk.join(ends, "v", "left_semi").where("v <> least").select("v", F.col("least").alias("to"))


def _colour(links: DataFrame) -> DataFrame:
    """``v, scc`` of the cyclic nodes of a core: smallest reaching key forwards, then backwards within one colour."""
    spark = links.sparkSession
    scratch = Scratch(spark, "core")
    found, left, turn = None, scratch.save(links, "links0"), 0
    while not is_empty(left):
        colour = left.select(F.col("parent").alias("v")).union(left.select("child")).distinct().withColumn("c", F.col("v"))
        colour, moving, k = scratch.save(colour, f"colour{turn}_0"), True, 0
        while moving:
            pushed = left.join(colour, left.parent == colour.v).select(F.col("child").alias("v"), F.col("c").alias("n"))
            merged = colour.join(pushed.groupBy("v").agg(F.min("n").alias("n")), "v", "left").select(
                "v", F.least("c", "n").alias("c"), (F.col("n") < F.col("c")).alias("moved")
            )
            k += 1
            new = scratch.save(merged, f"colour{turn}_{k}")
            moving, colour = not is_empty(new.where("moved")), new.select("v", "c")
        same = (
            left.join(colour.select(F.col("v").alias("parent"), F.col("c").alias("cp")), "parent")
            .join(colour.select(F.col("v").alias("child"), F.col("c").alias("cc")), "child")
            .where("cp = cc")
            .select("parent", "child", F.col("cp").alias("c"))
        )
        same = scratch.save(same, f"same{turn}")
        reached = scratch.save(colour.where("v = c").select("v", F.col("c").alias("scc")), f"reached{turn}_0")
        front, k = reached, 0
        while not is_empty(front):
            k += 1
            step = same.join(front, (same.child == front.v) & (same.c == front.scc)).select(same.parent.alias("v"), "scc")
            front = scratch.save(step.distinct().join(reached, "v", "left_anti"), f"reached{turn}_{k}")
            reached = reached.union(front)
        reached = scratch.save(reached, f"group{turn}")
        # A colour's root alone is a group only if it lies on a cycle; self-links are reported by the caller.
        groups = reached.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scc")
        part = reached.join(groups, "scc", "left_semi").select("v", "scc")
        found = part if found is None else found.union(part)
        gone = reached.select("v")
        turn += 1
        left = scratch.save(
            left.join(gone, left.parent == gone.v, "left_anti").join(gone, F.col("child") == gone.v, "left_anti"),
            f"links{turn}",
        )
    return found


def hierarchy(node_keys: DataFrame, links: DataFrame) -> DataFrame:
    """One row per node: ``node_key, parent_key, root_key, depth, path, status``.

    A node with several parents hangs under the smallest; ``path`` is the array of keys from the root to the node.
    ``status`` is ``cycle`` for a node that reaches itself over any links; of the others, ``below_cycle`` for a node
    whose chain of smallest parents ends in a cycle, else ``ok``. Where that chain ends in a cycle there is no root,
    depth or path; a node on a cycle through another parent keeps those of its chain.
    """
    tree = _paths(node_keys, links)
    cyclic = cycle_members(links).select("node_key", F.lit(True).alias("cyclic"))
    return (
        tree.join(cyclic, "node_key", "left")
        .select(
            "node_key",
            "parent_key",
            F.when(F.col("path").isNotNull(), F.col("path")[0]).alias("root_key"),
            F.when(F.col("path").isNotNull(), F.size("path") - 1).alias("depth"),
            "path",
            F.when(F.col("cyclic"), "cycle").when(F.col("path").isNotNull(), "ok").otherwise("below_cycle").alias("status"),
        )
    )


def _paths(node_keys: DataFrame, links: DataFrame) -> DataFrame:
    """``node_key, parent_key, path`` by smallest parents; no path where the chain of parents ends in a cycle."""
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    keys = node_keys.select("node_key").where("node_key is not null").distinct()
    parent = links.where("parent is not null and child is not null").groupBy(F.col("child").alias("c")).agg(
        F.min("parent").alias("p")
    )
    parent = scratch.save(parent, "parent")
    left = scratch.save(parent.select("c", "p", F.array("c").alias("frag")), "left0")
    removed, step = [], 0
    while not is_empty(open_ := left.where("c <> p")):
        kids = open_.groupBy(F.col("p").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("kid"))
        known = scratch.save(open_.join(kids, "c", "left"), f"known{step}")
        chosen = _independent(
            known.where("n = 1").select(F.col("c").alias("v"), F.col("p").alias("prv"), F.col("kid").alias("nxt")), step
        )
        picked = chosen.select(F.col("v").alias("c"))
        bypassed = known.join(picked, "c", "left_semi").select("c", "p", "frag")
        bridge = bypassed.select(F.col("c").alias("p"), F.col("p").alias("up"), F.col("frag").alias("head"))
        kept = (
            known.join(picked, "c", "left_anti")
            .join(bridge, "p", "left")
            .select(
                "c",
                F.coalesce("up", "p").alias("p"),
                F.when(F.col("up").isNull(), F.col("frag")).otherwise(F.concat("head", "frag")).alias("frag"),
                F.col("n").isNull().alias("leaf"),
            )
        )
        both = scratch.save(kept.unionByName(bypassed.withColumn("leaf", F.lit(None).cast("boolean"))), f"round{step}")
        out = both.where("leaf is null or leaf").select("c", "p", "frag")
        if is_empty(out):
            break
        removed.append(out)
        left, step = both.where("not leaf").select("c", "p", "frag"), step + 1
    solved = keys.join(parent.select(F.col("c").alias("node_key")), "node_key", "left_anti").select(
        "node_key", F.array("node_key").alias("path")
    )
    solved = scratch.save(solved, "solved")
    for k in range(step - 1, -1, -1):
        back = removed[k].join(solved.withColumnRenamed("node_key", "p"), "p").select(
            F.col("c").alias("node_key"), F.concat("path", "frag").alias("path")
        )
        solved = solved.union(scratch.save(back, f"solved{k}"))
    return (
        keys.join(parent.select(F.col("c").alias("node_key"), F.col("p").alias("parent_key")), "node_key", "left")
        .join(solved, "node_key", "left")
        .select("node_key", "parent_key", "path")
    )


def descendants(node_keys: DataFrame, links: DataFrame) -> DataFrame:
    """``node_key, descendant_key, distance``: every node that another reaches over links, at the least number of them.

    A node with several parents is below all of them; a node on a cycle is below itself, at the length of its shortest
    cycle. The tree has each acyclic node under its smallest parent, so that cyclic nodes are roots; its pairs come from
    exploding each node's path. Links that are not in the tree are few: they are chained among themselves, one from
    inside another's subtree, chains of doubled length in each round, and each chain joins the ancestors of its start
    with the subtree of its end, so the cost is that of the result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "descendants")
    links = scratch.save(links.select("parent", "child").where("parent is not null and child is not null").distinct(), "links")
    cyclic = scratch.save(cycle_members(links).select("node_key"), "cyclic")
    first = links.join(cyclic.withColumnRenamed("node_key", "child"), "child", "left_anti").groupBy("child").agg(F.min("parent").alias("parent"))
    first = scratch.save(first.select("parent", "child"), "first")
    ends = links.select(F.col("parent").alias("node_key")).union(links.select("child"))
    tree = _paths(node_keys.select("node_key").union(ends), first).withColumn("depth", F.size("path") - 1)
    pairs = scratch.save(
        tree.select(F.posexplode("path").alias("at", "up"), F.col("node_key").alias("down"), "depth").select(
            "up", "down", (F.col("depth") - F.col("at")).alias("d")
        ),
        "pairs",
    )
    extra = scratch.save(links.join(first, ["parent", "child"], "left_anti"), "extra")
    inside = pairs.where("d > 0").select(F.col("up").alias("node_key"), F.col("down").alias("descendant_key"), F.col("d").alias("distance"))
    if is_empty(extra):
        return inside
    start = extra.select(F.col("parent").alias("q"), F.col("child").alias("v"))
    # hop: from the end of one link down its subtree to the start of another
    hop = start.select(F.col("v").alias("end")).distinct().join(pairs, F.col("end") == F.col("up")).select("end", F.col("down").alias("p"), "d")
    hop = scratch.save(hop.join(extra.select(F.col("parent").alias("p")).distinct(), "p", "left_semi").select("end", "p", "d"), "hop")
    best = scratch.save(start.select("q", F.col("v").alias("end"), F.lit(1).alias("cost")), "chains0")
    front, turn = best, 0
    while not is_empty(front):
        turn += 1
        # Of the two halves of a chain that is still missing at least one came in the last round.
        longer = _chained(front, hop, best)
        longer = longer if turn == 1 else longer.union(_chained(best, hop, front))
        longer = longer.groupBy("q", "end").agg(F.min("cost").alias("cost"))
        known = best.select("q", "end", F.col("cost").alias("old"))
        front = scratch.save(longer.join(known, ["q", "end"], "left").where("old is null or cost < old").select("q", "end", "cost"), f"front{turn}")
        best = scratch.save(best.union(front).groupBy("q", "end").agg(F.min("cost").alias("cost")), f"chains{turn}")
    above = pairs.select(F.col("up").alias("node_key"), F.col("down").alias("q"), F.col("d").alias("d1"))
    below = pairs.select(F.col("up").alias("end"), F.col("down").alias("descendant_key"), F.col("d").alias("d2"))
    across = best.join(above, "q").join(below, "end").select(
        "node_key", "descendant_key", (F.col("d1") + F.col("cost") + F.col("d2")).cast("int").alias("distance")
    )
    return inside.union(across).groupBy("node_key", "descendant_key").agg(F.min("distance").alias("distance"))


def _chained(one: DataFrame, hop: DataFrame, two: DataFrame) -> DataFrame:
    """``q, end, cost`` of the chains that go on from the end of one, down to the start of another."""
    step = one.join(hop, "end").select(F.col("q").alias("from"), "p", (F.col("cost") + F.col("d")).alias("so_far"))
    step = step.groupBy("from", "p").agg(F.min("so_far").alias("so_far"))
    return step.join(two.withColumnRenamed("q", "p"), "p").select(F.col("from").alias("q"), "end", (F.col("so_far") + F.col("cost")).alias("cost"))
