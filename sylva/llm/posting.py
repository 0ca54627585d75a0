"""Balanced posting lists over unit vectors: the common ground of nearest neighbours (p5) and clusters (p4).

* Centroids come from a bounded sample, split again and again until a part is small, so that lists are balanced and
  dense regions get more of them. Lists in the order of that tree are cut into groups; a group is one task's work.
* A graph over the centroids, kept in memory, finds the lists near a vector: a beam starts at a few entry points and
  follows neighbours. Centroids are at most ``MOST`` (16 MB), whatever the size of the data.
* A vector is a member of its nearest list and, if it lies near a boundary, of up to ``COPIES`` lists that are hardly
  farther and not behind one another. As a query it probes every list whose distance ratio to the nearest is within
  ``RATIO``, up to ``PROBES``.
* Beyond some 1e8 vectors the lists outgrow ``LIST``, as there are at most ``MOST``; a dense region may do so at any
  size. An overfull list is split again in its task, by the same rules and by its own members, so that the work of a
  vector stays that of a few lists. A task then holds about n / ``MOST`` vectors, 150,000 of 1e10.
* Equal vectors are one class. Only a class's smallest keys can be among the nearest of anything, so a class with a
  third of all rows stays small.

A vector travels once to each group that it is a member or a query of. All vectors are indexed and all are queries.

Defined cases: null, empty, wrongly long, not finite and zero vectors are left out; redelivered rows count once; of
equal similarities the smaller key is nearer; an empty table gives empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylva.functions.vectors import is_valid, is_zero
from sylva.operators.centroids import fit_centroids, unit

#: Vectors of the sample that centroids are fitted on, at most.
SAMPLE = 40_000
#: Members of a list, about; members of a group, about; lists, at most.
LIST, GROUP, MOST = 1_600, 16_000, 65_536
#: A list with so many times its members is split again where it is searched.
OVERFULL = 4
COPIES, NEAR = 4, 1.10
PROBES, RATIO = 32, 1.15
_BRANCH, _DEGREE, _BEAM = 16, 16, 48


@dataclass
class Lists:
    """Centroids, the graph over them, entry points, and the group of each list."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    group: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, total: int, seed: int = 7) -> Lists:
        data = unit(sample)
        leaf = max(4.0, LIST * len(data) / max(total, 1), len(data) / MOST)
        parts: list[tuple[np.ndarray, int]] = []

        def split(rows: np.ndarray, depth: int) -> None:
            k = int(min(_BRANCH, np.ceil(len(rows) / leaf)))
            if k > 1 and depth < 12:
                centres = fit_centroids(data[rows], k, seed + depth, rounds=6, balance=0.02)
                cell = (data[rows] @ centres.T).argmax(1)
                cells = [rows[cell == c] for c in range(len(centres))]
                if max(map(len, cells)) < len(rows):
                    for part in cells:
                        if len(part):
                            split(part, depth + 1)
                    return
            parts.append((unit(data[rows].mean(0, keepdims=True, dtype="f8"))[0], len(rows)))

        if len(data):
            split(np.arange(len(data)), 0)
        else:
            parts.append((np.zeros(sample.shape[1], "f4"), 0))
        centroids = np.stack([p[0] for p in parts])
        weight = np.array([p[1] for p in parts], "f8") * max(total, 1) / max(len(data), 1)
        group = ((np.cumsum(weight) - weight / 2) // GROUP).astype(np.int32)
        n, degree = len(centroids), min(_DEGREE, len(centroids))
        graph = np.empty((n, degree), np.int32)
        for at in range(0, n, 2048):
            near = centroids[at : at + 2048] @ centroids.T
            graph[at : at + 2048] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        rng = np.random.default_rng(seed)
        if n > degree:  # the last links go far, so that no region is cut off
            graph[:, -2:] = rng.integers(0, n, (n, 2))
        entries = np.sort(rng.choice(n, min(n, max(8, int(n**0.5) * 2)), replace=False))
        return Lists(centroids, graph, entries.astype(np.int32), group)

    def nearest(self, vectors: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``want`` nearest lists of each vector by beam search, nearest first, and their cosines."""
        n, want = len(self.centroids), min(want, len(self.centroids))
        beam = min(n, max(_BEAM, want))
        rows = np.arange(len(vectors))[:, None]
        start = vectors @ self.centroids[self.entries].T
        take = min(beam, len(self.entries))
        first = np.argpartition(-start, take - 1, axis=1)[:, :take]
        ids = np.full((len(vectors), beam), -1, np.int64)
        cos = np.full((len(vectors), beam), -2, np.float32)
        ids[:, :take], cos[:, :take] = self.entries[first], start[rows, first]
        seen = np.zeros((len(vectors), n), bool)
        seen[rows, self.entries[None, :]] = True
        done = np.zeros((len(vectors), n + 1), bool)
        active = np.arange(len(vectors))
        width = 4
        for _ in range(64):
            # Expand the best few that are not expanded yet, of every vector that still has one in its beam.
            open_ = np.where(done[active[:, None], ids[active]] | (ids[active] < 0), -3, cos[active])
            pick = np.argpartition(-open_, min(width, beam) - 1, axis=1)[:, :width]
            picked = np.take_along_axis(open_, pick, 1)
            alive = picked.max(1) > -3
            active, pick, picked = active[alive], pick[alive], picked[alive]
            if not len(active):
                break
            at = np.take_along_axis(ids[active], pick, 1)
            at = np.where(picked > -3, at, np.take_along_axis(at, picked.argmax(1)[:, None], 1))
            done[active[:, None], at] = True
            near = self.graph[at].reshape(len(active), -1).astype(np.int64)
            near.sort(axis=1)
            fresh = ~seen[active[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[active[:, None], near] = True
            score = np.full(near.shape, -2, np.float32)
            r, c = np.nonzero(fresh)
            score[r, c] = np.einsum("ij,ij->i", vectors[active[r]], self.centroids[near[r, c]])
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
            all_cos = np.concatenate([cos[active], score], 1)
            best = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            ids[active], cos[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_cos, best, 1)
        order = np.argsort(-cos, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)

    def places(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Near lists of each vector, and which of them it is a member of and which it probes."""
        ids, cos = self.nearest(vectors, PROBES)
        far = np.sqrt(np.maximum(0, 2 - 2 * cos))
        probe = (far <= RATIO * far[:, :1] + 1e-6) & (ids >= 0)
        member = np.zeros_like(probe)
        member[:, 0] = ids[:, 0] >= 0
        for j in range(1, min(ids.shape[1], 3 * COPIES)):
            fine = (far[:, j] <= NEAR * far[:, 0] + 1e-6) & (ids[:, j] >= 0) & (member.sum(1) < COPIES)
            for i in range(j):
                between = np.einsum("ij,ij->i", self.centroids[ids[:, i]], self.centroids[ids[:, j]])
                fine &= ~member[:, i] | (np.sqrt(np.maximum(0, 2 - 2 * between)) > far[:, j])
            member[:, j] = fine
        return ids, member, probe


def valid_vectors(vectors: DataFrame, dimensions: int) -> DataFrame:
    """``key, vector`` rows that are vectors."""
    return vectors.where(F.col("key").isNotNull() & is_valid("vector", dimensions) & ~is_zero("vector")).select("key", "vector")


def fit_lists(valid: DataFrame, dimensions: int, seed: int = 7) -> Lists:
    """Lists for all rows of ``valid``, fitted on at most ``SAMPLE`` of them, chosen by a hash of the key."""
    total = valid.count()
    rows = valid.withColumn("_h", F.xxhash64("key", F.lit(seed))).orderBy("_h").limit(SAMPLE).select("vector") if total > SAMPLE else valid.select("vector")
    sample = rows.toArrow().column("vector").combine_chunks()
    data = np.asarray(sample.flatten(), "f4").reshape(-1, dimensions)
    return Lists.fit(data, total, seed)


def place(valid: DataFrame, lists: Lists, dimensions: int, keep: int, label: str | None = None, extra: str | None = None) -> DataFrame:
    """``g, class, label, vector, keys, member, probe, extra``: each class of a batch once for each group that it goes to.

    ``keys`` are the ``keep`` smallest keys of the class in the batch; ``member`` and ``probe`` are lists of the group.
    Vectors of different labels are different classes. ``extra`` is a number that all rows of a class share.
    """
    shared = valid.sparkSession.sparkContext.broadcast(lists)

    def run(batches):
        import pyarrow as pa

        at = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            raw = np.asarray(batch.column(1).flatten(), "f4").reshape(-1, dimensions)
            name = batch.column(2).to_numpy()
            tag = batch.column(3).to_numpy(zero_copy_only=False) if label else np.zeros(len(keys), np.int64)
            more = batch.column(4).to_numpy(zero_copy_only=False) if extra else np.zeros(len(keys))
            order = np.lexsort((keys, name))
            keys, raw, name, tag, more = keys[order], raw[order], name[order], tag[order], more[order]
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            end = np.append(start[1:], len(name))
            few = [np.unique(keys[a:b])[:keep].tobytes() for a, b in zip(start, end)]
            data, name, tag, more = unit(raw[start]), name[start], tag[start], more[start]
            out: list[tuple] = []
            for lo in range(0, len(data), 1024):
                part = data[lo : lo + 1024]
                ids, member, probe = at.places(part)
                used = member | probe
                r, c = np.nonzero(used)
                g, l, m, p = at.group[ids[r, c]], ids[r, c].astype(np.int32), member[r, c], probe[r, c]
                o = np.lexsort((g, r))
                r, g, l, m, p = r[o], g[o], l[o], m[o], p[o]
                cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])]))
                for a, b in zip(cut, np.append(cut[1:], len(r))):
                    k = lo + r[a]
                    out.append((int(g[a]), int(name[k]), int(tag[k]), data[k].tobytes(), few[k], l[a:b][m[a:b]].tobytes(), l[a:b][p[a:b]].tobytes(), float(more[k])))
            cols = list(zip(*out))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["g", "class", "label", "vector", "keys", "member", "probe", "extra"]
            )

    named = valid.withColumn("class", F.xxhash64("vector", *([label] if label else [])))
    chosen = named.select("key", "vector", "class", F.col(label) if label else F.lit(0).alias("label"), *([extra] if extra else []))
    return chosen.mapInArrow(run, "g int, class long, label long, vector binary, keys binary, member binary, probe binary, extra double")


@dataclass
class Held:
    """One group's classes: each once, with its smallest keys, its lists and its probes."""

    name: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    keys: list[np.ndarray]
    member: tuple[np.ndarray, np.ndarray]
    probe: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(table, dimensions: int, keep: int) -> Held:
        name = table.column("class").to_numpy()
        order = np.argsort(name, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        end = np.append(start[1:], len(order))
        first = order[start]
        col = lambda c: table.column(c).to_pylist()
        keys, vectors, member, probe = col("keys"), col("vector"), col("member"), col("probe")
        merged = [
            np.frombuffer(keys[order[a]], np.int64) if b == a + 1
            else np.unique(np.concatenate([np.frombuffer(keys[i], np.int64) for i in order[a:b]]))[:keep]
            for a, b in zip(start, end)
        ]

        def flat(rows):
            lists = [np.frombuffer(rows[i], np.int32) for i in first]
            return np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])

        data = np.frombuffer(b"".join(vectors[i] for i in first), np.float32).reshape(-1, dimensions)
        return Held(name[first], table.column("label").to_numpy()[first], data, merged, flat(member), flat(probe))

    def blocks(self, rows: int = 512):
        """Queries and members of each list, queries in blocks. An overfull list is split again by its own members."""
        ml, mi = self.member
        pl, pi = self.probe
        mo, po = np.argsort(ml, kind="stable"), np.argsort(pl, kind="stable")
        ml, mi, pl, pi = ml[mo], mi[mo], pl[po], pi[po]
        for one in np.unique(ml):
            m = mi[np.searchsorted(ml, one) : np.searchsorted(ml, one, "right")]
            q = pi[np.searchsorted(pl, one) : np.searchsorted(pl, one, "right")]
            for part_q, part_m in self._parts(q, m) if len(m) > OVERFULL * LIST else [(q, m)]:
                for lo in range(0, len(part_q), rows):
                    yield part_q[lo : lo + rows], part_m

    def _parts(self, q: np.ndarray, m: np.ndarray):
        """Queries and members of the lists that the members of one list make among themselves."""
        rng = np.random.default_rng(len(m))
        inner = Lists.fit(self.vectors[np.sort(rng.choice(m, min(SAMPLE, len(m)), replace=False))], len(m))
        found = []
        for at, what in ((m, 0), (q, 1)):
            place, who = [], []
            for lo in range(0, len(at), 1024):
                ids, *used = inner.places(self.vectors[at[lo : lo + 1024]])
                r, c = np.nonzero(used[what])
                place.append(ids[r, c]), who.append(at[lo + r])
            place, who = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (place, who))
            order = np.argsort(place, kind="stable")
            found.append((place[order], who[order]))
        (ml, mi), (ql, qi) = found
        for one in np.unique(ml):
            yield qi[np.searchsorted(ql, one) : np.searchsorted(ql, one, "right")], mi[np.searchsorted(ml, one) : np.searchsorted(ml, one, "right")]


def nearest_keys(valid: DataFrame, lists: Lists, dimensions: int, keep: int, least: float, label: str | None = None) -> DataFrame:
    """``class, best``: the ``keep`` nearest keys of each class, its own included, as ``d`` (minus the cosine) and
    ``neighbour``, nearest first; keys of other labels and those below ``least`` are left out."""

    def search(table):
        import pyarrow as pa

        held = Held.of(table, dimensions, keep)
        found_q, found_m = [], []
        for q, m in held.blocks():
            near = held.vectors[q] @ held.vectors[m].T
            if label:
                near[held.label[q][:, None] != held.label[m][None, :]] = -2
            hit = near >= least - 1e-5
            if len(m) > keep:
                # rows with more hits than wanted keep those not below their keep-th best
                many = np.flatnonzero(hit.sum(1) > keep)
                if len(many):
                    line = np.partition(near[many], len(m) - keep, axis=1)[:, len(m) - keep]
                    hit[many] &= near[many] >= line[:, None] - 1e-6
            r, c = np.nonzero(hit)
            found_q.append(q[r]), found_m.append(m[c])
        if not found_q:
            none = pa.array([], pa.int64())
            return pa.Table.from_arrays([none, none, pa.array([], pa.float64())], ["class", "neighbour", "cosine"])
        both = np.unique(np.concatenate(found_q).astype(np.int64) << 32 | np.concatenate(found_m))
        q, m = both >> 32, both & 0xFFFFFFFF
        wide = held.vectors.astype(np.float64)
        wide /= np.sqrt((wide**2).sum(1, keepdims=True))
        cosine = np.concatenate([np.einsum("ij,ij->i", wide[q[a : a + 65536]], wide[m[a : a + 65536]]) for a in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        ok = cosine >= least
        q, m, cosine = q[ok], m[ok], cosine[ok]
        size = np.array([len(x) for x in held.keys])
        n = size[m]
        q, cosine = np.repeat(q, n), np.repeat(cosine, n)
        key = np.concatenate([held.keys[i] for i in m]) if len(m) else np.zeros(0, np.int64)
        order = np.lexsort((key, -cosine, q))
        q, key, cosine = q[order], key[order], cosine[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        top = rank < keep
        return pa.Table.from_arrays([pa.array(held.name[q[top]]), pa.array(key[top]), pa.array(cosine[top])], ["class", "neighbour", "cosine"])

    found = grouped(place(valid, lists, dimensions, keep, label), lists).applyInArrow(search, "class long, neighbour long, cosine double")
    return found.groupBy("class").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("d"), "neighbour"))), 1, keep).alias("best")
    )


def grouped(placed: DataFrame, lists: Lists):
    """Placed classes by group, spread over twice as many partitions as there are groups, which Spark does not join."""
    return placed.repartition(2 * (int(lists.group.max()) + 1), "g").groupBy("g")


def neighbours(vectors: DataFrame, k: int, dimensions: int, least: float = -1.0) -> DataFrame:
    """``key, neighbour, cosine``: the k other keys most similar to each key, those below ``least`` left out."""
    from sylva.runtime import Scratch

    valid = valid_vectors(vectors, dimensions)
    lists = fit_lists(valid, dimensions)
    best = Scratch(vectors.sparkSession, "neighbours").save(nearest_keys(valid, lists, dimensions, k + 1, least), "best")
    keys = valid.select("key", F.xxhash64("vector").alias("class")).distinct()
    others = F.filter("best", lambda x: x["neighbour"] != F.col("key"))
    return (
        keys.join(best, "class")
        .select("key", F.explode(F.slice(others, 1, k)).alias("n"))
        .select("key", F.col("n.neighbour").alias("neighbour"), (-F.col("n.d")).alias("cosine"))
    )
