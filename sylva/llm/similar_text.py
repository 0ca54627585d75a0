"""Near-duplicate records: ProbMinHash over word shingles, banding, verification.

1. One pass over the records: each becomes the set of fingerprints of its runs of consecutive words. Records with equal
   sets are one class, so that a group of copies, however large, costs as much as a single record. The set's signature
   has ``COMPONENTS`` components of ProbMinHash; the similarity asked for is that of sets, so all shingles weigh the
   same. Bands of ``ROWS`` components are drawn from them in two ways that share one component at most. A band entry is
   one packed number, three bytes of the band and five of the class; entries are grouped by a hash of the band. A row's
   key, class and sketch go the same way, so that no set is written anywhere.
2. Each group pairs the classes of a band in place. A band with many members hands on pairs of blocks of at most
   ``BLOCK`` members, which other tasks expand, so that no task emits a hot band's pairs by itself.
3. A sketch of 32 bytes a class, the least shingle in each of 64 bins, drops candidates whose estimated similarity is
   more than 3.3 standard deviations below the threshold.
4. The others are verified on their whole shingle sets, read again from the texts of one record of each class, with the
   exact similarity.

Shingles are 32-bit fingerprints: two shingles of a pair coincide by chance about once in a million pairs. Two classes
whose five bytes coincide are both looked at.

A pair at similarity 0.5 is a candidate with probability 0.974, at 0.55 with 0.995, at 0.6 with 0.9994, whatever number of
records share its shingles; the sketch lets 0.999 of those pass.

Defined cases: null name or content counts as empty; records with too few words or without a key are in no result; redelivered rows
count once; an empty table gives an empty result; other columns are not read; ties do not arise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylva.llm.probminhash import mix, signatures
from sylva.operators.spanning import spanning_forest
from sylva.runtime import Scratch, release

COMPONENTS, ROWS = 128, 4
_QUARTER = COMPONENTS // ROWS
#: Components of each band: runs of neighbours, and runs at distances of a quarter.
BANDS = [[ROWS * k + j for j in range(ROWS)] for k in range(_QUARTER)] + [[k + _QUARTER * j for j in range(ROWS)] for k in range(_QUARTER)]
#: Entries of one group, about.
GROUP = 300_000
#: Pairs that a group hands on at once, about.
PAIRS = 500_000
#: A band with more members than this is cut into blocks of so many.
BLOCK = 1024
#: Slots of the filter that keeps records without candidates from being read again; its size does not follow theirs.
SLOTS = 1 << 23
_BINS = 64
_SKETCH = _BINS // 2
#: The low bits of a class that a band entry leaves out.
_SHORT = 24

_WORD = re.compile("[a-z0-9]+")


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[str], size: int, least: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the texts with at least ``least`` words, their distinct shingles in one array, and each one's owner."""
    number, counts, flat = hashes.__getitem__, [], []
    for text in texts:
        words = _WORD.findall(text.lower())
        if len(words) < max(least, size):
            words = []
        counts.append(len(words))
        flat.extend(map(number, words))
    word = mix(np.array(flat, np.uint64))
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(word) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = len(word) - size + 1
    run = word[:n].copy()
    for k in range(1, size):
        run = mix(run * np.uint64(2 * k + 1)) + word[k : k + n]
    inside = owner[:n] == owner[size - 1 :]
    both = np.unique(owner[:n][inside].astype(np.uint64) << np.uint64(32) | mix(run[inside]) >> np.uint64(32))
    owner = (both >> np.uint64(32)).astype(np.int64)
    kept = np.unique(owner)
    return kept, (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(kept, owner)


def sketches(shingle: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """``sets`` x 32 bytes: four bits of the least shingle in each of 64 bins, 0 for an empty bin. Shingles are sorted."""
    spot = owner * _BINS + (shingle >> np.uint32(26)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]])) if len(spot) else np.zeros(0, np.int64)
    bins = np.zeros(sets * _BINS, np.uint8)
    bins[spot[first]] = 1 + (mix(shingle[first].astype(np.uint64)) >> np.uint64(40)) % np.uint64(15)
    return bins[::2] << 4 | bins[1::2]


def alike(one: np.ndarray, two: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sketches of each row may belong to sets at or above the threshold."""
    same = used = 0
    for shift in (0, 4):
        a, b = one >> shift & 15, two >> shift & 15
        same = same + ((a == b) & (a > 0)).sum(1)
        used = used + ((a > 0) | (b > 0)).sum(1)
    return same >= threshold * used - 3.3 * np.sqrt(used * threshold * (1 - threshold))


def _named(shingle: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """The class of each set: a hash of all its shingles."""
    sums = np.zeros(sets, np.uint64)
    np.add.at(sums, owner, mix(shingle.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return mix(sums + np.bincount(owner, minlength=sets).astype(np.uint64))


def prepare(records: DataFrame, size: int, least: int) -> DataFrame:
    """``class, shingles`` of the records ``key, text`` that have enough words."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            kept, shingle, owner = shingle_sets([t or "" for t in batch.column(1).to_pylist()], size, least, hashes)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(kept)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int32)))
            name = _named(shingle, owner, len(kept)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), lists], ["class", "shingles"])

    return records.select("key", "text").mapInArrow(run, "class long, shingles array<int>")


_FOUND = "kind int, a long, b long, one binary, two binary"
_MEMBER, _PAIR, _BLOCKS = 0, 1, 2


def _rows(kind: int, a, b, one=None, two=None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), none if one is None else one, none if two is None else two],
        ["kind", "a", "b", "one", "two"],
    )


def _binary(data: np.ndarray, width: int) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())


def met(records: DataFrame, size: int, least: int) -> DataFrame:
    """Rows of three kinds: ``key, class, sketch`` of a record; two lists of shortened classes that agree on a band side
    by side; two blocks of shortened classes of one band, each of the first to be paired with each of the second."""
    groups = max(4, -(-records.where("key is not null").count() * len(BANDS) // GROUP))
    columns = np.array(BANDS)
    member = np.dtype([("key", "<i8"), ("class", "<u8"), ("sketch", "u1", _SKETCH)])

    def bands(batches):
        hashes = _Hashes()
        for batch in batches:
            kept, shingle, owner = shingle_sets([t or "" for t in batch.column(1).to_pylist()], size, least, hashes)
            if not len(kept):
                continue
            name = _named(shingle, owner, len(kept))
            held = np.empty(len(kept), member)
            held["key"], held["class"] = batch.column(0).to_numpy()[kept], name
            held["sketch"] = sketches(shingle, owner, len(kept)).reshape(-1, _SKETCH)
            yield from packed(held, (name % np.uint64(groups)).astype(np.int64), groups, groups)
            for begin in range(0, len(kept), 2000):
                lo, hi = np.searchsorted(owner, [begin, begin + 2000])
                part = name[begin : begin + 2000]
                sign = signatures(owner[lo:hi] - begin, shingle[lo:hi].astype(np.uint64), len(part), COMPONENTS)
                key = np.zeros((len(part), len(BANDS)), np.uint64) + np.arange(len(BANDS), dtype=np.uint64)
                for j in range(ROWS):
                    key = mix(key + sign[:, columns[:, j]])
                entry = (key >> np.uint64(40) << np.uint64(40)) | (part >> np.uint64(_SHORT))[:, None]
                place = ((key & np.uint64(0xFFFFFFFF)) % np.uint64(groups)).astype(np.int64)
                yield from packed(entry.ravel(), place.ravel(), groups, 0)

    def packed(rows, place, count, first):
        order = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[order], np.arange(count + 1))
        rows = rows[order]
        full = np.flatnonzero(np.diff(cut))
        binary = pa.array([rows[cut[g] : cut[g + 1]].tobytes() for g in full], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array((full + first).astype(np.int64)), binary], ["g", "rows"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, group = [], 0
        for batch in batches:
            if batch.num_rows:
                group = batch.column("g")[0].as_py()
                parts += batch.column("rows").to_pylist()
        if group >= groups:
            rows = np.unique(np.frombuffer(b"".join(parts), member)) if parts else np.zeros(0, member)
            yield _rows(_MEMBER, rows["key"], rows["class"].view(np.int64), _binary(rows["sketch"], _SKETCH))
            return
        rows = np.unique(np.frombuffer(b"".join(parts), np.uint64))
        del parts
        name = (rows & np.uint64((1 << 40) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], rows[1:] >> np.uint64(40) != rows[:-1] >> np.uint64(40)]))
        size_ = np.diff(np.append(start, len(rows)))
        for at, m in zip(start[size_ > BLOCK], size_[size_ > BLOCK]):
            cuts = [name[at + k : at + min(k + BLOCK, m)].tobytes() for k in range(0, m, BLOCK)]
            for i, one in enumerate(cuts):
                for j in range(i, len(cuts), 64):
                    two = cuts[j : j + 64]
                    none = np.zeros(len(two), np.int64)
                    yield _rows(_BLOCKS, none, none, pa.array([one] * len(two), pa.binary()), pa.array(two, pa.binary()))
        # Members of a band are sorted, so that each pairs with those after it, at one distance at a time. Pairs go
        # out as they come.
        few = (size_ > 1) & (size_ <= BLOCK)
        start, size_, step, held, n = start[few], size_[few], 1, [], 0
        while len(start):
            reach = size_ - step
            at = np.repeat(start, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            held.append(np.stack([name[at], name[at + step]]))
            n += len(at)
            step += 1
            start, size_ = start[size_ > step], size_[size_ > step]
            if n > PAIRS or not len(start):
                both = np.concatenate(held, axis=1)
                both = both[:, np.lexsort(both)]
                both = both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(0)])] if both.shape[1] else both
                none = np.zeros(1, np.int64)
                yield _rows(_PAIR, none, none, *(pa.array([_shortened(side)], pa.binary()) for side in both))
                held, n = [], 0

    entries = records.where("key is not null").select("key", "text").mapInArrow(bands, "g long, rows binary")
    return entries.groupBy("g").applyInArrow(pairs, _FOUND)


def _shortened(classes: np.ndarray) -> bytes:
    """Five bytes a class."""
    return np.ascontiguousarray(classes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _listed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` of pairs that were written side by side."""
    for batch in batches:
        for sides in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
            wide = []
            for raw in sides:
                full = np.zeros((len(raw) // 5, 8), np.uint8)
                full[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
                wide.append(pa.array(full.view("<i8").ravel()))
            yield pa.RecordBatch.from_arrays(wide, ["a", "b"])


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b`` with a < b of all pairs across two blocks."""
    for batch in batches:
        for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
            one, two = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
            a, b = np.repeat(one, len(two)), np.tile(two, len(one))
            ok = a < b  # members of a band are sorted, so the second block is never before the first
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def _promising(threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, _SKETCH) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(alike(one, two, threshold)))

    return run


def _listed(wanted: DataFrame):
    """A filter that passes every row whose key is in ``wanted`` and few others, by a bit table of fixed size."""
    slot = F.pmod("key", F.lit(SLOTS))
    bits = wanted.select((slot / 32768).cast("int").alias("b"), slot.alias("v")).groupBy("b").agg(
        F.bitmap_construct_agg(F.col("v") % 32768).alias("m")
    )
    table = np.zeros(SLOTS, bool)
    for row in bits.collect():
        table[row["b"] * 32768 : (row["b"] + 1) * 32768] = np.unpackbits(np.frombuffer(row["m"], np.uint8), bitorder="little")
    shared = wanted.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches):
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column(0).to_numpy() % SLOTS]))

    return run


def similar_classes(records: DataFrame, size: int, least: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``key, class`` of every record, and ``a, b, similarity`` of every pair of classes at or above the threshold."""
    spark = records.sparkSession
    scratch = Scratch(spark, "similar")
    found = scratch.save(met(records, size, least), "found", by="kind")
    release(spark)  # lets go of the bands' shuffle files before anything else is moved
    members = found.where(F.col("kind") == _MEMBER).select(F.col("a").alias("key"), F.col("b").alias("class"), F.col("one").alias("sketch"))
    blocks = found.where(F.col("kind") == _BLOCKS).select("one", "two").repartition(spark.sparkContext.defaultParallelism * 4)
    both = found.where(F.col("kind") == _PAIR).select("one", "two").mapInArrow(_listed_pairs, "a long, b long")
    both = both.union(blocks.mapInArrow(_expanded, "a long, b long"))
    sketch = members.groupBy("class").agg(F.first("sketch").alias("sketch"))
    short = F.shiftrightunsigned("class", _SHORT)
    near = both.repartition("a").distinct()
    near = near.join(sketch.select(short.alias("a"), F.col("class").alias("x"), F.col("sketch").alias("s")), "a")
    near = near.join(sketch.select(short.alias("b"), F.col("class").alias("y"), F.col("sketch").alias("t")), "b")
    near = near.select(F.col("x").alias("a"), F.col("y").alias("b"), "s", "t")
    pairs = scratch.save(near.mapInArrow(_promising(threshold), "a long, b long"), "pairs")
    scratch.drop(f"found/kind={_PAIR}", f"found/kind={_BLOCKS}")
    release(spark)
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    one = scratch.save(members.join(wanted, "class").groupBy("class").agg(F.min("key").alias("key")), "one")
    again = records.where("key is not null").select("key", "text").mapInArrow(_listed(one), "key long, text string")
    sets = prepare(again, size, least).join(one.select("class"), "class", "left_semi")
    held = scratch.save(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "held")
    release(spark)
    left, right = held.select(F.col("class").alias("a"), F.col("shingles").alias("s")), held.select(F.col("class").alias("b"), F.col("shingles").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    verified = (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", (shared / (F.size("s") + F.size("t") - shared)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    verified = scratch.save(verified, "verified")
    scratch.drop("held", "one", "pairs")
    release(spark)
    return members.select("key", "class"), verified


def similar_pairs(records: DataFrame, size: int = 3, least: int = 12, threshold: float = 0.5) -> DataFrame:
    """``key_a, key_b`` of all pairs of records at or above the threshold, smaller key first.

    Copies are expanded last, so this costs one row per pair of keys; ``similar_groups`` has one row per record.
    """
    members, pairs = similar_classes(records, size, least, threshold)
    a, b = members.select(F.col("key").alias("x"), F.col("class").alias("a")), members.select(F.col("key").alias("y"), F.col("class").alias("b"))
    across = pairs.join(a, "a").join(b, "b").select("x", "y")
    copied = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class")
    same = members.join(copied, "class", "left_semi")
    within = same.select(F.col("key").alias("x"), "class").join(same.select(F.col("key").alias("y"), "class"), "class").where("x < y")
    return across.union(within.select("x", "y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def similar_groups(records: DataFrame, size: int = 3, least: int = 12, threshold: float = 0.5) -> DataFrame:
    """One row per record with enough words: ``key, class_key, group_key, links``.

    ``class_key`` is the smallest key with an equal shingle set, ``group_key`` the smallest of all that chains of links
    join, ``links`` the number of other classes that the record's class is linked to.
    """
    members, pairs = similar_classes(records, size, least, threshold)
    labels, _ = spanning_forest(pairs.select("a", "b", F.lit(0).alias("w")))
    links = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    named = members.groupBy("class").agg(F.min("key").alias("class_key"))
    named = named.join(labels.withColumnRenamed("node", "class"), "class", "left").join(links, "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    first = named.groupBy("component").agg(F.min("class_key").alias("group_key"))
    named = named.join(first, "component").select("class", "class_key", "group_key", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return members.join(named, "class").select("key", "class_key", "group_key", "links")
