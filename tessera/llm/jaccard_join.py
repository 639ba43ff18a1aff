"""N-gram Jaccard join: groups of documents whose word shingles overlap, by pivots in a metric space.

A document is the set of its distinct five-word shingles; 1 - Jaccard similarity is a
metric on sets. Documents with equal sets are one point. Sets that share nothing are
all at distance 1, where no pivot can tell them apart, so the space is first cut into
cells: two points within RADIUS of each other share one of the first n - ceil(0.8 n) + 1
shingles of each in any common order, and the points with one such shingle are a cell.
The order puts frequent shingles last, the most frequent at the very end; it decides
about the work only, never about the result.

Each cell gets a pivot, its point of least hash, so that the cells of a cluster choose the
same one. About a pivot p there are three zones: the core within RADIUS (linked with p), the
border up to twice RADIUS, and what is far. By the triangle inequality
  - two points of the core are one group already, whatever their distance;
  - a far point links with none of the core;
  - a border point x links only with those of the core at RADIUS less than itself at least.
So core and border of a pivot make one region, whichever cells they were met in. It is dealt
into rings by distance; border points are replicated to the rings in their window and
compared there. Far points go on with the border, in their cells, which get another pivot;
this recurs until a cell has few points left (or pivots cease to part its points), which
are then compared with each other.

A distance is first bounded from below by a parity sketch (two sets differ in at least
as many elements as their sketches in bits); only pairs that may link by that bound are worked
out over the whole sets. A bound from below is all that the border and the far zone need.
So no link between different sets is lost, and a group of copies never gives all its pairs.

Shingles are compared by 64-bit hashes, and so are sets: n distinct sets collide with
a probability of n * n / 2 ** 65. Null and empty texts have no shingles and are linked
with nothing, not even each other; a text of one to four words is one shingle. Rows
with equal ids are documents of their own that share a name. Rows with a null id take part
like others; their group has the least id that is not null, or null. Other columns, whatever
their names, pass through one_of_each.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, map_batches, most_frequent
from tessera.session import drop, materialize, scratch

SHINGLE, PERCENT = 5, 80
RADIUS = (100 - PERCENT) / 100
#: Rings of a region to a RADIUS.
RINGS = 4
#: A shingle that leads in more points counts as frequent; a cell with more open points gets another pivot.
FREQUENT = 64
#: How many pivots a crowded cell gets at a time: the first parts it, all of them link what is near.
PIVOTS = 8
#: One shingle in so many is an anchor: frequent passages are found by their anchors.
ANCHORS, REACH = 12, 40
#: The most anchors and shingles that are put last: 9 bytes each reach every executor.
MOST_ANCHORS, MOST_LAST = 100_000, 1_000_000
#: A block of so many shingles is counted at a time; one that it holds so often is handed on.
BLOCK_SHINGLES, AGAIN = 4_000_000, 3
#: Longs of a parity sketch.
LONGS = 16
#: Bits of the filter that says which sets are needed: 16 a set, but no more than these.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
BLOCK_BYTES = 400_000

_R = 0x9E3779B97F4A7C15
_K = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64) | 1) for k in range(SHINGLE)]
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        base = np.uint64(_R if name == "up" else pow(_R, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, BLOCK_BYTES), base, np.uint64)]), dtype=np.uint64)
    return _powers[name][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(texts: list[bytes]) -> list[np.ndarray]:
    """The shingle hashes of each text, in the order of the text."""
    raw = b"\n".join(texts).lower()  # of bytes: A-Z only
    b = np.frombuffer(raw, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    with np.errstate(over="ignore"):
        sums = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power("up", len(b)), dtype=np.uint64)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        word = _mixed((sums[ends - 1] - before) * _power("down", len(b))[starts] + (ends - starts).astype(np.uint64))
        run = np.zeros(max(len(word) - SHINGLE + 1, 0), np.uint64)
        for k in range(SHINGLE):
            run += word[k : k + len(run)] * _K[k]
        run = _mixed(run)
    last = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.concatenate([[0], np.searchsorted(starts, last)])
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo >= SHINGLE:
            out.append(run[lo : hi - SHINGLE + 1])
        elif hi > lo:  # the whole sequence, marked by its length
            with np.errstate(over="ignore"):
                out.append(_mixed(np.array([sum(int(w) * int(k) for w, k in zip(word[lo:hi], _K)) + int(hi - lo) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingles(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, repeats and order kept."""
    block, size = [], 0
    for t in texts:
        e = (t or "").encode("utf-8", "surrogatepass")
        block.append(e)
        size += len(e)
        if size > BLOCK_BYTES:
            yield from _block(block)
            block, size = [], 0
    if block:
        yield from _block(block)


def distinct(h: np.ndarray) -> np.ndarray:
    """The elements in order, each once (several times as fast as NumPy's unique)."""
    s = np.sort(h)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    return [distinct(h) for h in shingles(texts)]


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    """The name of each set, its point: a hash of its sorted elements."""
    odd = np.arange(max(map(len, sets), default=0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        return _mixed(np.array([(u * odd[: len(u)]).sum(dtype=np.uint64) + np.uint64(len(u)) for u in sets], np.uint64)).view(np.int64)


def least_shared(n: int) -> int:
    """Two sets that link share so many elements of one of n at least."""
    return -(-PERCENT * n // 100)


def lead(n: int) -> int:
    """How many leading shingles of a set of n are held against others."""
    return n - least_shared(n) + 1


def sketch(u: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """For each bit the parity of the elements that fall on it. Half as many longs: the halves, exclusive or."""
    odd = np.bincount((u >> np.uint64(20)) & np.uint64(64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(u: np.ndarray) -> np.ndarray | None:
    """Of a set with more elements than a sketch has bits: one of as many bits as elements at least."""
    return sketch(u, 1 << (len(u) - 1).bit_length() >> 6) if len(u) > 64 * LONGS else None


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    some = [p for p in parts if p is not None]
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)]).astype(np.int32)
    missing = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(some) if some else np.empty(0, np.int64)), mask=missing)


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column("text").to_pylist()


def points_of(docs: DataFrame) -> DataFrame:
    """doc_id, t, n, point, anchors, the longs of the sketch, s0 and on, and of large sets a wide one. docs: doc_id, t, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            us = sets_of(_texts(b))
            made = {"doc_id": b.column("doc_id"), "t": b.column("t"), "n": [len(u) for u in us], "point": names_of(us), "wide": _lists([wide_sketch(u) for u in us])}
            longs = np.array([sketch(u) for u in us], np.int64).reshape(len(us), LONGS)
            yield made | {"anchors": _lists([_signed(u[u % np.uint64(ANCHORS) == 0]) for u in us])} | {f"s{k}": longs[:, k] for k in range(LONGS)}

    longs = ", ".join(f"s{k} long" for k in range(LONGS))
    return map_batches(docs.select("doc_id", "t", "text"), f"doc_id long, t long, n long, point long, anchors array<long>, wide array<long>, {longs}", run)


class Last:
    """The frequent shingles, sorted, and for each how frequent: the base-2 logarithm of its count."""

    def __init__(self, h: np.ndarray, count: np.ndarray):
        at = np.argsort(h.view(np.uint64), kind="stable")
        self.h, self.level = h.view(np.uint64)[at], np.log2(np.maximum(count[at], 2)).astype(np.int8)

    def levels(self, u: np.ndarray) -> np.ndarray:
        """0 for shingles that are not frequent."""
        if not len(self.h):
            return np.zeros(len(u), np.int8)
        at = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
        return np.where(self.h[at] == u, self.level[at], 0).astype(np.int8)

    def with_more(self, h: np.ndarray, count: np.ndarray) -> Last:
        out = Last(np.empty(0, np.int64), np.empty(0))
        both = np.concatenate([self.h, h.view(np.uint64)])
        at = np.argsort(both, kind="stable")
        out.h, out.level = both[at], np.concatenate([self.level, np.log2(np.maximum(count, 2)).astype(np.int8)])[at]
        return out


def _collected(rows: DataFrame, count: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """h and count of the rows of largest count, `most` at most."""
    got = most_frequent(rows, count, most).select("h", count).collect()
    return np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.int64)


def frequent(docs: DataFrame, points: DataFrame, most: int = FREQUENT) -> Last:
    """The frequent shingles of frequent passages: those near a frequent anchor, and those that come up again
    within a block of texts."""
    hot = points.select(F.explode("anchors").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = materialize(hot, "anchors")
    anchors = np.sort(_collected(hot, "n", MOST_ANCHORS)[0].view(np.uint64))

    def block(sets: list[np.ndarray], near: list[np.ndarray]) -> dict:
        s = np.sort(np.concatenate(sets))
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        n = np.diff(np.append(at, len(s)))
        u, often = s[at], n >= AGAIN
        if near:
            often |= np.isin(u, distinct(np.concatenate(near)), assume_unique=True)
        return {"h": _signed(u[often]), "n": n[often]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sets: list[np.ndarray] = []
        near: list[np.ndarray] = []
        size = 0
        for b in batches:
            for h in shingles(_texts(b)):
                if not len(h):
                    continue
                at = np.flatnonzero(h % np.uint64(ANCHORS) == 0)
                if len(at) and len(anchors):
                    at = at[anchors[np.minimum(np.searchsorted(anchors, h[at]), len(anchors) - 1)] == h[at]]
                if len(at) and len(anchors):
                    mark = np.zeros(len(h) + 1, np.int64)
                    np.add.at(mark, np.maximum(at - REACH, 0), 1)
                    np.add.at(mark, np.minimum(at + REACH + 1, len(h)), -1)
                    near.append(h[np.cumsum(mark[:-1]) > 0])
                sets.append(distinct(h))
                size += len(sets[-1])
                if size > BLOCK_SHINGLES:
                    yield block(sets, near)
                    sets, near, size = [], [], 0
        if sets:
            yield block(sets, near)

    counts = map_batches(docs.select("text"), "h long, n long", run).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return Last(*_collected(materialize(counts, "frequent"), "n", MOST_LAST))


def postings(docs: DataFrame, last: Last) -> DataFrame:
    """h, x for the leading shingles of each set; each set once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()  # as many as the task has rows
        for b in batches:
            hs, xs = [], []
            us = sets_of(_texts(b))
            for u, x in zip(us, names_of(us).tolist()):
                if len(u) and x not in seen:
                    seen.add(x)
                    k, level = lead(len(u)), last.levels(u)
                    u = u[:k] if not level.any() else u[np.lexsort((u, level))[:k]]
                    hs.append(u)
                    xs.append(np.full(k, x, np.int64))
            if hs:
                yield {"h": _signed(np.concatenate(hs)), "x": np.concatenate(xs)}

    return map_batches(docs.select("text"), "h long, x long", run)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of rows in the order of h and x: those of each h that has several, with its first x as p."""
    held = None  # the last row: h, x, p, and whether it is out
    for b in batches:
        h, x = b.column("h").to_numpy(), b.column("x").to_numpy()
        if held:
            h, x = np.concatenate([[held[0]], h]), np.concatenate([[held[1]], x])
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])])
        h, x = h[new], x[new]
        start = np.concatenate([[True], h[1:] != h[:-1]])
        at = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
        p = x[at]
        if held:
            p[at == 0] = held[2]
        out = (p != x) | np.concatenate([~start[1:], [False]])
        last = bool(out[-1])
        if held:
            last = last or len(h) == 1 and held[3]
            out[0] &= not held[3]
        held = int(h[-1]), int(x[-1]), int(p[-1]), last
        yield {"h": h[out], "x": x[out], "p": p[out]}


def cells_of(docs: DataFrame, last: Last) -> DataFrame:
    """h, x, p: the cells with several points and the pivot of each."""
    rows = postings(docs, last).repartition("h").sortWithinPartitions("h", "x")
    return materialize(map_batches(rows, "h long, x long, p long", _shared), "cells")


def cells(docs: DataFrame, points: DataFrame) -> DataFrame:
    """The cells, once the shingles that make crowded ones are known as frequent. The order of shingles
    is made anew while shingles not yet known as frequent hold over a fiftieth of the rows."""
    last = frequent(docs, points)
    while True:
        out = cells_of(docs, last)
        crowd = materialize(out.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > FREQUENT), "crowd")
        h, n = _collected(crowd, "n", MOST_LAST)
        fresh = last.levels(h.view(np.uint64)) == 0
        room = MOST_LAST - len(last.h)
        if 50 * int(n[fresh].sum()) <= out.count() or fresh.sum() > room:
            drop(crowd)
            return out
        last = last.with_more(h[fresh], n[fresh])
        drop(out, crowd)
        release(docs)


class Bitmap:
    """A bounded filter of numbers: says yes to all that it was made of, and by chance to some others
    (to most, where there are more than MOST_BITS; then the join that follows has more to drop)."""

    SIZE = 4096  # bytes of a row of Spark's bitmaps

    def __init__(self, rows: DataFrame, column: str):
        self.bits = LEAST_BITS
        wanted = 16 * rows.count()
        while self.bits < min(wanted, MOST_BITS):
            self.bits *= 2
        bit = F.pmod(F.col(column), F.lit(self.bits)) + 1  # of hashes; bits count from 1
        maps = rows.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
        whole = np.zeros((self.bits // (8 * self.SIZE), self.SIZE), np.uint8)
        for r in maps.collect():  # bits / 8 bytes at most
            whole[r.k - 1] = np.frombuffer(bytes(r.m), np.uint8)
        self.send = rows.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def has(self, x: np.ndarray) -> np.ndarray:
        at = x % self.bits
        return (self.send.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def needed_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """point, hs for the texts in ids (t, point). A bitmap of the texts' hashes lets others go before
    anything is shuffled; what it lets pass by chance falls out in the join."""
    wanted = Bitmap(ids, "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            t = b.column("t").to_numpy()
            at = [int(k) for k in np.flatnonzero(wanted.has(t)) if int(t[k]) not in seen and not seen.add(int(t[k]))]
            if at:
                us = sets_of(b.column("text").take(pa.array(at)).to_pylist())
                yield {"t": t[at], "point": names_of(us), "hs": _lists([_signed(u) for u in us])}

    sets = map_batches(docs.select("t", "text"), "t long, point long, hs array<long>", run)
    return sets.join(ids, ["t", "point"], "left_semi").dropDuplicates(["point"]).select("point", "hs")


def is_link(x: str = "nx", y: str = "ny") -> Column:
    return 100 * F.col("both") >= PERCENT * (F.col(x) + F.col(y) - F.col("both"))


def apart() -> Column:
    """How many elements two sets differ in at least: by their sketches (a0.., b0..) and sizes (nx, ny)."""
    bits = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, LONGS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    return F.greatest(bits.cast("long"), F.abs(F.col("nx") - F.col("ny")))


def wide_apart() -> Column:
    """The same by the wide sketches wx and wy, of which one may have half as many longs; not for other sizes."""
    halved = lambda w: F.zip_with(F.slice(w, F.lit(1), (F.size(w) / 2).cast("int")), F.slice(w, (F.size(w) / 2).cast("int") + 1, F.size(w)), lambda a, b: a.bitwiseXOR(b))
    fit = lambda w, v: F.when(F.size(w) == 2 * F.size(v), halved(F.col(w))).otherwise(F.col(w))
    bits = F.zip_with(fit("wx", "wy"), fit("wy", "wx"), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def may_link(differ: Column) -> Column:
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("nx") + F.col("ny"))


def at_least(differ: Column) -> Column:
    """The distance of sets that differ in so many elements, or more."""
    return 2 * differ / (F.col("nx") + F.col("ny") + differ)


def components(edges: DataFrame) -> DataFrame:
    """point, region: the smallest point of each connected component of edges (x, y).

    Labels spread to neighbours and then jump to the label's label, so long chains end in
    a number of rounds that grows with the logarithm of their length.
    """
    both = materialize(edges.select("x", "y").union(edges.select("y", "x")).distinct().toDF("x", "y"), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("point")).agg(F.least(F.min("y"), F.min("x")).alias("region")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("point", "y"), "y").groupBy(F.col("x").alias("point")).agg(F.min("region").alias("near"))
        step = labels.join(near, "point").select("point", F.col("region").alias("old"), F.least("region", "near").alias("region"))
        jump = step.select(F.col("point").alias("region"), F.col("region").alias("further"))
        new = materialize(step.join(jump, "region", "left").select("point", "old", F.coalesce("further", "region").alias("region")), "labels")
        changed = new.where("old <> region").limit(1).count()
        drop(labels)
        path, labels = new.tessera_path, new.select("point", "region")
        labels.tessera_path = path
        if not changed:
            drop(both)
            return labels


def merged(regions: DataFrame, found: DataFrame) -> DataFrame:
    """point, region after further links found (x, y). Only the graph of regions is searched, which is
    far smaller than that of points; a point outside all regions is a region of its own there."""
    named = found
    for c in "xy":
        named = named.join(regions.select(F.col("point").alias(c), F.col("region").alias(f"r{c}")), c, "left")
    between = named.select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y")).where("x <> y").distinct()
    between = materialize(between, "between")
    if not between.limit(1).count():
        drop(between)
        return regions
    joined = components(between)
    old = regions.join(joined.select(F.col("point").alias("region"), F.col("region").alias("further")), "region", "left").select("point", F.coalesce("further", "region").alias("region"))
    out = materialize(old.unionByName(joined.join(regions, "point", "left_anti").select("point", "region")), "regions")
    drop(between, joined)
    return out


def named(names: DataFrame, as_point: str, as_n: str, longs: str) -> DataFrame:
    return names.select(F.col("point").alias(as_point), F.col("n").alias(as_n), *(F.col(f"s{k}").alias(f"{longs}{k}") for k in range(LONGS)))


class Join:
    """The recursion over cells. pairs: candidates (x, y) still to be worked out; regions: the groups so far."""

    def __init__(self, docs: DataFrame, names: DataFrame):
        self.docs, self.names = docs, names
        self.pairs: list[DataFrame] = []
        self.regions: DataFrame | None = None

    def hopeful(self, pairs: DataFrame) -> DataFrame:
        """Pairs (x, y) without those of two large sets whose wide sketches are too far apart."""
        wide = self.names.where("wide is not null").select("point", "n", "wide")
        rows = pairs.join(wide.select(F.col("point").alias("y"), F.col("n").alias("ny"), F.col("wide").alias("wy")), "y", "left")
        rows = rows.join(wide.select(F.col("point").alias("x"), F.col("n").alias("nx"), F.col("wide").alias("wx")), "x", "left")
        far = F.when(F.col("wx").isNotNull() & F.col("wy").isNotNull(), ~may_link(wide_apart())).otherwise(F.lit(False))
        return materialize(rows.where(~far).select("x", "y"), "hopeful")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """x, y, nx, ny, both for pairs (x, y), from the whole sets; pairs that can't link may be left out."""
        pairs = self.hopeful(pairs)
        points = pairs.select(F.col("x").alias("point")).union(pairs.select("y")).distinct()
        needed = materialize(self.names.select("point", "t").join(points, "point", "left_semi"), "needed")
        sets = materialize(needed_sets(self.docs, needed), "sets")
        # first the side that may be one pivot for many: these rows are small
        a = pairs.join(sets.select(F.col("point").alias("y"), F.col("hs").alias("hy")), "y")
        b = a.join(sets.select(F.col("point").alias("x"), F.col("hs").alias("hx")), "x")
        out = b.select("x", "y", F.size("hx").cast("long").alias("nx"), F.size("hy").cast("long").alias("ny"), F.size(F.array_intersect("hx", "hy")).cast("long").alias("both"))
        out = materialize(out, "known")
        drop(needed, sets)
        return out

    def zones(self, open_cells: DataFrame) -> tuple[DataFrame, DataFrame]:
        """x, p, d, zone (0 core, 1 border, 2 far) for the points and pivots that share a cell; and the links
        found, those with the cells' other pivots too."""
        rows = open_cells.select("x", "p", F.lit(True).alias("parts"))
        if "others" in open_cells.columns:
            rows = rows.union(open_cells.select("x", F.explode("others"), F.lit(False)))
        rows = rows.where("x <> p").groupBy("x", "p").agg(F.max("parts").alias("parts"))
        rows = rows.join(named(self.names, "x", "nx", "a"), "x").join(named(self.names, "p", "ny", "b"), "p").select("x", "p", "parts", "nx", "ny", apart().alias("differ"))
        rows = materialize(rows.select("x", "p", "parts", may_link(F.col("differ")).alias("may"), at_least(F.col("differ")).alias("d")), "bounds")
        known = self.measured(rows.where("may").select("x", F.col("p").alias("y")))
        exact = known.select("x", F.col("y").alias("p"), is_link().alias("link"), (1 - F.col("both") / (F.col("nx") + F.col("ny") - F.col("both"))).alias("e"))
        both = rows.where("parts").join(exact, ["x", "p"], "left").select("x", "p", F.coalesce("e", "d").alias("d"), F.coalesce("link", F.lit(False)).alias("link"))
        zone = F.when(F.col("link"), 0).when(F.col("d") <= 2 * RADIUS + 1e-9, 1).otherwise(2)
        return both.select("x", "p", "d", zone.alias("zone")), known.where(is_link()).select("x", "y")

    def in_regions(self, rows: DataFrame) -> DataFrame:
        """rows with the region of x so far; a point without links is a region of its own."""
        known = self.regions.select(F.col("point").alias("x"), "region")
        return rows.join(known, "x", "left").withColumn("region", F.coalesce("region", "x"))

    def met(self, left: DataFrame, right: DataFrame, on: list[str], both: str) -> None:
        """Candidates from rows x of left and y of right that agree on the columns `on` and lie in different
        regions. both: the zone of right in which each pair is met from either side."""
        a = left.join(named(self.names, "x", "nx", "a"), "x")
        r = right.select(*on, F.col("x").alias("y"), F.col("zone").alias("zone_y"), F.col("region").alias("other")).join(named(self.names, "y", "ny", "b"), "y")
        once = (F.col("zone_y") != F.lit(both)) | (F.col("x") < F.col("y"))
        pairs = a.join(r, on).where((F.col("region") != F.col("other")) & once & may_link(apart()))
        self.pairs.append(materialize(pairs.select("x", "y"), "met"))

    def borders(self, inner: DataFrame) -> None:
        """Compares the border of each pivot with its core and with itself, ring by ring. inner: x, p, d, zone, region."""
        ring = lambda d: F.floor(d * RINGS / RADIUS).cast("int")
        # the window of a border point: from its distance less RADIUS to the border's end
        low = F.greatest(F.lit(0), ring(F.col("d") - RADIUS - 1e-6))
        left = inner.where("zone = 1").withColumn("ring", F.explode(F.sequence(low, F.lit(2 * RINGS)))).select("x", "p", "ring", "region")
        self.met(left, inner.withColumn("ring", F.least(ring(F.col("d")), F.lit(2 * RINGS))), ["p", "ring"], both=1)

    def leaves(self, rest: DataFrame) -> None:
        """Compares the far points of cells with the far ones and the border. rest: h, x, zone, region."""
        self.met(rest.where("zone = 2").select("h", "x", "region"), rest, ["h"], both=2)

    @staticmethod
    def work(rows: DataFrame, key: str, zone: int) -> DataFrame:
        """key, work (pairs of points of the zone with others, of different regions), pivots (some of the zone)."""
        own = F.col("zone") == zone
        drawn = [F.min(F.when(own, F.struct(F.xxhash64("x", F.lit(k)).alias("o"), "x"))).alias(f"x{k}") for k in range(PIVOTS)]
        parts = rows.groupBy(key, "region").agg(F.count_if(own).alias("k"), F.count("*").alias("n"), *drawn)
        work = F.sum("k") * F.sum("n") - F.sum(F.col("k") * F.col("n"))
        whole = parts.groupBy(key).agg(work.alias("work"), F.array(*(F.min(f"x{k}")["x"] for k in range(PIVOTS))).alias("pivots"))
        return materialize(whole.where("work > 0"), "work")

    def run(self, found: DataFrame) -> DataFrame:
        """point, region of the points that link. found: h, x, p (and others: further pivots)."""
        open_cells, crowded_before = found, None
        while True:
            zones, links = self.zones(open_cells)
            self.regions = merged(self.regions, links) if self.regions else components(links)
            zones = materialize(self.in_regions(zones), "zones")
            rest = materialize(open_cells.join(zones, ["x", "p"]).where("zone > 0").select("h", "x", "zone", "region"), "rest")
            inner, outer = self.work(zones.where("zone < 2"), "p", 1), self.work(rest, "h", 2)
            is_crowded = F.col("work") > FREQUENT * FREQUENT
            crowded = inner.union(outer).where(is_crowded).agg(F.coalesce(F.sum("work"), F.lit(0)).alias("n")).first().n
            # while pivots join or part the points the work gets clearly less; else these are leaves as they are
            go_on = crowded > 0 and (crowded_before is None or crowded < 0.5 * crowded_before)
            small = ~is_crowded if go_on else F.lit(True)
            self.borders(zones.where("zone < 2").join(inner.where(small), "p", "left_semi"))
            self.leaves(rest.join(outer.where(small), "h", "left_semi"))
            if not go_on:
                break
            crowded_before = crowded
            first, others = F.col("pivots")[0].alias("p"), F.array_distinct(F.slice("pivots", 2, PIVOTS)).alias("others")
            again = rest.join(outer.where(is_crowded), "h").select("h", "x", first, others)
            region = zones.where("zone < 2").join(inner.where(is_crowded), "p").select(F.xxhash64("p", F.col("pivots")[0]).alias("h"), "x", first, others)
            open_cells = materialize(again.union(region), "open")
            drop(zones, rest, inner, outer)
        pairs = self.pairs[0]
        for p in self.pairs[1:]:
            pairs = pairs.union(p)
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        a = self.in_regions(pairs).withColumnsRenamed({"region": "other", "x": "z", "y": "x"})
        pairs = materialize(self.in_regions(a).where("region <> other").select("x", F.col("z").alias("y")), "pairs")
        if not pairs.limit(1).count():
            return self.regions
        return merged(self.regions, self.measured(pairs).where(is_link()).select("x", "y"))


def links(docs: DataFrame, points: DataFrame) -> DataFrame:
    """point, region for the points that link with others. docs: doc_id, t, text."""
    found = cells(docs, points)
    longs = [F.first(f"s{k}").alias(f"s{k}") for k in range(LONGS)]
    names = points.where("n > 0").groupBy("point").agg(F.min("t").alias("t"), F.max("n").alias("n"), F.first("wide").alias("wide"), *longs)
    names = materialize(names.join(found.select(F.col("x").alias("point")).distinct(), "point", "left_semi"), "names")
    release(docs)
    return Join(docs, names).run(found)


def release(df: DataFrame) -> None:
    """Shuffle files of finished steps go once their plans are collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def grouped_points(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points (doc_id, t, n, point ...) of the rows of docs, and point, key: a key for each group of sets."""
    d = _keyed(docs)
    points = materialize(points_of(d), "points")
    with scratch(docs.sparkSession) as keep:
        regions = links(d, points)
        own = points.where("n > 0").select("point").distinct()
        keys = keep(materialize(own.join(regions, "point", "left").select("point", F.coalesce("region", "point").alias("key")), "keys"))
    release(docs)
    return points, keys


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the group) for each row of docs."""
    points, keys = grouped_points(docs)
    ids = points.where("n > 0").groupBy("point").agg(F.min("doc_id").alias("doc_id")).join(keys, "point")
    least = ids.groupBy("key").agg(F.min("doc_id").alias("component_id"))
    # a table of its own, so that a set with very many copies can be split in the join
    of = materialize(ids.join(least, "key").select("point", "component_id"), "components")
    rows = points.select("doc_id", "n", F.when(F.col("n") > 0, F.col("point")).alias("point")).join(of, "point", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of the rows of each group the first, by id (null last) and text; rows without a word all stay."""
    points, keys = grouped_points(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("t"))
    first = points.where("n > 0").join(keys, "point").groupBy("key").agg(F.min(place).alias("f")).select("f.*", F.lit(True).alias("first"))
    first = materialize(first, "first")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = F.col("doc_id").cast("long")
    d = docs.select(row, own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("worded"))
    d = d.join(first, ["none", "id", "t"], "left").where("first or not worded")
    again = W.partitionBy("none", "id", "t").orderBy(F.lit(0))
    return d.withColumn("k", F.row_number().over(again)).where("k = 1 or not worded").select("row.*")
