"""N-gram Jaccard join: shingles hashed into groups, group counts as points of an R-tree, exact sets for what its bounds leave."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import BASES, Scratch, Windows, components, mix, slices, table, word_hashes

GROUPS, LEAF, BLOCK = 256, 16, 1000
#: Parts' hashes are looked at in so many rounds, at every size: a round's shuffles go before the next one begins.
ROUNDS = 4
#: Pairs of points are compared in slices of SLICE, whose counts take 12 MB, and pairs of nodes are opened EXPANDED children pairs at a time.
SLICE, EXPANDED = 1 << 12, 1 << 16
#: Each class takes so many of its buckets along, the least ones, so that a pair of classes that meets in many is listed once.
FIRST = 32


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased; of a shorter text, one for all its words."""
    words = word_hashes(text.encode().lower()) if text else ()
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(k, len(words))
    found = np.unique(Windows(words, BASES[0]).of(n))
    return found if n == k else mix(found ^ np.uint64(n))


class SizeClasses:
    """Set sizes in steps of 1/t, so that sets with Jaccard t or more are in the same class or in neighbours.

    Two such sets, the larger in class K, differ in at most D(K) elements. Of m > D(K) parts of the hash range they agree in
    m - D(K) at least, so they share the content of a part. Empty parts say little: a set with fewer than m - D(K) of them
    leaves them out, as one of the agreeing parts then has elements; other (very small) sets list their empty parts too.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts, self.known = num, den, [1], {}

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return bisect_right(self.starts, n) - 1

    def parts(self, k: int) -> tuple[int, int]:
        """(m, D) of class k, with room for the empty parts that its smallest sets are likely to have."""
        while len(self.starts) <= k + 1:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        d = (self.den - self.num) * 2 * (self.starts[k + 1] - 1) // (self.den + self.num)
        m, least = d + 1, self.starts[max(0, k - 1)]
        for _ in range(8 * bool(d)):
            m = d + 3 + int(1.3 * m * np.exp(-least / m))
        return m, d

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the parts of a sorted set under its own class and the next."""
        k = self.of(len(s))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)])
        out = []
        for scheme in (k, k + 1):
            m, d = self.known[scheme] = self.known.get(scheme) or self.parts(scheme)
            part = np.arange(m + 1, dtype=np.float64) * (2.0**64 / m)
            cut = np.concatenate([[0], np.searchsorted(s, part[1:-1].astype(np.uint64)), [len(s)]])
            which = np.arange(m, dtype=np.uint64) + np.uint64(scheme << 40)
            sig = mix(mix(sums[cut[1:]] - sums[cut[:-1]] + which * np.uint64(BASES[1])) + which)
            full = cut[1:] > cut[:-1]
            out.append(sig[full] if m - int(full.sum()) < m - d else sig)
        return np.concatenate(out)


_SCAN = "doc_id long, n long, c1 long, c2 long, point binary, sig long"


def _scan(k: int, num: int, den: int):
    """A row per text with its set's size, digest and counts, and rows of its parts' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(num, den)
        for batch in batches:
            for part in slices(batch, "text"):
                heads, points, sigs, owners = [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    s = shingles(text, k)
                    both = xxhash.xxh3_128_intdigest(s.tobytes())
                    heads.append((doc, len(s), (both >> 64) - 2**63, (both & (2**64 - 1)) - 2**63))
                    points.append(point(s))
                    if len(s) and doc is not None:
                        sigs.append(classes.signatures(s).view(np.int64))
                        owners.append(np.full(len(sigs[-1]), doc, np.int64))
                names, n = ["doc_id", "n", "c1", "c2", "point", "sig"], len(heads)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*heads, strict=True)), pa.array(points, pa.binary()), pa.nulls(n, pa.int64())], names)
                if sigs:
                    sig = np.concatenate(sigs)
                    none = pa.nulls(len(sig), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(owners)), none, none, none, pa.nulls(len(sig), pa.binary()), pa.array(sig)], names)

    return run


def point(s: np.ndarray) -> bytes:
    """Counts of a set's hashes by group, as unsigned 32-bit numbers."""
    return np.bincount((s >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS).astype("<u4").tobytes()


def points_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, GROUPS)


def _elements(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = [shingles(t, k) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n", "elements"])

    return run


def needed(sizes, num: int, den: int):
    """The least overlap of sets whose sizes add up to ``sizes``: den*o >= num*(sizes - o)."""
    return -(-num * sizes // (num + den))


class RTrees:
    """A tree for each bucket, side by side in arrays. Points are packed by size and counts into boxes of LEAF, and boxes into
    boxes, up to one root a bucket; a node keeps its greatest counts and its least size. first[d][i] is node i's first child."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, bucket: np.ndarray):
        half = points[:, : GROUPS // 2].sum(1, dtype=np.int64)
        self.order = np.lexsort([half, sizes // max(1, int(sizes.max()) // 50), bucket])
        hi, low, owner = points[self.order], sizes[self.order], bucket[self.order]
        self.levels, self.first = [(hi, low)], []
        while True:
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            if len(starts) == len(owner):
                break
            place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(owner)]])))
            cut = np.flatnonzero(place % LEAF == 0)
            hi, low, owner = np.maximum.reduceat(hi, cut), np.minimum.reduceat(low, cut), owner[cut]
            self.first.append(np.concatenate([cut, [len(self.levels[-1][1])]]))
            self.levels.append((hi, low))

    def pairs(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound): all pairs of a bucket's points whose summed minima, the bound, reach the overlap that their sizes need."""
        a = b = np.arange(len(self.levels[-1][1]))
        bound = np.zeros(0, np.int64)
        for depth in range(len(self.levels) - 2, -1, -1):
            step = max(1, EXPANDED // LEAF**2)
            kept = [self._children(a[k : k + step], b[k : k + step], depth, num, den) for k in range(0, len(a), step)]
            a, b, bound = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (a, b, bound)
        if len(self.levels) == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), bound
        return self.order[a], self.order[b], bound

    def _children(self, a: np.ndarray, b: np.ndarray, depth: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, bound): the pairs of children of the pairs of nodes (a, b) that may hold a pair of points that link."""
        hi, low = self.levels[depth]
        first = self.first[depth]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        total = na * nb
        at = np.repeat(np.arange(len(a)), total)
        within = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
        a, b = first[a[at]] + within // nb[at], first[b[at]] + within % nb[at]
        ok = (a <= b) if depth else (a < b)
        a, b = a[ok], b[ok]
        bound = np.zeros(len(a), np.int64)
        for k in range(0, len(a), SLICE):
            i, j = a[k : k + SLICE], b[k : k + SLICE]
            bound[k : k + SLICE] = np.minimum(hi[i], hi[j]).sum(1, dtype=np.int64)
        keep = bound >= needed(low[a] + low[b], num, den)
        return a[keep], b[keep], bound[keep]


def _from_trees(keys: list[str], pick, pairs: int = 1 << 20):
    """Runs of rows with equal keys become trees, as many at once as can have about ``pairs`` pairs, where a point
    counts as GROUPS pairs; pick makes a batch of what they leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            now = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            k = np.stack([now.column(c).to_numpy().astype(np.int64) for c in keys], 1)
            new = np.concatenate([[True], (k[1:] != k[:-1]).any(1)])
            cuts = np.concatenate([np.flatnonzero(new), [now.num_rows] * (batch is None)]).astype(np.int64)
            bucket = np.cumsum(new)
            cost = np.cumsum(np.diff(cuts) ** 2 + GROUPS * np.diff(cuts))
            at = 0
            while at < len(cuts) - 1:
                to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + pairs, "right")))
                lo, hi = int(cuts[at]), int(cuts[to])
                if hi - lo > 1 and (found := pick(now.slice(lo, hi - lo), bucket[lo:hi])) is not None:
                    yield found
                at = to
            rest = now.slice(int(cuts[-1]))

    return run


def _likeliest(num: int, den: int):
    """For each class of a bucket, of the classes with smaller ids that the tree leaves, the one with the greatest possible similarity."""

    def pick(t: pa.Table, bucket: np.ndarray) -> pa.RecordBatch | None:
        ids, sizes = t.column("id").to_numpy(), t.column("n").to_numpy()
        i, j, bound = RTrees(points_of(t.column("point")), sizes, bucket).pairs(num, den)
        if not len(i):
            return None
        most = bound / (sizes[i] + sizes[j] - bound)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        order = np.lexsort([a, -most, b])
        order = order[np.concatenate([[True], np.diff(b[order]) != 0])]
        return pa.RecordBatch.from_arrays([pa.array(a[order]), pa.array(b[order]), pa.array(most[order])], ["a", "b", "most"])

    return _from_trees(["sig", "x"], pick)


def met_before(first: np.ndarray, sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows (i, j) of a bucket sig[i] are known to share a smaller bucket. first: a row's least buckets, in order."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), SLICE):
        p, q = i[k : k + SLICE], j[k : k + SLICE]
        both = np.sort(np.concatenate([first[p], first[q]], 1), axis=1)
        out[k : k + SLICE] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < sig[p][:, None])).any(1)
    return out


def _cross(num: int, den: int):
    """All pairs of different components that the trees leave, but those that share a smaller bucket. side 0/1: only across, 2: all.

    Two classes of different components are compared in each bucket that has both, and always with the same bound, so a pair
    that is left out here is found in the smallest one.
    """

    def pick(t: pa.Table, bucket: np.ndarray) -> pa.RecordBatch | None:
        ids, comp, side, sig = (t.column(c).to_numpy() for c in ("id", "comp", "side", "sig"))
        i, j, _ = RTrees(points_of(t.column("point")), t.column("n").to_numpy(), bucket).pairs(num, den)
        ok = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] == 2))
        i, j = i[ok], j[ok]
        lists = t.column("first").combine_chunks()
        first = np.full((len(ids), FIRST), np.iinfo(np.int64).max)
        first[np.arange(FIRST) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
        ok = ~met_before(first, sig, i, j)
        if not ok.any():
            return None
        a, b = ids[i[ok]], ids[j[ok]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return _from_trees(["sig", "x", "y"], pick)


def _bound(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                p, q = points_of(batch.column("pa")), points_of(batch.column("pb"))
                total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                ok = np.minimum(p, q).sum(1, dtype=np.int64) >= needed(total, num, den)
                yield batch.select(["a", "b", "na"]).filter(pa.array(ok))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for p, q in zip(batch.column("pa"), batch.column("pb"), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), max(0, len(q) - 1))
                both = int((q[at] == p).sum()) if len(q) else 0
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _linked(pairs: DataFrame, points: DataFrame, docs: DataFrame, k: int, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Of distinct pairs (a, b), those that link: first by their points, then by their sets, which only texts get whose points allow a link.

    Sets travel with pairs, so pairs are dealt into so many rounds that each moves about twice what all these sets hold.
    """

    def with_both(p: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
        for end in "ab":
            named = sets.select(F.col("id").alias(end), *(F.col(c).alias(to + end) for c, to in zip(cols, "pn", strict=False)))
            p = p.join(named, end)
        return p

    if pairs.isEmpty():
        return pairs.select("a", "b")
    left = with_both(pairs, points, "point", "n").select("a", "b", "pa", "pb", "na", "nb").mapInArrow(_bound(num, den), "a long, b long, na long")
    left = scratch.write(left, "bounded")
    if left.isEmpty():
        return left.select("a", "b")
    ends = scratch.write(left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
    sets = scratch.write(docs.join(ends, "doc_id").mapInArrow(_elements(k), "id long, n long, elements binary"), "elements")
    moved = left.agg(F.coalesce(F.sum("na"), F.lit(0))).first()[0]
    held = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rounds = max(1, -(-moved // max(1, 2 * held)))
    out = None
    for r in range(rounds):
        some = left.select("a", "b") if rounds == 1 else left.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == r).select("a", "b")
        found = scratch.write(with_both(some, sets, "elements").select("a", "b", "pa", "pb").mapInArrow(_verify(num, den), "a long, b long"), "links")
        out = found if out is None else out.unionByName(found)
    scratch.drop(ends, sets, left)
    return out


def _classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n, id) per row: the smallest doc_id with an equal set; null for empty sets and null doc_ids."""
    able = rows.where("n > 0 and doc_id is not null")
    least = scratch.write(able.groupBy("c1", "c2").agg(F.min("doc_id").alias("id")), "classes")
    named = able.join(least, ["c1", "c2"]).select("doc_id", "n", "id")
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("id"))
    return scratch.write(named.unionByName(rest), "rows")


def _buckets(scan: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, id, low, m) of classes that share a part's content, with the bucket's smallest id and size. Of buckets with the same members one stays."""
    ids = scratch.write(rows.where("id is not null").select("doc_id", "id").distinct(), "ids")
    shared = []
    for r in range(ROUNDS):
        sigs = scan.where(F.col("sig").isNotNull() & (F.pmod("sig", F.lit(ROUNDS)) == r)).select("sig", "doc_id")
        often = sigs.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("sig")
        often = scratch.write(often, "often")  # grows with the documents: never broadcast, at any size
        shared.append(scratch.write(sigs.join(often.hint("merge"), "sig").join(ids, "doc_id").select("sig", "id").distinct(), "hits"))
        scratch.drop(often)
    scratch.drop(ids, scan)
    hits = shared[0]
    for more in shared[1:]:
        hits = hits.unionByName(more)
    members = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"k{k}") for k in (1, 2)]
    kept = hits.groupBy("sig").agg(F.min("id").alias("low"), F.count("*").alias("m"), *members).where("m > 1")
    kept = scratch.write(kept.groupBy("low", "m", "k1", "k2").agg(F.min("sig").alias("sig")).select("sig", "low", "m"), "kept")
    buckets = scratch.write(hits.join(kept, "sig").select("sig", "id", "low", "m"), "buckets")
    scratch.drop(*shared, kept)
    return buckets


def _meetings(now: DataFrame, points: DataFrame, scratch: Scratch, num: int, den: int, block: int) -> DataFrame:
    """One pair for each two components that meet in a bucket: of their smallest members there, those that meet most often."""
    heads = scratch.write(now.groupBy("sig", "lo", "comp").agg(F.min("id").alias("head")), "heads")
    base = heads.where("comp = lo").select("sig", F.col("head").alias("a"))
    met = heads.where("comp <> lo").join(base, "sig").groupBy("lo", "comp", "a", F.col("head").alias("b")).agg(F.count("*").alias("m"))
    met = met.groupBy("lo", "comp").agg(F.max_by(F.struct("a", "b"), F.struct("m", -F.col("a"), -F.col("b"))).alias("p"))
    return met.select(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).distinct()


def _across(now: DataFrame, points: DataFrame, scratch: Scratch, num: int, den: int, block: int) -> DataFrame:
    """All pairs of different components that the trees leave. A component of over ``block`` of a bucket's rows has its own blocks, which don't meet."""
    counts = scratch.write(now.groupBy("sig", "comp").agg(F.count("*").alias("c")), "counts")
    blocks = F.ceil(F.col("c") / block).cast("int")
    small = counts.where(F.col("c") < block).groupBy("sig").agg(F.ceil(F.sum("c") / block).cast("int").alias("ns"))
    whole = counts.groupBy("sig").agg(F.sum(F.when(F.col("c") >= block, blocks).otherwise(0)).cast("int").alias("nw"))
    size = scratch.write(whole.join(small, "sig", "left").select("sig", F.coalesce("ns", F.lit(0)).alias("ns"), "nw"), "sizes")
    before = F.sum(blocks).over(Window.partitionBy("sig").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1))
    own = counts.where(F.col("c") >= block).select("sig", "comp", blocks.alias("n_own"), F.coalesce(before, F.lit(0)).cast("int").alias("at"))
    own = scratch.write(own, "own")
    dealt = now.select("sig", "id", "comp").join(size, "sig").join(own, ["sig", "comp"], "left")
    at = F.col("ns") + F.col("at")
    mine = F.when(F.col("n_own").isNull(), F.pmod(F.xxhash64("id"), F.col("ns"))).otherwise(at + F.pmod(F.xxhash64("id"), F.col("n_own"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("ns") + F.col("nw") - 1), lambda k: F.col("n_own").isNull() | (k < at) | (k >= at + F.col("n_own")))
    dealt = dealt.withColumns({"mine": mine, "other": F.explode(others)})
    dealt = dealt.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    dealt = dealt.withColumn("side", F.when(F.col("x") == F.col("y"), 2).otherwise((F.col("mine") == F.col("y")).cast("int")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("sig"))
    first = now.select("id", "sig").withColumn("rank", rank).where(F.col("rank") <= FIRST).groupBy("id").agg(F.sort_array(F.collect_list("sig")).alias("first"))
    named = scratch.write(points.select("id", "n", "point").join(first, "id"), "named")
    dealt = dealt.select("sig", "x", "y", "side", "id", "comp").join(named, "id")
    dealt = dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y")
    return dealt.mapInArrow(_cross(num, den), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: texts link when den * |A & B| >= num * |A | B| of their sets of shingles.

    Equal sets, copies and repeated rows among them, are one class. Classes that share the content of a part (SizeClasses) are dealt to a bucket, whose classes'
    count vectors are the points of an R-tree. Of the pairs that the trees leave, each class's likeliest one with a smaller
    class is verified by whole sets; then, for components that still meet in a bucket, one pair of members; then all pairs
    that the trees leave between different components. Components are exact; a pair inside a component needs no verifying.

    A bucket of over ``block`` classes is dealt to trees of about ``block`` points, each with the bucket's smallest class;
    in the last step blocks meet in pairs, but none of the same component.

    Null and empty texts have no shingles and link with nothing. Null doc_ids link with nothing; their component is null.
    Rows that repeat a doc_id are one node, and each gets a row. Very long texts are read whole, one at a time. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scan = scratch.write(docs.mapInArrow(_scan(words, num, den), _SCAN), "scan")
    heads = scratch.write(scan.where("n is not null").select("doc_id", "n", "c1", "c2", "point"), "heads")
    rows = _classes(heads.drop("point"), scratch)
    buckets = _buckets(scan, rows, scratch)
    wanted = scratch.write(buckets.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    points = scratch.write(heads.where("n > 0").join(wanted, "doc_id").select(F.col("doc_id").alias("id"), "n", "point").distinct(), "points")
    scratch.drop(heads)

    # for each class, the likeliest pair that the trees of its buckets leave
    nb = F.ceil(F.col("m") / block).cast("int")
    dealt = buckets.select("sig", F.pmod(F.xxhash64("id"), nb).cast("int").alias("x"), "id")
    lows = buckets.where((F.col("id") == F.col("low")) & (nb > 1)).select("sig", "id", nb.alias("nb"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("x"))
    lows = lows.where(F.pmod(F.xxhash64("id"), F.col("nb")) != F.col("x")).select("sig", "x", "id")
    dealt = dealt.unionByName(lows).join(points.select("id", "n", "point"), "id")
    dealt = dealt.select("sig", "x", "id", "n", "point").repartition("sig", "x").sortWithinPartitions("sig", "x")
    tried = dealt.mapInArrow(_likeliest(num, den), "a long, b long, most double").groupBy("b").agg(F.max_by("a", F.struct("most", -F.col("a"))).alias("a"))
    tried = scratch.write(tried.select("a", "b"), "likeliest")
    found = components(_linked(tried, points, docs, words, scratch, num, den), scratch)

    def mixed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Buckets' rows with their components, and the buckets that have more than one."""
        now = buckets.select("sig", "id").join(found, F.col("id") == F.col("node"), "left").select("sig", "id", F.coalesce("component", "id").alias("comp"))
        several = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "lo")
        several = scratch.write(several, "several")
        return scratch.write(now.join(several, "sig"), "mixed"), several

    def joined(found: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return found
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), scratch)

    for step in (_meetings, _across):
        now, several = mixed(found)
        if several.isEmpty():
            break
        pairs = scratch.write(step(now, points, scratch, num, den, block).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = joined(found, _linked(pairs, points, docs, words, scratch, num, den))
        tried = tried.unionByName(pairs)
    scratch.drop(buckets, points)
    known = rows.where("id is not null").join(found, F.col("id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "id").alias("component_id"))
    alone = rows.where("id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumnRenamed("n", "n_shingles")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), 3, 90, 100)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[p:p + 2], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.a, reach.r FROM links l JOIN reach ON l.b = reach.doc_id WHERE reach.r < l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""
