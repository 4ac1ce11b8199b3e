"""Vector operators over array columns: norms, cosine top-k, affinities, softmax, contrastive loss, recall, 1-D transport."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import Rounds
from .ordered import running


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column, eps: float = 1e-8) -> Column:
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.get(F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m)), 0)  # a bound variable, so that the norm is made once a row


def pairs_in_blocks(df: DataFrame, block: str, key: str, vector: str) -> DataFrame:
    """(block, i, j, sim): cosine of different rows of a block. Blocks bound the number of pairs; none spans two blocks."""
    a = df.select(F.col(block).alias("block"), F.col(key).alias("i"), normalized(F.col(vector)).alias("a"))
    b = a.select("block", F.col("i").alias("j"), F.col("a").alias("b"))
    return a.join(b, "block").where("i <> j").select("block", "i", "j", dot(F.col("a"), F.col("b")).alias("sim"))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "i").orderBy(F.desc("sim"), "j")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gaussian_affinity(pairs: DataFrame, k: int) -> DataFrame:
    """exp(-d2 / 2 sigma2) of each row's k nearest, made symmetric by the greater; sigma2 is the block's lower median d2."""
    d = pairs.withColumn("d2", F.greatest(2 - 2 * F.round("sim", 9), F.lit(0.0)))
    sigma = d.groupBy("block").agg((F.percentile_disc("d2", 0.5) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d2)")).alias("s2"))
    near = top_k(d, k).join(sigma, "block").withColumn("a", F.exp(-F.col("d2") / (2 * (F.col("s2") + 1e-8) + 1e-8)))
    both = near.select("block", "i", "j", "a").unionByName(near.select("block", F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    return both.groupBy("block", "i", "j").agg(F.max("a").alias("a"))


def diffusion_step(affinity: DataFrame) -> DataFrame:
    """Row-normalised affinities times themselves: two steps of the walk, as a join on the middle node."""
    w = Window.partitionBy("block", "i")
    p = affinity.withColumn("p", F.col("a") / (F.sum("a").over(w) + 1e-8)).select("block", "i", "j", "p")
    q = p.select("block", F.col("i").alias("j"), F.col("j").alias("k"), F.col("p").alias("q"))
    return p.join(q, ["block", "j"]).groupBy("block", "i", F.col("k").alias("j")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def row_softmax(pairs: DataFrame, alpha: float) -> DataFrame:
    w = Window.partitionBy("block", "i")
    e = F.exp((F.col("sim") - F.max("sim").over(w)) / alpha)
    return pairs.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(w)).drop("e")


def wasserstein_1d(df: DataFrame, group: list[str], side: Column, value: Column) -> DataFrame:
    """Area between the distribution functions of a group's two sides (side: 0 or 1); null where one side is empty. Counts per
    value come first, and their running sums go by ranges of values, so a large group is no single task."""
    t = df.select(*group, side.alias("s"), value.alias("x")).groupBy(*group, "x").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    whole = t.groupBy(*group).agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    run = running(t, group, "x", ["a", "b"]).join(whole, group)
    gap = F.abs(F.try_divide("run_a", "all_a") - F.try_divide("run_b", "all_b")) * (F.col("next") - F.col("x"))
    return run.groupBy(*group).agg(F.when((F.max("all_a") > 0) & (F.max("all_b") > 0), F.coalesce(F.sum(gap), F.lit(0.0))).alias("w1"))


def two_view_pairs(df: DataFrame, block: str, key: str, left: Column, right: Column) -> DataFrame:
    """(block, i, j, sim): cosine of row i's left vector and row j's right one, i = j included, inside a block."""
    a = df.select(F.col(block).alias("block"), F.col(key).alias("i"), normalized(left).alias("a"))
    b = df.select(F.col(block).alias("block"), F.col(key).alias("j"), normalized(right).alias("b"))
    return a.join(b, "block").select("block", "i", "j", dot(F.col("a"), F.col("b")).alias("sim"))


def infonce(pairs: DataFrame, tau: float = 0.07) -> DataFrame:
    """(block, loss): mean over both directions of -log softmax(sim / tau) at i = j."""
    x = pairs.withColumn("x", F.col("sim") / tau)

    def direction(end: str) -> DataFrame:
        top = x.withColumn("m", F.max("x").over(Window.partitionBy("block", end)))
        return top.groupBy("block", end).agg((F.max("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m")))) - F.max(F.when(F.col("i") == F.col("j"), F.col("x")))).alias("l")).select("block", "l")

    return direction("i").unionByName(direction("j")).groupBy("block").agg(F.avg("l").alias("loss"))


def recall_at_k(pairs: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(block, recall_k ...): share of rows whose own partner is among the k most similar, mean of both directions."""

    def direction(end: str, other: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy("block", end).orderBy(F.desc("sim"), other))
        return pairs.withColumn("r", r).where("i = j").select("block", "r")

    both = direction("i", "j").unionByName(direction("j", "i"))
    return both.groupBy("block").agg(*(F.avg((F.col("r") <= k).cast("double")).alias(f"recall_{k}") for k in ks))


def field_pool(fields: list[tuple[Column, Column, float]], eps: float = 1e-8) -> Column:
    """Weighted mean of vectors: sum(w * m * e) / (sum(w * m) + eps) over (vector, presence, weight)."""
    total = sum((m.cast("double") * w for _, m, w in fields), F.lit(0.0)) + eps

    def scale(v: Column, m: Column, w: float) -> Column:
        return F.transform(v, lambda x: x.cast("double") * m.cast("double") * w)

    scaled = [scale(*f) for f in fields]
    out = scaled[0]
    for s in scaled[1:]:
        out = F.zip_with(out, s, lambda x, y: x + y)
    return F.transform(out, lambda x: x / total)


def mutation_features(ref: Column, alt: Column) -> Column:
    """ref, alt, alt - ref, |alt - ref| and alt * ref, end to end."""
    delta = F.zip_with(ref, alt, lambda r, a: a - r)
    return F.concat(ref, alt, delta, F.transform(delta, F.abs), F.zip_with(ref, alt, lambda r, a: a * r))


def centroid_distances(df: DataFrame, block: str, vector: str) -> DataFrame:
    """(a, b, d2): squared distances of the blocks' mean vectors, the coarse level of a two-level diffusion. It has a row per pair of blocks, not of rows."""
    mean = df.select(F.col(block).alias("block"), F.posexplode(vector).alias("at", "x")).groupBy("block", "at").agg(F.avg("x").alias("x"))
    other = mean.select(F.col("block").alias("b"), "at", F.col("x").alias("y"))
    return mean.join(other, "at").where("block < b").groupBy(F.col("block").alias("a"), "b").agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("d2"))


# ---- every row against every row (of the table or of a group), a pair of blocks at a time ----
#: A table is dealt into at most BLOCKS blocks, so that what is shuffled grows as the table does; only where a block's vectors would
#: hold over LARGE numbers there are more. Products are made in tiles of so many rows and columns.
BLOCKS, SMALL, LARGE, TILE = 16, 500, 4_000_000, (512, 1024)


class Blocks:
    """A block of the left rows x (i, ...; vectors a) and one of the right rows y (j, ...; vectors b), both sorted by key."""

    def __init__(self, x: pd.DataFrame, y: pd.DataFrame, a: np.ndarray, b: np.ndarray):
        self.x, self.y, self.a, self.b, self.i, self.j = x, y, a, b, x["i"].to_numpy(), y["j"].to_numpy()
        low, high = np.searchsorted(self.j, self.i, "left"), np.searchsorted(self.j, self.i, "right")
        self._rows = np.repeat(np.arange(len(x)), high - low)
        self._columns = np.arange(len(self._rows)) - np.repeat(np.cumsum(high - low) - high, high - low)

    @classmethod
    def of(cls, x: pd.DataFrame, y: pd.DataFrame) -> Blocks:
        x, y = x.sort_values("i", kind="stable", ignore_index=True), y.sort_values("j", kind="stable", ignore_index=True)
        return cls(x.drop(columns="a"), y.drop(columns="b"), np.stack(x["a"]).astype(float), np.stack(y["b"]).astype(float))

    def finite(self) -> Blocks:
        """Without the rows whose vectors hold no number somewhere."""
        left, right = np.isfinite(self.a).all(1), np.isfinite(self.b).all(1)
        return self if left.all() and right.all() else Blocks(self.x[left], self.y[right], self.a[left], self.b[right])

    def tiles(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows, columns, products a . b), row by row and by rising columns; the products may be written over."""
        for r in range(0, len(self.a), TILE[0]):
            for c in range(0, len(self.b), TILE[1]):
                yield slice(r, r + TILE[0]), slice(c, c + TILE[1]), self.a[r : r + TILE[0]] @ self.b[c : c + TILE[1]].T

    def same(self, r: slice, c: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places in a tile where left and right key are equal."""
        k = slice(*np.searchsorted(self._rows, (r.start, r.stop)))
        rows, columns = self._rows[k] - r.start, self._columns[k] - c.start
        inside = (columns >= 0) & (columns < c.stop - c.start)
        return rows[inside], columns[inside]


def rounded(sim: np.ndarray) -> np.ndarray:
    """np.round(sim, 9) in place."""
    np.multiply(sim, 1e9, out=sim)
    np.rint(sim, out=sim)
    return np.divide(sim, 1e9, out=sim)


def dealt(df: DataFrame, vector: str, own: str, per_block: int) -> tuple[DataFrame, DataFrame | int]:
    """df with the number ``own`` of each row's block and ``n_own``, the number of blocks (of its group, with a column ``block``), and these numbers."""
    rows, width = df.agg(F.count("*"), F.max(F.size(vector))).first()
    size = max(1, min(max(per_block, -(-rows // BLOCKS)), LARGE // max(width or 1, 1)))
    # by the row's own values: a row that is computed again, say after a join, falls into the same block
    place = lambda n: F.pmod(F.xxhash64(*(c for c in ("i", "j", "a", "b") if c in df.columns)), n).cast("int")
    if "block" not in df.columns:
        n = max(1, -(-rows // size))
        return df.withColumn(f"n_{own}", F.lit(n)).withColumn(own, place(F.lit(n))), n
    sizes = df.where("block is not null").groupBy("block").agg(F.ceil(F.count("*") / size).cast("int").alias(f"n_{own}"))
    sizes = sizes.select(F.col("block").alias("__of"), f"n_{own}")
    return df.join(sizes, F.col("block") == F.col("__of")).withColumn(own, place(F.col(f"n_{own}"))).drop("__of"), sizes


def block_products(left: DataFrame, right: DataFrame, run: Callable[[Blocks], pd.DataFrame], schema: str, per_block: int = SMALL) -> DataFrame:
    """run(blocks) for every pair of a block of ``left`` (i, a, ...) and one of ``right`` (j, b, ...).

    Each pair of rows is met once, whatever their keys; where both sides have a column ``block``, only rows with equal ones meet (null: none).
    run() folds a pair of blocks tile by tile and gives a few rows for each row of them. The work is quadratic in the rows; the
    memory of a task is not, and neither is what is shuffled: a table has at most BLOCKS blocks (of ``per_block`` rows or more) until a block would hold
    over LARGE numbers. Both sides are read twice, so what costs much to compute is written first. A column that both sides have ends in
    "__r" on the right: Spark keeps one of two equal columns.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    grouped = "block" in left.columns

    def deal(df: DataFrame, vector: str, own: str) -> tuple[DataFrame, DataFrame | int]:
        out, n = dealt(df, vector, own, per_block)
        return out.drop(f"n_{own}"), n

    def against(df: DataFrame, other: str, n: DataFrame | int) -> DataFrame:
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        if not grouped:
            return df.withColumn(other, spread(F.lit(n)))
        return df.join(n, F.col("block") == F.col("__of")).withColumn(other, spread(F.col(f"n_{other}"))).drop(f"n_{other}", "__of")

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({c: [] for c in names})
        return run(Blocks.of(x, y.rename(columns=lambda c: c.removesuffix("__r"))))[names]

    (a, m), (b, n) = deal(left, "a", "p"), deal(right, "b", "q")
    x, y = against(a, "q", n), against(b, "p", m)
    x, y = (x.groupBy("block", "p", "q"), y.withColumnRenamed("block", "block__r").groupBy("block__r", "p", "q")) if grouped else (x.groupBy("p", "q"), y.groupBy("p", "q"))
    return x.cogroup(y).applyInPandas(both, schema)


def _sides(df: DataFrame, key: str, vector: str, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without a key or a vector meet no other row."""
    group = [F.col(by).cast("long").alias("block")] if by else []
    a = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(*group, F.col(key).cast("long").alias("i"), normalized(F.col(vector)).alias("a"))
    return a, a.select(*(["block"] if by else []), F.col("i").alias("j"), F.col("a").alias("b"))


def k_best(t: Blocks, k: int, value: Callable[[slice, slice, np.ndarray], np.ndarray], exact: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], above: Callable[[np.ndarray], np.ndarray], slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, columns): the k greatest scores of each row, ties by column; -inf where a row has fewer.

    value(rows, columns, products) gives a tile's approximate scores (-inf: none), exact(rows, columns, values) those of chosen places; two of them that
    are ``slack`` apart have that order in both. Only what beats a row's k-th score so far (above() of it) is looked at exactly.
    """
    best, who = np.full((len(t.a), k), -np.inf), np.full((len(t.a), k), -1)
    for r, c, s in t.tiles():
        s = value(r, c, s)
        last = best[r, -1]
        low = above(last)
        open_ = np.flatnonzero(np.isneginf(last))
        if len(open_):
            m = min(k, s.shape[1])
            low[open_] = np.partition(s[open_], s.shape[1] - m, axis=1)[:, s.shape[1] - m] - slack
        row, column = np.nonzero(s > low[:, None])
        if not len(row):
            continue
        score = exact(row + r.start, column + c.start, s[row, column])
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, k), row])
        score = np.concatenate([best[r][rows].ravel(), score])
        column = np.concatenate([who[r][rows].ravel(), column + c.start])
        order = np.lexsort((column, -score, row))
        row, score, column = row[order], score[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        best[row[kept] + r.start, place[kept]], who[row[kept] + r.start, place[kept]] = score[kept], column[kept]
    return best, who


# ---- a table's rows against one another: each pair of blocks once, float products first ----
ONE = 10**9
#: Distances are counted in at most FINE ranges at a time. A tile in which more than DENSE of the products are looked at exactly is made anew in
#: double precision. A block gives at most GUESSES tiles to the first guess of a median.
FINE, DENSE, GUESSES = 1 << 20, 0.02, 64
FOLDED = "block long, i long, j long, sim double, v long, n long"


class Cosine:
    """Scores are cosines of unit vectors, rounded to 9 places; a distance 1 - cosine is a whole number of 10^-9."""

    most, rounding, unit = 1.0, 5e-10, 1 / ONE

    def sides(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose products are the scores."""
        return a, b

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.round(np.einsum("ij,ij->i", a, b), 9)

    def units(self, score: np.ndarray) -> np.ndarray:
        return np.clip(ONE - np.rint(score * ONE), 0, 2 * ONE).astype(np.int64)

    def score(self, units: float) -> float:
        return 1 - units / ONE


COSINE = Cosine()


class Best:
    """The k greatest scores of each row so far, ties by column; -inf where there are fewer."""

    def __init__(self, rows: int, k: int):
        self.k, self.score, self.who = k, np.full((rows, k), -np.inf), np.full((rows, k), -1)

    def low(self, rows: np.ndarray, s: np.ndarray, error: float, metric: Cosine, first: int) -> np.ndarray:
        """What a score of s (a row for each of ``rows``, off by at most ``error``; columns from ``first`` on) must be over to get on the list."""
        last = self.score[rows, -1]
        low = last - error - metric.rounding
        low[(last >= metric.most) & (self.who[rows, -1] < first)] = np.inf  # the list is full of the greatest score, and later columns lose ties
        open_ = np.flatnonzero(np.isneginf(last))
        if len(open_):
            at = s.shape[1] - min(self.k, s.shape[1])
            low[open_] = np.partition(s[open_], at, axis=1)[:, at] - 2 * error - 4 * metric.rounding
        return low.astype(s.dtype)

    def put(self, row: np.ndarray, column: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.score[row, -1]
        row, column, score = row[good], column[good], score[good]
        if not len(row):
            return
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, self.k), row])
        score = np.concatenate([self.score[rows].ravel(), score])
        column = np.concatenate([self.who[rows].ravel(), column])
        order = np.lexsort((column, -score, row))
        row, score, column = row[order], score[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.score[row[kept], place[kept]], self.who[row[kept], place[kept]] = score[kept], column[kept]


class Products:
    """Scores of the rows a and b as float products, with a bound of their error, or as double ones."""

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: Cosine):
        self.a, self.b, self.metric = a, b, metric
        self.wide = metric.sides(a, b)
        self.size = [np.sqrt(np.einsum("ij,ij->i", x, x)) for x in self.wide]
        self.float = all(x.max(initial=0) < 1e18 for x in self.size)
        self.narrow = [x.astype(np.float32) for x in self.wide] if self.float else self.wide

    def tile(self, r, c, double: bool = False) -> tuple[np.ndarray, float]:
        """(scores, error) of the rows r and columns c."""
        a, b = self.wide if double or not self.float else self.narrow
        bound = (a.shape[1] + 16) * self.size[0][r].max(initial=0) * self.size[1][c].max(initial=0)
        return a[r] @ b[c].T, bound * (2.0**-53 if a.dtype == np.float64 else 2.0**-24) + 1e-30

    def exact(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), 1 << 15):
            part = slice(at, at + (1 << 15))
            out[part] = self.metric.exact(self.a[row[part]], self.b[column[part]])
        return out


def folded(t: Blocks, own: bool, metric: Cosine, k: int, counting: bool = False) -> pd.DataFrame:
    """A pair of blocks as rows of FOLDED: each row's k best of the other block (i, j, sim) and, ``counting``, the pairs in ranges (v, n).

    x has the columns lo, hi, shift then: units of lo up to hi are counted in ranges v of 2^shift, v = -1 are all below and -2 all pairs. Float products
    tell which pairs need an exact look. ``own``: both blocks are one, and its pairs come from both sides.
    """
    block = int(t.x["block"].iloc[0]) if "block" in t.x else 0
    lo, hi, shift = (int(t.x[c].iloc[0]) for c in ("lo", "hi", "shift")) if counting else (0, 0, 0)
    t = t.finite()
    products, twice = Products(t.a, t.b, metric), 1 if own else 2
    lists = [Best(len(x), k) for x in ((t.a,) if own else (t.a, t.b))] if k else []
    ranges, below, every, kept = np.zeros((max(hi - lo - 1, 0) >> shift) + 1, np.int64), 0, 0, []

    def count_kept() -> None:
        if kept:
            ranges[:] += np.bincount(np.concatenate(kept), minlength=len(ranges))
            kept.clear()

    def look(r: slice, c: slice, same: tuple[np.ndarray, np.ndarray], double: bool):
        s, error = products.tile(r, c, double)
        s[same] = -np.inf
        places = (np.arange(r.start, r.start + s.shape[0]), np.arange(c.start, c.start + s.shape[1]))
        hits = [np.flatnonzero(s > (best.low(p, s, error, metric, c.start)[:, None] if side == 0 else best.low(p, s.T, error, metric, r.start)[None, :])) for side, (best, p) in enumerate(zip(lists, places))]
        near, inside = 0, np.zeros(0, np.int64)
        if counting:
            margin, least = error + 2 * metric.unit, float(np.finfo(s.dtype).min)
            top = metric.score(lo) + margin if lo > 0 else np.inf
            there = s >= s.dtype.type(max(metric.score(hi) - margin, least))
            near = np.count_nonzero(there)
            there &= s <= s.dtype.type(top)
            inside = np.flatnonzero(there)
            near -= len(inside)
        return s, hits, near, inside

    for r0 in range(0, len(t.a), TILE[0]):
        for c0 in range(0, len(t.b), TILE[1]):
            r, c = slice(r0, r0 + TILE[0]), slice(c0, c0 + TILE[1])
            same, double = t.same(r, c), not products.float
            s, hits, near, inside = look(r, c, same, double)
            if not double and max(len(h) for h in (*hits, inside)) > DENSE * s.size:
                double = True
                s, hits, near, inside = look(r, c, same, double)
            for side, hit in enumerate(hits):
                row, column = np.divmod(hit, s.shape[1])
                score = products.exact(row + r0, column + c0)
                lists[side].put(*((row + r0, column + c0) if side == 0 else (column + c0, row + r0)), score)
            if counting:
                row, column = np.divmod(inside, s.shape[1])
                units = metric.units(s.ravel()[inside] if double and len(inside) > DENSE * s.size else products.exact(row + r0, column + c0))
                below += near + np.count_nonzero(units < lo)
                every += s.size - len(same[0])
                kept.append((units[(units >= lo) & (units < hi)] - lo) >> shift)
                if sum(map(len, kept)) > len(ranges):
                    count_kept()
    count_kept()
    out = []
    for (mine, other), best in zip(((t.i, t.j), (t.j, t.i)), lists):
        row, place = np.nonzero(np.isfinite(best.score))
        out.append(pd.DataFrame({"i": mine[row], "j": other[best.who[row, place]], "sim": best.score[row, place]}))
    if counting:
        some = np.flatnonzero(ranges)
        out.append(pd.DataFrame({"v": np.concatenate([some, [-1, -2]]), "n": twice * np.concatenate([ranges[some], [below, every]])}))
    out = pd.concat(out).reindex(columns=["i", "j", "sim", "v", "n"]).astype({c: "Int64" for c in ("i", "j", "v", "n")})
    return out.assign(block=block)


def block_pairs(rows: DataFrame, run: Callable[[Blocks, bool], pd.DataFrame], schema: str, per_block: int = SMALL) -> DataFrame:
    """run(blocks, own) for every two blocks of ``rows`` (i, a, ...) and for every block with itself (own); with a column ``block``, inside its groups.

    As block_products of rows with themselves, but two blocks meet once only, so that run() has to fold both directions of a pair of rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    group = ["block"] if "block" in rows.columns else []
    a, _ = dealt(rows, "a", "p", per_block)
    x = a.withColumn("q", F.explode(F.sequence("p", F.col("n_p") - 1))).drop("n_p")
    y = a.where("p > 0").select(*(F.col(c).alias("block__r") for c in group), F.col("p").alias("q__r"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("p__r"), F.col("i").alias("j"), F.col("a").alias("b"))

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        own = not x.empty and x["p"].iloc[0] == x["q"].iloc[0]
        if x.empty or (y.empty and not own):
            return pd.DataFrame({c: [] for c in names})
        return run(Blocks.of(x, x[["i", "a"]].rename(columns={"i": "j", "a": "b"}) if own else y), own)[names]

    return x.groupBy(*group, "p", "q").cogroup(y.groupBy(*(f"{c}__r" for c in group), "p__r", "q__r")).applyInPandas(both, schema)


def _ranked(found: DataFrame, k: int, group: list[str]) -> DataFrame:
    """(i, j, sim, rank) of the lists that folded() gives."""
    w = Window.partitionBy(*group, "i").orderBy(F.desc("sim"), "j")
    return found.where("i is not null").select(*group, "i", "j", "sim", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def _guess(rows: DataFrame, metric: Cosine, per_block: int) -> DataFrame:
    """(block, mid, half): where the median score of different rows should be, from a few tiles of each block with itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, out = Blocks.of(pdf, pdf[["i", "a"]].rename(columns={"i": "j", "a": "b"})).finite(), []
        products, n = Products(t.a, t.b, metric), max(1, -(-len(t.a) // min(TILE)))
        side = max(1, -(-len(t.a) // n))
        for at in range(min(n * n, GUESSES)):
            r, c = (slice(k * side, (k + 1) * side) for k in (at % n, (at + at // n) % n))
            s, error = products.tile(r, c)
            apart = np.ones(s.shape, bool)
            apart[t.same(r, c)] = False
            s = s[apart]
            if len(s):
                some = [min(len(s) - 1, int(q * len(s))) for q in (0.45, 0.5, 0.55)]
                a, mid, b = np.partition(s, some)[some].astype(float)
                out.append((mid, b - a, error, len(t.a)))
        return pd.DataFrame(out, columns=["mid", "wide", "error", "rows"]).assign(block=int(pdf["block"].iloc[0]) if "block" in pdf else 0)

    tiles = dealt(rows, "a", "p", per_block)[0].groupBy(*(["block"] if "block" in rows.columns else []), "p").applyInPandas(run, "mid double, wide double, error double, rows long, block long")
    half = 6 * F.coalesce(F.stddev("mid"), F.lit(0.0)) / F.sqrt(F.count("*")) + F.when(F.count("*") > 1, 0.04 * F.avg("wide") / F.count("*")).otherwise(0.0) + 4 * F.max("error") + 2 * metric.unit
    return tiles.groupBy("block").agg(F.avg("mid").alias("mid"), half.alias("half"))


def pairs_and_median(rounds: Rounds, rows: DataFrame, metric: Cosine, k: int, per_block: int = SMALL, guess: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lists of folded(), (block, v)): each row's k best, and the lower median distance of all pairs of different rows, in the metric's units.

    A guess says where the median should be. One pass over all pairs counts what is nearer and, in ranges, what is there; where the median is
    elsewhere, or the ranges are wide, another pass looks there. The counts are of all pairs, so the median is exact whatever the guess.
    """
    grouped, rows = "block" in rows.columns, rounds.write(rows)
    width = lambda lo, hi: F.greatest(F.lit(0), F.ceil(F.log2((hi - lo) / FINE))).cast("int")
    ends = [F.greatest(F.lit(0).cast("long"), F.floor((metric.score(0) - F.col("mid") + sign * F.col("half")) / metric.unit)) for sign in (-1, 1)]
    at = rounds.write((_guess(rows, metric, per_block) if guess is None else guess).select("block", ends[0].alias("lo"), (ends[1] + 1).alias("hi")).withColumn("shift", width(F.col("lo"), F.col("hi"))))
    lists, done = None, None
    while True:
        if grouped:
            asked = rows.join(at.select(F.col("block").alias("__at"), "lo", "hi", "shift"), F.col("block") == F.col("__at"), "left" if lists is None else "inner").drop("__at").na.fill(0, ["lo", "hi", "shift"])
        else:
            row = at.first()
            asked = rows.withColumns({c: F.lit(row[c] if row else 0).cast("long") for c in ("lo", "hi", "shift")})
        found = rounds.write(block_pairs(asked, lambda t, own, k=k if lists is None else 0: folded(t, own, metric, k, True), FOLDED, per_block))
        lists = found if lists is None else lists
        counts = found.where("v is not null").groupBy("block", "v").agg(F.sum("n").alias("n")).where("n > 0")
        sums = counts.groupBy("block").agg(F.sum(F.when(F.col("v") == -1, F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") == -2, F.col("n")).otherwise(0)).alias("all"))
        run = counts.where("v >= 0").join(sums, "block").withColumn("run", F.col("below") + F.sum("n").over(Window.partitionBy("block").orderBy("v")))
        hit = run.where(2 * F.col("run") >= F.col("all")).groupBy("block").agg(F.min("v").alias("v"))
        state = rounds.write(sums.where("all > 0").join(at, "block").join(hit, "block", "left"))
        lower, here = 2 * F.col("below") >= F.col("all"), F.col("v").isNotNull()
        settled = state.where(here & ~lower & (F.col("shift") == 0)).select("block", (F.col("lo") + F.col("v")).alias("v"))
        done = settled if done is None else done.unionByName(settled)
        step = F.lit(1).cast("long") * F.pow(F.lit(2), "shift").cast("long")
        far = 8 * (F.col("hi") - F.col("lo"))
        first = F.when(lower, F.greatest(F.lit(0).cast("long"), F.col("lo") - far)).when(here, F.col("lo") + F.col("v") * step).otherwise(F.col("hi"))
        last = F.when(lower, F.col("lo")).when(here, F.col("lo") + (F.col("v") + 1) * step).otherwise(F.col("hi") + far)
        at = rounds.write(state.where(lower | ~here | (F.col("shift") > 0)).select("block", first.alias("lo"), last.alias("hi")).withColumn("shift", width(F.col("lo"), F.col("hi"))))
        if at.isEmpty():
            return lists, done


def nearest(df: DataFrame, key: str, vector: str, k: int, per_block: int = SMALL, by: str | None = None) -> DataFrame:
    """(i, j, sim, rank): the k rows of the whole table (or with the same ``by``, as block) that are most similar to each row; blocks keep k, and the lists are merged."""
    rows = Rounds(df, "nearest").write(_sides(df, key, vector, by)[0])
    found = block_pairs(rows, lambda t, own: folded(t, own, COSINE, k), FOLDED, per_block)
    return _ranked(found, k, ["block"] if by else [])


def softmax_top(df: DataFrame, key: str, vector: str, alpha: float, per_block: int = SMALL, by: str | None = None) -> DataFrame:
    """(i, top): the greatest softmax(sim / alpha) of each row over all other rows (with the same ``by``). Cosines are at most 1, so partial sums share that shift; those of the whole table are rounded to 9 places."""

    def run(t: Blocks) -> pd.DataFrame:
        most, total = np.zeros(len(t.a)), np.zeros(len(t.a))
        for r, c, s in t.tiles():
            s = s if by else rounded(s)
            s -= 1
            s /= alpha
            e = np.exp(s, out=s)
            e[t.same(r, c)] = 0
            most[r], total[r] = np.maximum(most[r], e.max(1)), total[r] + e.sum(1)
        return pd.DataFrame({"i": t.i, "most": most, "e": total})

    out = block_products(*_sides(df, key, vector, by), run, "i long, most double, e double", per_block).groupBy("i")
    return out.agg(F.try_divide(F.max("most"), F.sum("e")).alias("top"))


def median_distances(df: DataFrame, key: str, vector: str, per_block: int = SMALL, by: str | None = None) -> DataFrame:
    """(block, s2): the lower median of the squared distances 2 - 2 sim of all pairs of different rows of each group (of the table: block 0).

    Rounded to 9 places, a cosine is a whole number of 10^-9; these are counted (see pairs_and_median).
    """
    rounds = Rounds(df, "medians")
    _, at = pairs_and_median(rounds, _sides(df, key, vector, by)[0], COSINE, 0, per_block)
    return at.select("block", F.greatest(2 - 2 * ((ONE - F.col("v")) / ONE), F.lit(0.0)).alias("s2"))


def median_distance(df: DataFrame, key: str, vector: str, per_block: int = SMALL) -> float | None:
    """median_distances of the whole table."""
    found = median_distances(df, key, vector, per_block).first()
    return found and found.s2


def nearest_affinity(df: DataFrame, key: str, vector: str, k: int, per_block: int = SMALL, by: str | None = None) -> DataFrame:
    """gaussian_affinity of the whole table, (i, j, a), or inside each group, (block, i, j, a): from each row's k nearest rows and the median of all pairs."""
    group = ["block"] if by else []
    found, at = pairs_and_median(Rounds(df, "affinity"), _sides(df, key, vector, by)[0], COSINE, k, per_block)
    s2 = F.greatest(2 - 2 * ((ONE - F.col("v")) / ONE), F.lit(0.0))
    near = _ranked(found, k, group)
    if by:
        near = near.join(at.select("block", s2.alias("s2")), "block")
    else:
        row = at.select(s2.alias("s2")).first()
        near = near.withColumn("s2", F.lit(row.s2 if row else 0.0))
    near = near.withColumn("a", F.exp(-F.greatest(2 - 2 * F.col("sim"), F.lit(0.0)) / (2 * (F.col("s2") + 1e-8) + 1e-8)))
    both = near.select(*group, "i", "j", "a").unionByName(near.select(*group, F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    return both.groupBy(*group, "i", "j").agg(F.max("a").alias("a"))


def exponents(t: Blocks, tau: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of exp((sim - 1) / tau) of each row and of each column."""
    rows, columns = np.zeros(len(t.a)), np.zeros(len(t.b))
    for r, c, s in t.tiles():
        s -= 1
        s /= tau
        e = np.exp(s, out=s)
        rows[r] += e.sum(1)
        columns[c] += e.sum(0)
    return rows, columns


def beaten(t: Blocks, tops: tuple[np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many places of each row, and of each column, come before one with similarity tops at the other side's key ``of`` (sim falling, then key)."""
    out = np.zeros(len(t.a), np.int64), np.zeros(len(t.b), np.int64)
    for r, c, s in t.tiles():
        s = rounded(s)
        for side, (mine, top, key) in enumerate(((r, tops[0][r][:, None], of[0][r]), (c, tops[1][c][None, :], of[1][c]))):
            here = t.same(r, c) if side == 0 else here
            own = s[here]
            s[here] = np.where(key[here[side]] == (t.i, t.j)[side][mine][here[side]], -np.inf, own)  # its own partner, if that is the one, is not before it
            out[side][mine] += np.count_nonzero(s > top, axis=1 - side)
            at = np.nonzero(s == top)
            before = (t.j[c][at[1]] < key[at[0]]) if side == 0 else (t.i[r][at[0]] < key[at[1]])
            out[side][mine] += np.bincount(at[side][before], minlength=len(key))
            s[here] = own
    return out


def two_view_rows(df: DataFrame, key: str, left: Column, right: Column, tau: float = 0.07, per_block: int = SMALL, by: str | None = None, parts: tuple[str, ...] = ("loss", "rank")) -> DataFrame:
    """(side, key, loss, rank): each row's left view among all right ones (side 0) and the other way: -log softmax(sim / tau) and rank of its partner.

    With ``by``, rows with the same value meet, and it comes first, as block. ``parts`` names what is needed; the other is null."""
    group = [F.col(by).cast("long").alias("block")] if by else []
    names = ["block"] if by else []
    rows = df.where(F.col(key).isNotNull() & left.isNotNull() & right.isNotNull()).select(*group, F.col(key).cast("long").alias("i"), normalized(left).alias("a"), normalized(right).alias("b"))
    rows = rows.withColumn("own", F.round(dot(F.col("a"), F.col("b")), 9))

    def run(t: Blocks) -> pd.DataFrame:
        own, none = (t.x["own"].to_numpy(), t.y["mine"].to_numpy()), (0, 0)
        e = exponents(t, tau) if "loss" in parts else none
        better = beaten(t, own, (t.i, t.j)) if "rank" in parts else none
        out = pd.concat([pd.DataFrame({"side": side, "key": end, "own": own[side], "e": e[side], "better": better[side]}) for side, end in ((0, t.i), (1, t.j))])
        return out.assign(block=t.x["block"].iloc[0]) if by else out

    sums = block_products(rows.select(*names, "i", "a", "own"), rows.select(*names, F.col("i").alias("j"), "b", F.col("own").alias("mine")), run, ("block long, " if by else "") + "side int, key long, own double, e double, better long", per_block).groupBy(*names, "side", "key")
    loss, rank = F.log(F.sum("e")) + (1 - F.max("own")) / tau, F.sum("better") + 1
    return sums.agg((loss if "loss" in parts else F.lit(None).cast("double")).alias("loss"), (rank if "rank" in parts else F.lit(None).cast("long")).alias("rank"))


# ---- diffusion distances: exact inside blocks, of the centroids across blocks ----
def walk_distances(h: np.ndarray, k: int, t: int) -> np.ndarray:
    """sum_k (P^t_ik - P^t_jk)^2 for all i, j, where P is the row-normalised affinity of the k nearest rows (ties by place)."""
    n = len(h)
    if n < 2:
        return np.zeros((n, n))
    square = (h * h).sum(1)
    d2 = np.maximum(square[:, None] + square[None, :] - 2 * h @ h.T, 0)
    off = np.sort(d2[~np.eye(n, dtype=bool)])
    near = np.exp(-d2 / (2 * (off[(len(off) - 1) // 2] + 1e-8) + 1e-8))
    np.fill_diagonal(near, 0)
    at = np.argsort(-near, axis=1, kind="stable")[:, : min(k, n - 1)]
    a = np.zeros_like(near)
    np.put_along_axis(a, at, np.take_along_axis(near, at, 1), 1)
    a = np.maximum(a, a.T)
    p = np.linalg.matrix_power(a / (a.sum(1, keepdims=True) + 1e-8), t)
    square = (p * p).sum(1)
    return np.maximum(square[:, None] + square[None, :] - 2 * p @ p.T, 0)


def diffusion_distances(df: DataFrame, block: str, key: str, vector: str, k: int = 15, t: int = 3) -> DataFrame:
    """(block, i, j, d2): distances of all pairs inside a block. One task holds a block's square, so blocks must be bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        d, ids = walk_distances(np.stack(pdf["v"]).astype(float), k, t), pdf["i"].to_numpy()
        return pd.DataFrame({"block": pdf["block"].iloc[0], "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "d2": d.ravel()})

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return rows.select(F.col(block).cast("long").alias("block"), F.col(key).cast("long").alias("i"), F.col(vector).alias("v")).groupBy("block").applyInPandas(run, "block long, i long, j long, d2 double")


def hierarchical_diffusion(df: DataFrame, key: str, vector: str, size: int = 500, k: int = 15, t: int = 3) -> tuple[DataFrame, DataFrame]:
    """(block, i, j, d2) inside blocks of about ``size`` rows, dealt by key, and (a, b, d2) of block centroids: every pair of rows of
    blocks a and b has that distance. The centroids are one block of the same operator, a row per ``size`` rows."""
    df = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    blocks = max(1, -(-df.count() // size))
    dealt = df.withColumn("block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)))
    mean = dealt.select("block", F.posexplode(vector).alias("at", "x")).groupBy("block", "at").agg(F.avg("x").alias("x")).groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    inter = diffusion_distances(mean.withColumn("all", F.lit(0)), "all", "block", "v", k, t).where("i <> j")
    return diffusion_distances(dealt, "block", key, vector, k, t), inter.select(F.col("i").alias("a"), F.col("j").alias("b"), "d2")


def scaled_distances(d: DataFrame, robust: bool = False) -> DataFrame:
    """d2 over its greatest value, or with ``robust`` over the lower median of different rows' distances, as ``scaled``."""
    off = d.where("i <> j")
    by = off.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY d2)").alias("__by")) if robust else d.agg(F.max("d2").alias("__by"))
    return d.join(F.broadcast(by)).withColumn("scaled", F.col("d2") / (F.coalesce("__by", F.lit(0.0)) + 1e-8)).drop("__by")


def distance_regulariser(now: DataFrame, target: DataFrame, robust: bool = False) -> DataFrame:
    """One row: the mean squared difference of two tables of distances (i, j, d2), each scaled first; rows of both count."""
    a, b = scaled_distances(now, robust), scaled_distances(target, robust).select("i", "j", F.col("scaled").alias("other"))
    return a.join(b, ["i", "j"]).agg(F.avg((F.col("scaled") - F.col("other")) * (F.col("scaled") - F.col("other"))).alias("mse"))


def block_regulariser(df: DataFrame, block: str, key: str, left: Column, right: Column, k: int = 15, t: int = 3, robust: bool = False) -> DataFrame:
    """distance_regulariser of the diffusion distances of two views inside blocks, without a row for each pair of rows.

    A block's two squares stay in its task (so blocks must be bounded), which makes them anew in each pass: three count the leading, middle and last
    bits of distances for the exact median (one takes the greatest, if not ``robust``), the last one sums the squared differences.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(block).cast("long").alias("block"), F.col(key).cast("long").alias("i"), left.alias("x"), right.alias("y"))

    def squares(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        pdf = pdf.sort_values("i", ignore_index=True)
        have = [pdf[pdf[c].notna()] for c in ("x", "y")]
        return [(p["i"].to_numpy(), walk_distances(np.stack(p[c]).astype(float), k, t) + 0.0 if len(p) else np.zeros((0, 0))) for p, c in zip(have, ("x", "y"), strict=True)]

    def counts(above: dict[int, int], shift: int) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for side, (ids, d) in enumerate(squares(pdf)):
                bits = d[~np.eye(len(ids), dtype=bool)].view(np.int64)
                bits = bits[bits >> (shift + 21) == above.get(side, 0)] >> shift
                v, n = np.unique(bits, return_counts=True)
                out.append(pd.DataFrame({"side": side, "v": v, "n": n}))
            return pd.concat(out)

        return rows.groupBy("block").applyInPandas(run, "side int, v long, n long").groupBy("side", "v").agg(F.sum("n").alias("n"))

    def greatest(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(side, float(d.max())) for side, (_, d) in enumerate(squares(pdf)) if d.size], columns=["side", "top"])

    if robust:
        above, below, half = {}, {0: 0, 1: 0}, {}
        for shift in (42, 21, 0):
            c = counts(above, shift)
            run = c.withColumn("run", F.sum("n").over(Window.partitionBy("side").orderBy("v"))).withColumn("all", F.sum("n").over(Window.partitionBy("side")))
            start = F.create_map(*(F.lit(x) for pair in below.items() for x in pair))[F.col("side")]
            need = F.create_map(*(F.lit(x) for pair in half.items() for x in pair))[F.col("side")] if half else F.col("all")
            found = run.where(2 * (F.col("run") + start) >= need).groupBy("side").agg(F.min_by(F.struct("v", (F.col("run") - F.col("n") + start).alias("below"), need.alias("all")), "v").alias("m")).select("side", "m.*").collect()
            above, below, half = ({r.side: r[c] for r in found} for c in ("v", "below", "all"))
            if not found:
                break
        by = {side: float(np.array([v], np.int64).view(float)[0]) for side, v in above.items()}
    else:
        by = {r.side: r.top for r in rows.groupBy("block").applyInPandas(greatest, "side int, top double").groupBy("side").agg(F.max("top").alias("top")).collect()}

    def differences(pdf: pd.DataFrame) -> pd.DataFrame:
        (a, x), (b, y) = squares(pdf)
        _, at, other = np.intersect1d(a, b, return_indices=True)
        gap = x[np.ix_(at, at)] / (by.get(0, 0.0) + 1e-8) - y[np.ix_(other, other)] / (by.get(1, 0.0) + 1e-8)
        return pd.DataFrame({"s": [float((gap * gap).sum())], "n": [gap.size]})

    return rows.groupBy("block").applyInPandas(differences, "s double, n long").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mse"))


# ---- contrastive losses with soft targets, every row against every row ----
Weights = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], np.ndarray]


def own_partner(x: pd.DataFrame, y: pd.DataFrame, same: np.ndarray) -> np.ndarray:
    return same.astype(float)


def same_label(x: pd.DataFrame, y: pd.DataFrame, same: np.ndarray) -> np.ndarray:
    """Other rows of the same label."""
    return (x["m"].to_numpy()[:, None] == y["m"].to_numpy()[None, :]) & ~same


def _jaccards(x: pd.Series, y: pd.Series) -> np.ndarray:
    """Jaccard similarities of the rows' sets; equal sets are compared once."""
    words: dict[str, int] = {}
    sets: list[dict[frozenset, int]] = [{}, {}]
    codes = [np.array([known.setdefault(frozenset(terms if terms is not None else ()), len(known)) for terms in s]) for known, s in zip(sets, (x, y), strict=True)]
    rows = [[[words.setdefault(t, len(words)) for t in terms] for terms in known] for known in sets]
    a, b = (np.zeros((len(s), len(words))) for s in rows)
    for m, s in ((a, rows[0]), (b, rows[1])):
        for i, terms in enumerate(s):
            m[i, terms] = 1
    both = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)[codes[0][:, None], codes[1][None, :]]


def term_similarity(x: pd.DataFrame, y: pd.DataFrame, weights: dict[str, float]) -> np.ndarray:
    """Weighted mean of the Jaccard similarities of the columns named in ``weights``."""
    return sum(w * _jaccards(x[c], y[c]) for c, w in weights.items()) / max(sum(weights.values()), 1e-8)


def soft_terms(weights: dict[str, float], alpha: float = 0.3, temperature: float = 0.25) -> Weights:
    """exp(score / temperature), score = (1 - alpha) at a row's own partner and alpha * term_similarity at others."""
    return lambda x, y, same: np.exp(np.where(same, 1 - alpha, alpha * term_similarity(x, y, weights)) / temperature)


def mixed_terms(weights: dict[str, float], alpha: float = 0.5) -> Weights:
    """(1 - alpha) at a row's own partner, alpha * term_similarity at others."""
    return lambda x, y, same: np.where(same, 1 - alpha, alpha * term_similarity(x, y, weights))


def mixed_sources(weights: dict[str, float], pair: float = 1.0, variant: float = 1.0, group: float = 0.5, terms: float = 0.3) -> Weights:
    """Sum of weights for a row's own partner, the same variant (column m), the same group (column g) and term_similarity of others."""

    def run(x: pd.DataFrame, y: pd.DataFrame, same: np.ndarray) -> np.ndarray:
        equal = lambda c: x[c].to_numpy()[:, None] == y[c].to_numpy()[None, :]
        return pair * same + variant * equal("m") + group * equal("g") + terms * np.where(same, 0.0, term_similarity(x, y, weights))

    return run


def contrastive_loss(df: DataFrame, key: str, left: Column, right: Column, weights: Weights, extra: dict[str, Column] | None = None, tau: float = 0.07, back: str = "renormalised", per_block: int = SMALL) -> DataFrame:
    """One row: loss_ab, loss_ba, loss of -sum_j T_ij log softmax_j(sim_ij / tau) over the whole table, and how many rows have no target.

    T_ij is weights() over its row sum (0 where that is 0). For the other direction T is transposed, and, as ``back`` says,
    renormalised, left as it is ("transposed"), or made anew from the columns ("own"). ``extra`` columns reach weights(). Where a row's own
    partner is its only target (own_partner), no weights are made.
    """
    if weights is own_partner:
        rows = two_view_rows(df, key, left, right, tau, per_block, parts=("loss",))
        out = rows.agg(*(F.avg(F.when(F.col("side") == side, F.col("loss"))).alias(name) for side, name in enumerate(("loss_ab", "loss_ba"))))
        return out.select("loss_ab", F.lit(0).cast("long").alias("without_target"), "loss_ba", ((F.col("loss_ab") + F.col("loss_ba")) / 2).alias("loss"))
    extra = extra or {}
    rounds = Rounds(df, "loss")
    base = df.where(F.col(key).isNotNull() & left.isNotNull() & right.isNotNull()).select(F.col(key).cast("long").alias("i"), normalized(left).alias("a"), normalized(right).alias("b"), *(c.alias(n) for n, c in extra.items()))
    y = base.select(F.col("i").alias("j"), "b", *(F.col(n).alias(f"{n}__r") for n in extra))
    one = "side int, key long, e double, w double, wx double"

    def weighed(t: Blocks, r: slice, c: slice, s: np.ndarray) -> np.ndarray:
        same = np.zeros(s.shape, bool)
        same[t.same(r, c)] = True
        return np.asarray(weights(t.x.iloc[r], t.y.iloc[c], same), float)

    def first(t: Blocks) -> pd.DataFrame:
        rows, columns = np.zeros((3, len(t.a))), np.zeros((3, len(t.b)))
        for r, c, s in t.tiles():
            w, e = weighed(t, r, c, s), np.exp((s - 1) / tau)
            for k, v in enumerate((e, w, w * s / tau)):
                rows[k, r] += v.sum(1)
                columns[k, c] += v.sum(0)
        return pd.concat([pd.DataFrame(dict(zip(("side", "key", "e", "w", "wx"), (side, end, *part), strict=True))) for side, end, part in ((0, t.i, rows), (1, t.j, columns))])

    sums = rounds.write(block_products(base.drop("b"), y, first, one, per_block).groupBy("side", "key").agg(*(F.sum(c).alias(c) for c in ("e", "w", "wx"))))
    lse = F.log("e") + 1 / tau
    ab = sums.where("side = 0").select("key", lse.alias("lse"), "w", "wx")
    loss_ab = F.coalesce(F.try_divide(F.col("w") * F.col("lse") - F.col("wx"), F.col("w")), F.lit(0.0))
    forward = ab.agg(F.avg(loss_ab).alias("loss_ab"), F.count_if(F.col("w") <= 0).alias("without_target"))
    if back == "own":
        backward = sums.where("side = 1").withColumn("lse", lse).agg(F.avg(loss_ab).alias("loss_ba"))
        return forward.join(F.broadcast(backward)).withColumn("loss", (F.col("loss_ab") + F.col("loss_ba")) / 2)

    def second(t: Blocks) -> pd.DataFrame:
        total, sums = t.x["total"].to_numpy(), np.zeros((2, len(t.b)))
        share = np.divide(1, total, out=np.zeros(len(total)), where=total > 0)
        for r, c, s in t.tiles():
            w = weighed(t, r, c, s)
            sums[0, c] += share[r] @ w
            sums[1, c] += share[r] @ (w * s) / tau
        return pd.DataFrame({"key": t.j, "t": sums[0], "tx": sums[1]})

    known = ab.select(F.col("key").alias("i"), F.col("w").alias("total")).join(base.drop("b"), "i")  # the plain side goes right: Spark renames its columns
    columns = block_products(known, y, second, "key long, t double, tx double", per_block).groupBy("key").agg(F.sum("t").alias("t"), F.sum("tx").alias("tx"))
    columns = columns.join(sums.where("side = 1").select("key", lse.alias("lse")), "key")
    each = F.col("t") * F.col("lse") - F.col("tx")
    each = F.coalesce(F.try_divide(each, F.col("t")), F.lit(0.0)) if back == "renormalised" else each
    return forward.join(F.broadcast(columns.agg(F.avg(each).alias("loss_ba")))).withColumn("loss", (F.col("loss_ab") + F.col("loss_ba")) / 2)


def three_view_loss(df: DataFrame, key: str, seq: Column, bio: Column, text: Column, weights: Weights, extra: dict[str, Column] | None = None, tau: float = 0.07, mix: tuple[float, float, float] = (1.0, 0.8, 0.8)) -> DataFrame:
    """One row: loss_sb, loss_st, loss_bt and their weighted sum."""
    out = None
    for name, a, b in (("loss_sb", seq, bio), ("loss_st", seq, text), ("loss_bt", bio, text)):
        one = contrastive_loss(df, key, a, b, weights, extra, tau).select(F.col("loss").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.withColumn("loss", sum((F.col(c) * w for c, w in zip(("loss_sb", "loss_st", "loss_bt"), mix, strict=True)), F.lit(0.0)))


def multi_positive_recall(df: DataFrame, key: str, left: Column, right: Column, terms: Column, least: float = 0.5, ks: tuple[int, ...] = (1, 5, 10), per_block: int = SMALL) -> DataFrame:
    """One row: the share of rows (both directions) with their partner, or a row whose terms' Jaccard is ``least`` or more, among the k most similar.

    A row's best rank is one more than the rows that beat its most similar positive, so blocks give that positive first.
    """
    rounds = Rounds(df, "positives")
    base = df.where(F.col(key).isNotNull() & left.isNotNull() & right.isNotNull()).select(F.col(key).cast("long").alias("i"), normalized(left).alias("a"), normalized(right).alias("b"), terms.alias("terms"))
    other = base.select(F.col("i").alias("j"), "b", F.col("terms").alias("terms__r"))

    def positives(t: Blocks) -> pd.DataFrame:
        top, of = [np.full(len(v), -np.inf) for v in (t.a, t.b)], [np.zeros(len(v), np.int64) for v in (t.a, t.b)]
        for r, c, s in t.tiles():
            good = _jaccards(t.x["terms"].iloc[r], t.y["terms"].iloc[c]) >= least
            good[t.same(r, c)] = True
            s = rounded(s)
            s[~good] = -np.inf
            for side, (mine, keys) in enumerate(((r, t.j[c]), (c, t.i[r]))):
                at = s.argmax(1 - side)
                now = s.max(1 - side)
                new = (now > top[side][mine]) | ((now == top[side][mine]) & (keys[at] < of[side][mine]))
                top[side][mine], of[side][mine] = np.where(new, now, top[side][mine]), np.where(new, keys[at], of[side][mine])
        return pd.concat([pd.DataFrame({"side": side, "key": end, "top": top[side], "of": of[side]}) for side, end in ((0, t.i), (1, t.j))])

    def better(t: Blocks) -> pd.DataFrame:
        n = beaten(t, (t.x["top"].to_numpy(), t.y["best"].to_numpy()), (t.x["of"].to_numpy(), t.y["at"].to_numpy()))
        return pd.concat([pd.DataFrame({"side": side, "key": end, "n": n[side]}) for side, end in ((0, t.i), (1, t.j))])

    best = block_products(base.drop("b"), other, positives, "side int, key long, top double, of long", per_block).where(F.col("top") > float("-inf"))
    best = rounds.write(best.groupBy("side", "key").agg(F.max(F.struct("top", (-F.col("of")).alias("minus"))).alias("t")).select("side", "key", "t.top", (-F.col("t.minus")).alias("of")))
    rows = best.where("side = 0").select(F.col("key").alias("i"), "top", "of").join(base.select("i", "a"), "i")  # the plain side goes right: Spark renames its columns
    columns = best.where("side = 1").select(F.col("key").alias("j"), F.col("top").alias("best"), F.col("of").alias("at")).join(other.select("j", "b"), "j")
    ranks = block_products(rows, columns, better, "side int, key long, n long", per_block).groupBy("side", "key").agg((F.sum("n") + 1).alias("rank"))
    return ranks.agg(*(F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in ks))


def mean_pool(tokens: Column, mask: Column, eps: float = 1e-8) -> Column:
    """Mean of the token vectors whose mask is not 0, place by place."""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] != 0)
    size = F.greatest(F.size(kept).cast("double"), F.lit(eps))
    zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, z: F.zip_with(s, z["t"], lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / size)


def first_token(tokens: Column) -> Column:
    return F.get(tokens, F.lit(0))


def lifetimes(h: np.ndarray) -> np.ndarray:
    """Lengths at which components of a point set merge as the distance grows: the edges of its minimum spanning tree, sorted (Prim)."""
    n = len(h)
    if n < 2:
        return np.zeros(0)
    out, left, near = [], np.ones(n, bool), np.full(n, np.inf)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        near = np.minimum(near, np.sqrt(np.maximum(((h - h[at]) ** 2).sum(1), 0)))
        at = int(np.where(left, near, np.inf).argmin())
        out.append(near[at])
    return np.sort(out)


def persistence(df: DataFrame, block: str, vector: str) -> DataFrame:
    """(block, rank, death): the lifetimes of components (dimension 0; all are born at 0) inside each block, longest first. A block's rows meet in one task, so blocks must be bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = lifetimes(np.stack(pdf["v"]).astype(float))[::-1]
        return pd.DataFrame({"block": pdf["block"].iloc[0], "rank": np.arange(1, len(d) + 1), "death": d})

    return df.where(F.col(vector).isNotNull()).select(F.col(block).cast("long").alias("block"), F.col(vector).alias("v")).groupBy("block").applyInPandas(run, "block long, rank long, death double")
