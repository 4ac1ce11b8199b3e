"""Diffusion distances of a whole table, all pairs of rows, without a table of them: walks on the nearest-neighbour graph, some rows at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import Rounds
from .ordered import places, running
from .vectors import SMALL, Cosine, _guess, _ranked, pairs_and_median

#: Rows are dealt into GROUPS tasks, each of which reads the graph. Arrays of walks hold about NUMBERS numbers.
GROUPS, NUMBERS = 24, 8_000_000
#: Distances near the median are counted in NEAR ranges of 2^-27 to 2^-28 of it; DRAWN rows say where it should be.
NEAR, DRAWN = 1 << 22, 256


class Euclidean(Cosine):
    """Scores are negative squared distances; these are counted in multiples of ``unit``."""

    most, rounding = 0.0, 0.0

    def __init__(self, unit: float):
        self.unit = unit

    def sides(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = lambda x: np.ones((len(x), 1))
        square = lambda x: np.einsum("ij,ij->i", x, x)[:, None]
        return np.hstack([2 * a, -square(a), one(a)]), np.hstack([b, one(b), -square(b)])

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -((a - b) ** 2).sum(1)

    def units(self, score: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(score / -self.unit), 0, 2.0**62).astype(np.int64)

    def score(self, units: float) -> float:
        return -units * self.unit


def neighbour_graph(rows: DataFrame, k: int, per_block: int = SMALL) -> DataFrame:
    """(i, to, a, degree) for each of ``rows`` (i, a): the affinities exp(-d2 / 2 sigma2) of k nearest rows by Euclidean distance (ties by i), made
    symmetric by the greater, and their sum; sigma2 is the lower median d2 of all pairs, to 30 binary places. Rows that hold no number somewhere are left out."""
    rounds = Rounds(rows, "graph")
    rows = rounds.write(rows.where(~F.exists("a", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    guess = rounds.write(_guess(rows, Euclidean(0.0), per_block))
    first = guess.first()
    metric = Euclidean(2.0 ** (math.floor(math.log2(max(-first.mid, 2.0**-200))) - 30) if first else 1.0)
    found, at = pairs_and_median(rounds, rows, metric, k, per_block, guess)
    s2 = next((r.v * metric.unit for r in at.collect()), 0.0)
    near = _ranked(found, k, []).select("i", "j", F.exp(F.col("sim") / (2 * (s2 + 1e-8) + 1e-8)).alias("w"))
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    lists = both.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("e"))
    out = rows.select("i").join(lists, "i", "left").withColumn("e", F.coalesce("e", F.expr("CAST(array() AS array<struct<j: bigint, w: double>>)")))
    out = out.select("i", F.transform("e", lambda e: e["j"]).alias("to"), F.transform("e", lambda e: e["w"]).alias("a"))
    return out.withColumn("degree", F.aggregate("a", F.lit(0.0), lambda s, x: s + x) + 1e-8)


class Walk:
    """A graph's rows in arrays, for t steps of its walk."""

    def __init__(self, table: pa.Table, n: int):
        table = table.sort_by("i")
        i, to = table.column("i").to_numpy(), table.column("to").combine_chunks()
        self.n, self.has = n, np.zeros(n, bool)
        self.has[i] = True
        self.count, degree = np.zeros(n, np.int64), np.ones(n)
        self.count[i] = to.value_lengths().to_numpy(zero_copy_only=False)
        degree[i] = table.column("degree").to_numpy()
        self.start = np.cumsum(self.count) - self.count
        self.to = to.flatten().to_numpy(zero_copy_only=False)
        a = table.column("a").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.p = a / np.repeat(degree, self.count)  # from a row to those of its list
        self.back = a / degree[self.to]  # from those of its list to a row
        self.square = None
        if "square" in table.column_names:
            self.square = np.zeros(n)
            self.square[i] = table.column("square").to_numpy()
        order = np.argsort(self.count, kind="stable")
        order = order[self.count[order] > 0]
        self.alike = np.split(order, np.flatnonzero(np.diff(self.count[order])) + 1) if len(order) else []

    def step(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each row the sum of weights * x over its list; x has a line for each row."""
        out = np.zeros_like(x)
        for rows in self.alike:
            wide = int(self.count[rows[0]])
            size = max(1, (1 << 15) // (wide * x.shape[1]))
            for k in range(0, len(rows), size):
                some = rows[k : k + size]
                at = self.start[some][:, None] + np.arange(wide)
                out[some] = np.einsum("cd,cdm->cm", weights[at], x.take(self.to[at], axis=0))
        return out

    def away(self, rows: np.ndarray, t: int) -> np.ndarray:
        """Where t steps from each of ``rows`` lead: a line for each row of the graph, a column for each of ``rows``."""
        x, m = np.zeros((self.n, len(rows))), len(rows)
        x[rows, np.arange(m)] = 1.0
        for _ in range(t):
            at = np.flatnonzero(x)
            node, column = np.divmod(at, m)
            if self.count[node].sum() > 4 * x.size:
                x = self.step(self.back, x)
                continue
            weight, x = x.ravel()[at], np.zeros(x.size)
            ends = np.cumsum(self.count[node])
            first = 0
            while first < len(node):  # about NUMBERS ways at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + NUMBERS, "right")))
                some, n = slice(first, last), self.count[node[first:last]]
                way = np.repeat(self.start[node[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                np.add.at(x, self.to[way] * m + np.repeat(column[some], n), np.repeat(weight[some], n) * self.p[way])
                first = last
            x = x.reshape(self.n, m)
        return x

    def distances(self, rows: np.ndarray, t: int) -> np.ndarray:
        """Squared distances of t steps from every row of the graph (lines) and from ``rows`` (columns)."""
        x = self.away(rows, t)
        for _ in range(t):
            x = self.step(self.p, x)
        x *= -2
        x += self.square[:, None]
        x += self.square[rows][None, :]
        np.maximum(x, 0, out=x)
        x[rows, np.arange(len(rows))] = 0
        return x


def _coarse(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading bits, counts): ranges of about a thousandth of the distances."""
    bits = np.ascontiguousarray(d).ravel().view(np.int64) >> 42
    if not len(bits):
        return bits, bits
    low = int(bits.min())
    n = np.bincount(bits - low)
    some = np.flatnonzero(n)
    return some + low, n[some]


def table_regulariser(df: DataFrame, key: str, left: Column, right: Column, k: int = 15, t: int = 3, robust: bool = False, per_block: int = SMALL) -> DataFrame:
    """One row (mse): distance_regulariser of the diffusion distances of two views of a whole table, with no row for a pair of rows.

    Every row's neighbours are searched in the whole table, and all pairs of rows count: those with both views in the mean, those with a view in
    the greatest distance by which it is divided (``robust``: their lower median, of distances rounded to 27 binary places or more). Rows are dealt into
    GROUPS tasks that hold the two graphs (k to 2 k numbers a row) and walk from a few rows at a time, so the work is quadratic in the rows and no square is held.
    One pass over the pairs gives all sums and the median if it lies where DRAWN rows say; otherwise the pass is made again. Keys differ.
    """
    rounds = Rounds(df, "regulariser")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), *(c.cast("array<double>").alias(n) for n, c in (("x", left), ("y", right))))
    rows = rounds.write(places(rows, [], "k").select((F.col("place") - 1).alias("i"), "x", "y"))
    n = rows.count()
    graph = None
    for side, c in enumerate(("x", "y")):
        one = neighbour_graph(rows.where(F.col(c).isNotNull()).select("i", F.col(c).alias("a")), k, per_block).select(F.lit(side).alias("side"), "i", "to", "a", "degree")
        graph = one if graph is None else graph.unionByName(one)
    graph = rounds.write(graph)
    m = max(1, min(64, NUMBERS // max(n, 1)))

    def walks(graph: DataFrame, run, schema: str) -> DataFrame:
        """run(group, both graphs) in GROUPS tasks; it gives columns, a number standing for a column of it."""

        def both(key: tuple, table: pa.Table) -> pa.Table:
            side = table.column("side").to_numpy()
            parts = [fields.empty_table()]
            for part in run(key[0].as_py(), [Walk(table.filter(pa.array(side == s)), n) for s in (0, 1)]):
                rows = max(len(v) for v in part.values() if np.ndim(v))
                parts.append(pa.table([pa.array(np.broadcast_to(part[f.name], rows), f.type) if f.name in part else pa.nulls(rows, f.type) for f in fields], schema=fields))
            return pa.concat_tables(parts)

        fields = pa.schema([pa.field(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])
        return graph.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(min(GROUPS, max(1, n)) - 1)))).groupBy("g").applyInArrow(both, schema)

    def slices(group: int, some: np.ndarray) -> Iterator[np.ndarray]:
        mine = some[some % min(GROUPS, max(1, n)) == group]
        for at in range(0, len(mine), m):
            yield mine[at : at + m]

    def squares(group: int, sides: list[Walk]) -> Iterator[dict]:
        for side, walk in enumerate(sides):
            for part in slices(group, np.flatnonzero(walk.has)):
                x = walk.away(part, t)
                yield {"side": side, "i": part, "square": np.einsum("ij,ij->j", x, x)}

    graph = rounds.write(graph.join(walks(graph, squares, "side int, i long, square double"), ["side", "i"]))

    def totals(counts: dict[int, int]) -> dict:
        return {"v": np.array(list(counts), np.int64), "n": np.array(list(counts.values()), np.int64)}

    def drawn_counts(drawn: dict[int, list[int]]):
        def run(group: int, sides: list[Walk]) -> Iterator[dict]:
            for side, walk in enumerate(sides):
                found: dict[int, int] = {}
                for part in slices(group, np.array(drawn.get(side, []), np.int64)):
                    d = walk.distances(part, t)
                    apart = np.repeat(walk.has[:, None], len(part), 1)
                    apart[part, np.arange(len(part))] = False
                    for v, c in zip(*_coarse(d[apart]), strict=True):
                        found[int(v)] = found.get(int(v), 0) + int(c)
                yield {"side": side} | totals(found)

        return run

    def everything(middle: dict[int, float]):
        """Sums over all pairs (kind 0: xx, yy, xy and how many), each view's greatest distance (1), all pairs of different rows in coarse ranges (2) and in
        units around ``middle`` (3; v = -1 are those below)."""
        unit = {s: 2.0 ** (math.floor(math.log2(v)) - 27) for s, v in middle.items()}
        low = {s: max(0, round(v / unit[s]) - NEAR // 2) for s, v in middle.items()}

        def run(group: int, sides: list[Walk]) -> Iterator[dict]:
            sums, top = np.zeros(3), [0.0, 0.0]
            pairs, coarse, near, below = 0, ({}, {}), {s: np.zeros(NEAR, np.int64) for s in middle}, dict.fromkeys(middle, 0)
            for part in slices(group, np.arange(n)):
                of = []
                for side, walk in enumerate(sides):
                    d = walk.distances(part, t) if walk.has[part].any() else np.zeros((n, len(part)))
                    of.append(d)
                    apart = walk.has[:, None] & walk.has[part][None, :]
                    apart[part, np.arange(len(part))] = False
                    d = d[apart]
                    if not len(d):
                        continue
                    top[side] = max(top[side], float(d.max()))
                    if robust:
                        for v, c in zip(*_coarse(d), strict=True):
                            coarse[side][int(v)] = coarse[side].get(int(v), 0) + int(c)
                        if side in middle:
                            d = np.rint(np.divide(d, unit[side], out=d), out=d)
                            below[side] += int(np.count_nonzero(d < low[side]))
                            near[side] += np.bincount((d[(d >= low[side]) & (d < low[side] + NEAR)] - low[side]).astype(np.int64), minlength=NEAR)
                both = [sides[0].has & sides[1].has, (sides[0].has & sides[1].has)[part]]
                x, y = ((d if all(b.all() for b in both) else d[np.ix_(*both)]).ravel() for d in of)
                sums += (x @ x, y @ y, x @ y)
                pairs += x.size
            yield {"kind": 0, "side": 0, "v": np.arange(3), "n": pairs, "s": sums}
            yield {"kind": 1, "side": np.arange(2), "s": np.array(top)}
            for side in (0, 1):
                yield {"kind": 2, "side": side} | totals(coarse[side])
                if side in middle:
                    some = np.flatnonzero(near[side])
                    yield {"kind": 3, "side": side, "v": np.append(some + low[side], -1), "n": np.append(near[side][some], below[side])}

        return run, unit

    def where(counts: DataFrame) -> dict[int, float]:
        """Each view's lower median by coarse counts (side, v, n), to a thousandth; a few thousand ranges reach the driver."""
        rows, out = counts.groupBy("side", "v").agg(F.sum("n").alias("n")).orderBy("side", "v").collect(), {}
        for side in (0, 1):
            v, c = (np.array([r[x] for r in rows if r.side == side], np.int64) for x in ("v", "n"))
            if len(v):
                at = int(v[np.searchsorted(2 * np.cumsum(c), c.sum())])
                out[side] = float(np.array([(at << 42) + (1 << 41)], np.int64).view(float)[0]) if at else 0.0
        return out

    middle: dict[int, float] = {}
    if robust:
        drawn = {}
        for side in (0, 1):
            one = graph.where(F.col("side") == side)
            ranks = one.approxQuantile("square", [(q + 0.5) / DRAWN for q in range(DRAWN)], 1e-4)
            drawn[side] = [r.i for r in one.where(F.col("square").isin(ranks)).groupBy("square").agg(F.min("i").alias("i")).collect()]
        middle = {s: v for s, v in where(walks(graph, drawn_counts(drawn), "side int, v long, n long")).items() if v}
    while True:
        run, unit = everything(middle)
        found = rounds.write(walks(graph, run, "kind int, side int, v long, n long, s double"))
        sums = {r.v: r for r in found.where("kind = 0").groupBy("v").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
        by = {r.side: r.s for r in found.where("kind = 1").groupBy("side").agg(F.max("s").alias("s")).collect()}
        if not robust:
            break
        truth, by, missed = where(found.where("kind = 2")), {}, {}
        every = {r.side: r.n for r in found.where("kind = 2").groupBy("side").agg(F.sum("n").alias("n")).collect()}
        for side, v in truth.items():
            counts = found.where((F.col("kind") == 3) & (F.col("side") == side)).groupBy("v").agg(F.sum("n").alias("n"))
            below = next((r.n for r in counts.where("v < 0").collect()), 0)
            hit = None
            if side in middle and 2 * below < every[side]:
                hit = running(counts.where("v >= 0"), [], "v", ["n"]).where(2 * (F.col("run_n") + below) >= every[side]).agg(F.min("v").alias("v")).first().v
            if hit is not None:
                by[side] = hit * unit[side]
            elif v:
                missed[side] = v
        if not missed:
            break
        middle |= missed
    x, y = (by.get(side, 0.0) + 1e-8 for side in (0, 1))
    mse = max(0.0, sums[0].s / x**2 + sums[1].s / y**2 - 2 * sums[2].s / (x * y)) / sums[0].n if sums and sums[0].n else None
    return df.sparkSession.createDataFrame([(mse,)], "mse double")
