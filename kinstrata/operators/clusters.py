"""Single-linkage clusters of a whole table: a minimum spanning tree by rounds of joins, lifetimes of components, members at a cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import Rounds
from .vectors import SMALL, Blocks, block_products, k_best


def _roots(links: DataFrame, rounds: Rounds) -> DataFrame:
    """(c, p) with p the end of the way from c; links (c, p) have no cycle and a p for each c. The ways are halved in each round."""
    now = rounds.write(links)
    while True:
        above = now.select(F.col("c").alias("p"), F.col("p").alias("q"))
        new = rounds.write(now.join(above, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("c", "p")
        now = new.select("c", "p")


def _relabelled(labels: DataFrame, links: DataFrame, rounds: Rounds) -> DataFrame:
    roots = _roots(links, rounds)
    return rounds.write(labels.join(roots, "c", "left").select("i", F.coalesce("p", "c").alias("c")))


def _shortest(t: Blocks, k: int, apart: bool) -> pd.DataFrame:
    """(i, d, j, o): each row's k shortest edges to other rows (``apart``: of other components), by distance to 9 places and then j."""
    left, right = (t.a * t.a).sum(1), (t.b * t.b).sum(1)
    slack = 1e-12 * (left.max(initial=0) + right.max(initial=0)) + 1e-15
    mine, other = t.x["c"].to_numpy(), t.y["o"].to_numpy()

    def value(r: slice, c: slice, s: np.ndarray) -> np.ndarray:
        s *= 2
        s -= left[r][:, None]
        s -= right[c][None, :]
        s[(mine[r][:, None] == other[c][None, :]) if apart else t.same(r, c)] = -np.inf
        return s

    def exact(row: np.ndarray, column: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), 1 << 16):
            part = slice(at, at + (1 << 16))
            out[part] = -np.round(np.sqrt(((t.a[row[part]] - t.b[column[part]]) ** 2).sum(1)), 9)
        return out

    wide = 4e-9 * np.sqrt(left.max(initial=0) + right.max(initial=0)) + 1e-17  # what rounding a distance can do to its square
    best, who = k_best(t, k, value, exact, lambda last: -last * last - slack - 4e-9 * np.where(np.isfinite(last), -last, 0), slack + 2 * wide)
    row, place = np.nonzero(np.isfinite(best))
    return pd.DataFrame({"i": t.i[row], "d": -best[row, place], "j": t.j[who[row, place]], "o": other[who[row, place]]})


EDGE = "i long, d double, j long, o long"


def spanning_tree(df: DataFrame, key: str, vector: str, per_block: int = SMALL, most: float | None = None, near: int = 8) -> DataFrame:
    """(a, b, d), a < b: the minimum spanning tree of the rows by Euclidean distance (rounded to 9 places; ties by a, then b); with
    ``most`` only its edges of at most that length.

    In each round every component takes its shortest edge to another one (Boruvka), so there are at most log2 of n rounds. All rows are compared
    once for each row's ``near`` nearest rows. A component whose shortest edge is in these lists (each row of it has another component's row in its list, or
    a list that ends beyond that edge) is settled by joins; for the others only the rows whose lists end too soon are compared with all rows.
    The largest component may wait: that the others take an edge is enough. Work is quadratic in the rows, a task's memory and what is shuffled are not.
    Keys differ; rows without a key or a vector are left out; one row or none has no edge.
    """
    rounds = Rounds(df, "spanning-tree")
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("a"))
    rows = rounds.write(rows)
    labels, tree, limit = rounds.write(rows.select("i", F.col("i").alias("c"))), None, float("inf") if most is None else most
    edge = F.struct("d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "o")

    def compared(asking: DataFrame, k: int, apart: bool) -> DataFrame:
        left = rows.join(asking, "i").select("i", "a", "c")
        right = rows.join(labels, "i").select(F.col("i").alias("j"), F.col("a").alias("b"), F.col("c").alias("o"))
        return block_products(left, right, lambda t: _shortest(t.finite(), k, apart), EDGE, per_block)

    ranked = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    lists = rounds.write(compared(labels, near, False).withColumn("r", ranked).where(F.col("r") <= near).select("i", "d", "j", "r"))
    ends = rounds.write(lists.groupBy("i").agg(F.when(F.count("*") < near, float("inf")).otherwise(F.max("d")).alias("end")))
    searched = None  # rows that have no other component's row within ``most``: with none now, they never get one
    while True:
        known = lists.where(F.col("d") <= limit).join(labels, "i").join(labels.select(F.col("i").alias("j"), F.col("c").alias("o")), "j").where("c <> o")
        first = known.groupBy("i").agg(F.min(edge).alias("e"))
        rest = labels.join(ends, "i").join(first, "i", "left")
        if searched is not None:
            rest = rest.join(searched, "i", "left_anti")
        rest = rounds.write(rest)
        ours = rest.groupBy("c").agg(F.min("e").alias("e"))
        largest = labels.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").select("c").limit(1)
        asking = rest.where(F.col("e").isNull() & (F.col("end") <= limit)).select("i", "c", "end").join(ours, "c", "left")
        asking = rounds.write(asking.where(F.col("e").isNull() | (F.col("end") <= F.col("e.d"))).join(largest, "c", "left_anti").select("i", "c"))
        waiting = rest.where(F.col("e").isNull() & (F.col("end") <= limit)).select("c", "end").join(ours, "c", "left").where(F.col("e").isNull() | (F.col("end") <= F.col("e.d"))).select("c").distinct()
        waiting = waiting.join(largest, "c")  # the largest component, if its shortest edge isn't known
        best = ours.where("e IS NOT NULL")
        if not asking.isEmpty():
            more = rounds.write(compared(asking, 1, True).where(F.col("d") <= limit).groupBy("i").agg(F.min(edge).alias("e")))
            best = best.unionByName(more.join(labels, "i").select("c", "e"))
            none = asking.join(more, "i", "left_anti").select("i")
            searched = rounds.write(none if searched is None else searched.unionByName(none))
        found = rounds.write(best.join(waiting, "c", "left_anti").groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        if found.isEmpty():
            break
        edges = found.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "d").distinct()
        tree = edges if tree is None else tree.unionByName(edges)
        back = found.select(F.col("c").alias("o"), F.col("o").alias("back"))
        links = found.join(back, "o", "left").where("back IS NULL OR back <> c OR c > o").select("c", F.col("o").alias("p"))
        labels = _relabelled(labels, links, rounds)
    return tree if tree is not None else df.sparkSession.createDataFrame([], "a long, b long, d double")


def lifetimes(tree: DataFrame) -> DataFrame:
    """(rank, death, a, b): when components merge as the distance grows (all are born at 0), the longest first; the edge that merges them."""
    bucket = F.round("d", 3)  # ranks inside narrow ranges of distances, and the count of the ranges above
    above = tree.groupBy(bucket.alias("r")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("d"), "a", "b"))
    return tree.withColumn("r", bucket).withColumn("k", inside).join(above, "r").select((F.col("before") + F.col("k")).alias("rank"), F.col("d").alias("death"), "a", "b")


def members(df: DataFrame, key: str, tree: DataFrame, cut: float) -> DataFrame:
    """(key, cluster): the least key of those that edges of at most ``cut`` connect with each row of df; one row a distinct key."""
    rounds = Rounds(df, "clusters")
    labels = rounds.write(df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("i")).distinct().withColumn("c", F.col("i")))
    edges = rounds.write(tree.where(F.col("d") <= cut).select("a", "b"))
    while True:
        ends = [labels.select(F.col("i").alias(e), F.col("c").alias(f"c{e}")) for e in "ab"]
        apart = edges.join(ends[0], "a").join(ends[1], "b").where("ca <> cb")
        links = rounds.write(apart.select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("p")).groupBy("c").agg(F.min("p").alias("p")))
        if links.isEmpty():
            return labels.select(F.col("i").alias(key), F.col("c").alias("cluster"))
        labels = _relabelled(labels, links, rounds)
