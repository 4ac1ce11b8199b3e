"""Approximate nearest neighbours by an inverted file: vectors in lists around centroids, a few lists probed for each query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import Rounds
from .vectors import BLOCKS, COSINE, DENSE, LARGE, TILE, Best, Products, nearest, normalized

#: At most so many centroids, fitted on at most SAMPLE vectors a centroid: what reaches the driver and is sent to tasks.
MOST_LISTS, SAMPLE = 4096, 40
#: A batch that copies vectors to their lists holds about so many numbers, however many lists are probed.
BATCH = 1_000_000


def centroids_of(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on cosines. An empty centroid moves to the vector that is worst served."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, sim = assign(x, c, 1)
        near, sim = near[:, 0], sim[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(c))
        empty = np.flatnonzero(size == 0)
        total[empty] = x[np.argsort(sim, kind="stable")[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def assign(x: np.ndarray, c: np.ndarray, probes: int, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(lists, cosines) of the ``probes`` nearest centroids of each vector, the nearest first; ties go to the smaller list."""
    lists, sims = [], []
    for k in range(0, len(x), rows):
        s = x[k : k + rows] @ c.T
        at = s.argmax(1)[:, None] if probes == 1 else np.argsort(-s, axis=1, kind="stable")[:, :probes]
        lists.append(at)
        sims.append(np.take_along_axis(s, at, 1))
    return np.concatenate(lists), np.concatenate(sims)


def fit_lists(df: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Centroids from at most ``sample`` vectors a list, those with the least hashes of their keys; lists: about the root of the rows by default."""
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), normalized(F.col(vector)).alias("v"))
    n = rows.count()
    lists = min(MOST_LISTS, n, lists or math.ceil(math.sqrt(n)))
    if not lists:
        return np.zeros((0, 0), np.float32)
    drawn = rows.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(lists * sample).toPandas()
    return centroids_of(np.stack(drawn["v"]).astype(np.float32), lists, seed=seed)


def in_lists(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(list, id, v): each vector under its ``probes`` nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                at, _ = assign(x.astype(np.float32), centroids, probes)
                step = max(1, BATCH // max(1, at.shape[1] * x.shape[1]))
                for j in range(0, part.num_rows, step):
                    some = at[j : j + step]
                    which = pa.array(np.repeat(np.arange(j, j + len(some)), some.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(some.ravel(), pa.int64()), part.column("id").take(which), part.column("v").take(which)], ["list", "id", "v"])

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), normalized(F.col(vector)).alias("v"))
    return rows.mapInArrow(run, "list long, id long, v array<double>")


def in_groups(df: DataFrame, key: str, vector: str, centroids: np.ndarray, probes: int, groups: int) -> DataFrame:
    """(group, asked, id, v): each vector once for every group (list modulo ``groups``) with some of its ``probes`` nearest lists; bit n of
    ``asked`` stands for the group's n-th list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            step = max(1, BATCH // max(1, groups * x.shape[1]))
            for k in range(0, batch.num_rows, step):
                at, _ = assign(x[k : k + step].astype(np.float32), centroids, probes)
                bits = np.zeros((len(at), groups, -(-len(centroids) // groups)), bool)
                bits[np.arange(len(at))[:, None], at % groups, at // groups] = True
                row, group = np.nonzero(bits.any(2))
                asked = [m.tobytes() for m in np.packbits(bits[row, group], axis=1, bitorder="little")]
                which = pa.array(row + k)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(asked, pa.binary()), batch.column("id").take(which), batch.column("v").take(which)], ["group", "asked", "id", "v"])

    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), normalized(F.col(vector)).alias("v"))
    return rows.mapInArrow(lambda batches: run(b for b in batches if b.num_rows), "group int, asked binary, id long, v array<double>")


def search(queries: DataFrame, items: DataFrame, key: str, vector: str, k: int, probes: int = 8, centroids: np.ndarray | None = None, per_block: int = 2000) -> DataFrame:
    """(i, j, sim, rank): the k most similar items of each query (never the row with its own key), by cosine rounded to 9 places.

    Items lie in the list of their nearest centroid; a query asks ``probes`` lists. With about the root of n lists the compared
    share is probes / root(n), up to MOST_LISTS lists; from there it stays at probes / MOST_LISTS. Lists are dealt into at most BLOCKS groups (more
    only where a group would hold over LARGE numbers; a group of too many items is split), and queries into as many blocks: a query is copied to the
    groups it asks, however many of their lists that are, and an item to the blocks of queries. Each task gives k
    rows a query, which are merged by rank. Recall depends on how vectors cluster; ``probes`` = lists gives exact results.
    Rows without a key or a vector are left out; vectors have one length.
    """
    centroids = fit_lists(items, key, vector) if centroids is None else centroids
    home = Rounds(items, "lists").write(in_lists(items, key, vector, centroids, 1))
    size = lambda rows: max(1, min(max(per_block, -(-rows // BLOCKS)), LARGE // max(1, centroids.shape[-1])))
    n, asking = home.count(), queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).count()
    groups, blocks, most = max(1, min(len(centroids), -(-n // size(n)))), max(1, -(-asking // size(asking))), size(n)
    group = F.pmod(F.col("list"), F.lit(groups)).cast("int").alias("group")
    parts = {r["group"]: -(-r["n"] // most) for r in home.groupBy(group).agg(F.count("*").alias("n")).collect()}  # a row a group
    split = F.element_at(F.array(*(F.lit(parts.get(g, 1)) for g in range(groups))), F.col("group") + 1)
    y = home.select(group, "list", "id", "v").select("group", F.pmod(F.xxhash64("id"), split).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"), "list", "id", "v")
    asked = in_groups(queries, key, vector, centroids, max(1, min(probes, len(centroids))), groups) if len(centroids) else queries.limit(0).selectExpr("0 AS group", "CAST('' AS binary) AS asked", "0L AS id", "CAST(array() AS array<double>) AS v")
    x = asked.select("group", F.explode(F.sequence(F.lit(0), split - 1)).alias("q"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("p"), "asked", "id", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"i": [], "j": [], "sim": []})
        b = b.sort_values("id", kind="stable")
        own, other, lists = a["id"].to_numpy(), b["id"].to_numpy(), b["list"].to_numpy()
        same = [np.searchsorted(other, own, end) for end in ("left", "right")]
        asks = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in a["asked"]]), axis=1, bitorder="little")
        products, best = Products(np.stack(a["v"]).astype(float), np.stack(b["v"]).astype(float), COSINE), Best(len(a), k)

        def look(r: np.ndarray, c: np.ndarray, double: bool) -> np.ndarray:
            s, error = products.tile(r, c, double)
            low, high = np.searchsorted(c, same[0][r]), np.searchsorted(c, same[1][r])
            n = high - low
            s[np.repeat(np.arange(len(r)), n), np.arange(n.sum()) + np.repeat(high - np.cumsum(n), n)] = -np.inf
            return np.flatnonzero(s > best.low(r, s, error, COSINE, c[0])[:, None])

        for one in np.unique(lists):
            rows, columns = np.flatnonzero(asks[:, one // groups]), np.flatnonzero(lists == one)
            for r in (rows[at : at + TILE[0]] for at in range(0, len(rows), TILE[0])):
                for c in (columns[at : at + TILE[1]] for at in range(0, len(columns), TILE[1])):
                    hit = look(r, c, False)
                    if len(hit) > DENSE * len(r) * len(c):
                        hit = look(r, c, True)
                    row, column = np.divmod(hit, len(c))
                    best.put(r[row], c[column], products.exact(r[row], c[column]))
        row, place = np.nonzero(np.isfinite(best.score))
        return pd.DataFrame({"i": own[row], "j": other[best.who[row, place]], "sim": best.score[row, place]})

    found = x.groupBy("group", "p", "q").cogroup(y.groupBy("group", "p", "q")).applyInPandas(run, "i long, j long, sim double")
    w = Window.partitionBy("i").orderBy(F.desc("sim"), "j")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def probes_for(df: DataFrame, key: str, vector: str, k: int, centroids: np.ndarray, least: float = 0.95, queries: int = 200, seed: int = 6) -> int:
    """How many lists must be probed so that ``queries`` rows, drawn by hashes of their keys, find that share of their true k neighbours.

    The drawn rows are compared with all rows, so the work is linear; at most queries * k pairs of vectors reach the driver.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), normalized(F.col(vector)).alias("v"))
    drawn = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries)
    truth = search(drawn, rows, "id", "v", k, len(centroids), centroids)
    a, b = rows.select(F.col("id").alias("i"), F.col("v").alias("a")), rows.select(F.col("id").alias("j"), F.col("v").alias("b"))
    pairs = truth.join(a, "i").join(b, "j").select("a", "b").toPandas()
    if pairs.empty:
        return len(centroids)
    order, _ = assign(np.stack(pairs["a"]).astype(np.float32), centroids, len(centroids))
    home, _ = assign(np.stack(pairs["b"]).astype(np.float32), centroids, 1)
    place = np.sort((order == home).argmax(1))
    return int(place[min(len(place) - 1, int(np.ceil(least * len(place))))]) + 1


def neighbours(df: DataFrame, key: str, vector: str, k: int, probes: int | None = None, exact: bool = False, per_block: int = 2000) -> DataFrame:
    """Each row's k nearest rows of the same table by an inverted file; ``exact`` compares all pairs of rows instead.

    Without ``probes`` so many lists are probed as drawn queries need for a recall of 0.95 (probes_for): a few where vectors
    cluster, up to about half of them where they are as good as random.
    """
    if exact:
        return nearest(df, key, vector, k, per_block)
    centroids = fit_lists(df, key, vector)
    probes = probes or probes_for(df, key, vector, k, centroids)
    return search(df, df, key, vector, k, probes, centroids, per_block)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (recall): the share of the true (i, j) that were found."""
    hit = truth.select("i", "j").join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
