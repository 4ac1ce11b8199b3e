"""Embedding near-dedup by lattice hashing: projections decoded to E8 points in several tables, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Scratch, components, mix, table

BLOCK = 2000  # rows of a cell that are compared at once; larger cells are dealt out as pairs of blocks


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or all +-1/2 with an even number of minus signs."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    return np.array(whole + [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    e = (x - f)[odd]
    k = np.abs(e).argmax(1)
    f[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point to each row: E8 is D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Cells of unit vectors: in each table ``blocks`` projections to 8 dimensions, each decoded to E8."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.projection = rng.normal(size=(tables, dim, 8 * blocks)) * scale / np.sqrt(8)
        self.factors = rng.integers(1, 2**63, size=8 * blocks, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tables, self.blocks, self.probes = tables, blocks, probes

    def _keys(self, points: np.ndarray) -> np.ndarray:
        twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
        return (mix((twice * self.factors).sum(-1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """int32 [n, tables, 1 + probes]: the home cell, then the cells whose centres lie nearest among the home's neighbours."""
        n, out = len(unit), np.zeros((len(unit), self.tables, 1 + self.probes), np.int32)
        for t in range(self.tables):
            x = (unit @ self.projection[t]).reshape(n * self.blocks, 8)
            home = nearest_e8(x)
            gain = ((x - home) @ ROOTS.T).reshape(n, self.blocks * len(ROOTS))
            top = np.argsort(-gain, axis=1, kind="stable")[:, : self.probes]
            home = home.reshape(n, self.blocks, 8)
            out[:, t, 0] = self._keys(home.reshape(n, -1))
            for p in range(self.probes):
                near = home.copy()
                block, root = np.divmod(top[:, p], len(ROOTS))
                near[np.arange(n), block] += ROOTS[root]
                out[:, t, 1 + p] = self._keys(near.reshape(n, -1))
        return out


def plan_for(n: int) -> dict:
    """The lattice's plan for n different vectors: cells shrink and tables grow with log n, without steps.

    With three E8 blocks and six probes a table finds a pair of cosine 0.9 with a chance of about exp(-0.94 - 3 * (scale - 1)), for
    16 to 384 dimensions alike; so many tables are taken that less than 1 in 25 such pairs is missed. The share of all pairs that
    meet falls by about 18 when n grows by 100, so that work grows as n to the power of 1.4. Tests measure recall and share.
    """
    scale = max(1.0, 1.2 + 0.1 * math.log10(max(n, 1) / 10_000))
    found = math.exp(-0.94 - 3 * (scale - 1))
    return {"blocks": 3, "scale": scale, "probes": 6, "tables": math.ceil(math.log(25) / -math.log(1 - found))}


MOST_TABLES = 1024  # a cell's table and its vectors' dimension are one number


def _prepare(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if y is None else y for y in v], np.float64) if v else np.zeros(0)
                good = len(x) and np.isfinite(x).all() and x.any()
                out.append((x + 0.0).astype(kind).tobytes() if good else None)
            cid = [None if b is None else xxhash.xxh3_64_intdigest(b) - 2**63 for b in out]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cid, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "cid", "v"])

    return run


def _deal(kind: str, plan: dict):
    """Each vector with its dimension and the keys of its cells, table by table, home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in batches:
            raw = batch.column("v").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, b in enumerate(raw):
                by_dim.setdefault(len(b), []).append(i)
            for size, rows in by_dim.items():
                for part in np.array_split(np.array(rows), -(-len(rows) // 500)):
                    x = np.frombuffer(b"".join(raw[i] for i in part), kind).reshape(len(part), -1).astype(np.float64)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    if x.shape[1] not in made:
                        made[x.shape[1]] = Lattice(x.shape[1], **plan)
                    cells = made[x.shape[1]].cells(unit).reshape(len(part), -1)
                    take = batch.take(pa.array(part))
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * cells.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [take.column("cid"), take.column("size"), pa.array(np.full(len(part), size, np.int32)), take.column("v"), pa.array([c.tobytes() for c in cells], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(cells.reshape(-1)))],
                        ["cid", "size", "dim", "v", "keys", "cells"])

    return run


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Components of a small graph: the least index that each can reach."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _links(cid, size, home, side, unit, keys, tab: int, least: float):
    """Of a cell's rows: how much each links to here for the first time, and its component here. side 0/1: only across, 2: all."""
    n = len(cid)
    counts, left, right = np.zeros(n, np.int64), [], []
    owners = np.flatnonzero(home)
    for at in range(0, len(owners), 256):
        own = owners[at : at + 256]
        a, b = np.nonzero(unit[own] @ unit.T >= least)
        a = own[a]
        ok = (cid[a] != cid[b]) & (~home[b] | (cid[a] < cid[b])) & ((side[a] != side[b]) | (side[a] == 2))
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        left.append(a)
        right.append(b)
        first = np.ones(len(a), bool)
        for t in range(tab + 1):
            ka, kb = keys[a, t], keys[b, t]
            a_visits, b_visits = (ka[:, 1:] == kb[:, :1]).any(1), (kb[:, 1:] == ka[:, :1]).any(1)
            if t < tab:
                first &= ~((ka[:, 0] == kb[:, 0]) | a_visits | b_visits)
            else:  # in this table they may meet in either home: the smaller one's counts
                first &= (ka[:, 0] == kb[:, 0]) | (cid[a] < cid[b]) | ~a_visits
        np.add.at(counts, a[first], size[b[first]])
        np.add.at(counts, b[first], size[a[first]])
    if not left:
        return None
    i, j = np.concatenate(left), np.concatenate(right)
    linked = np.unique(np.concatenate([i, j]))
    order = np.argsort(cid, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    lab = _labels(n, rank[i], rank[j])
    return cid[linked], counts[linked], cid[order][lab[rank[linked]]]


def _compare(kind: str, least: float, plan: dict):
    shape = (plan["tables"], 1 + plan["probes"])
    names = ["tab", "cell", "x", "y"]

    def group(t: pa.Table):
        if t.num_rows < 2:
            return None
        ids, first = np.unique(t.column("cid").to_numpy(), return_index=True)
        home = t.column("home").to_numpy(zero_copy_only=False)
        if len(ids) < t.num_rows:  # cells of one table may share a key: a vector's home row stands for it
            order = np.lexsort([~home, t.column("cid").to_numpy()])
            keep = order[np.concatenate([[True], np.diff(t.column("cid").to_numpy()[order]) != 0])]
            t, home = t.take(pa.array(np.sort(keep))), home[np.sort(keep)]
        if t.num_rows < 2 or not home.any():
            return None
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(t.num_rows, -1).astype(np.float64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.int32).reshape(-1, *shape)
        side = t.column("side").to_numpy()
        return _links(t.column("cid").to_numpy(), t.column("size").to_numpy(), home, side, unit, keys, int(t.column("tab")[0].as_py()) % MOST_TABLES, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            now = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if now is None or not now.num_rows:
                continue
            k = np.stack([now.column(c).to_numpy().astype(np.int64) for c in names], 1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            cuts = [0, *cuts.tolist(), *([now.num_rows] if batch is None else [])]
            done = [g for a, b in itertools.pairwise(cuts) if (g := group(now.slice(a, b - a).combine_chunks())) is not None]
            rest = now.slice(cuts[-1])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], ["cid", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, plan: dict | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links have cosine ``least`` or more in double precision.

    Equal vectors are one class from the start; classes meet in cells. A cell with over ``block`` rows is compared as pairs
    of blocks. Tasks return counts and components of what they compared, not pairs; a pair that meets in several cells
    counts in the first. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do rows
    with a null vec_id (their component is null and kept is false). Vectors of different dimensions don't link; one of any
    dimension is held whole. A repeated row is a vector of its own. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_prepare(kind), "vec_id long, cid long, v binary")
    rows = scratch.write(rows.withColumn("cid", F.when(F.col("vec_id").isNotNull(), F.col("cid"))), "rows")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    classes = scratch.write(classes, "classes")
    plan = plan or plan_for(classes.count())
    each = 1 + plan["probes"]

    known = classes.select("cid", "size", "v").mapInArrow(_deal(kind, plan), "cid long, size long, dim int, v binary, keys binary, cells array<int>")
    known = scratch.write(known, "known")
    cells = known.select("cid", "dim", F.posexplode("cells").alias("at", "cell"))
    cells = cells.select("cid", (F.col("dim") * MOST_TABLES + F.floor(F.col("at") / each)).cast("int").alias("tab"), "cell", (F.col("at") % each == 0).alias("home"))
    sizes = cells.groupBy("tab", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("n")).where("homes > 0 and n > 1")
    sizes = scratch.write(sizes.select("tab", "cell", F.ceil(F.col("n") / block).cast("int").alias("nb")), "sizes")
    dealt = cells.join(sizes, ["tab", "cell"])
    mine = F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    dealt = dealt.withColumn("side", F.when(F.col("x") == F.col("y"), 2).otherwise((F.col("mine") == F.col("y")).cast("int"))).drop("mine", "other", "nb")
    dealt = dealt.join(known.select("cid", "size", "v", "keys"), "cid")
    dealt = dealt.repartition("tab", "cell", "x", "y").sortWithinPartitions("tab", "cell", "x", "y")
    found = scratch.write(dealt.mapInArrow(_compare(kind, least, plan), "cid long, links long, low long"), "found")
    scratch.drop(known, sizes)

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    tree = components(found.select("cid", "low"), scratch, "cid", "low")
    named = scratch.write(tree.join(classes.select(F.col("cid").alias("node"), "low_id"), "node"), "named")
    roots = scratch.write(named.groupBy("component").agg(F.min("low_id").alias("component_id")), "roots")
    named = named.join(roots, "component").select(F.col("node").alias("cid"), "component_id")
    info = classes.select("cid", "low_id", "size").join(links, "cid", "left").join(named, "cid", "left")
    info = info.select("cid", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low_id").alias("component_id"))
    info = scratch.write(info, "info")
    scratch.drop(classes, found, tree, named, roots)
    able = rows.where("cid is not null").select("vec_id", "cid").join(info, "cid").select("vec_id", "n_links", "component_id")
    rest = rows.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return able.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


OP2_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
reach AS (SELECT vec_id, vec_id AS r FROM e UNION SELECT l.a, reach.r FROM links l JOIN reach ON l.b = reach.vec_id WHERE reach.r < l.a),
low AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
"""
