"""What the operators share: scratch tables, Arrow slices, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets its own; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kinstrata-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a batch of very long texts fits in a Python worker.

    Spark reads these settings when a result is computed, after the operator has returned, so they stay; smaller ones are kept.
    """
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def shuffle_files_go(spark: SparkSession):
    """Shuffle files of a query go when it ends; its result is a table that all executors can read."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive a lost executor.

    What an operator's result doesn't read goes by drop(); the rest goes when the driver ends. An aggregate that is joined to
    its own input is written first: Spark splits a hot key's rows only in a join of two shuffled tables.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}", {}
        small_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        with shuffle_files_go(self.spark):
            df.write.parquet(path)
        if not self.paths:
            fs, at = self._store(self.base)
            fs.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def _store(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path, _ = self.paths.get(id(df), (None, None))
            if path:
                fs, at = self._store(path)
                fs.delete(at, True)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most`` bytes; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def rolling(f, a: np.ndarray, k: int) -> np.ndarray:
    """f over each k neighbours, in about log2(k) passes; f is np.minimum or the like."""
    out, w = a, 1
    while w * 2 <= k:
        out = f(out[:-w], out[w:])
        w *= 2
    return f(out[: len(out) - (k - w)], out[k - w :]) if w < k else out


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits (the finaliser of splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space (as bytes.split() finds them), from prefix sums over the bytes."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[b]
    turns = np.concatenate([[0] * int(inside[0]), np.flatnonzero(inside[1:] != inside[:-1]) + 1, [len(b)] * int(inside[-1])]).astype(np.int64)
    start, end = turns[::2], turns[1::2]
    up, down = Windows.powers(BASES[0], len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(BASES[1]))


class Windows:
    """Polynomial hashes of all windows of a length, from prefix sums modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, h: np.ndarray, base: int):
        self.n = len(h)
        up, self.down = self.powers(base, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: self.n], dtype=np.uint64)])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._powers.get(base)
        if got is None or len(got[0]) < n:
            size = max(1 << 16, 1 << max(0, n - 1).bit_length())
            got = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            if size <= 1 << 22:
                cls._powers[base] = got
        return got

    def of(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.zeros(0, np.uint64)
        m = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:m]) * self.down[:m])


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached. Nodes without an edge are not listed.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) by aggregates and joins; each round is a written
    table and no group is gathered. Each node's least neighbour is written before it is joined, so that Spark splits the
    rows of a node with very many neighbours.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = scratch.write(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, "large")
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        # stars alone are left: each node has one smaller neighbour, which has none
        if not least.where("n > 1").isEmpty() or not large.join(least.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new, done = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small"), False
        else:
            new, done = large, True
        scratch.drop(now, low, least, *([] if done else [large]))
        now = new
        if done:
            break
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = tree.select("component").distinct().select(F.col("component").alias("node"), "component")
    out = scratch.write(tree.unionByName(roots), "components")
    scratch.drop(now)
    return out


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front where a column has that name (in any case) already."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out
