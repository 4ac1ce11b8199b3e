"""Incremental outputs: a ledger of input digests per group, so that only groups whose rows changed are built and written again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def digests(df: DataFrame, by: str) -> DataFrame:
    """(by, __n, __x, __s): count, exclusive or and sum of the hashes of each group's rows, whatever their order; null groups are one group."""
    rows = df.select(by, F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns))).alias("__h"), F.xxhash64(F.lit(1), *(F.col(f"`{c}`").cast("string") for c in sorted(df.columns))).alias("__g"))
    return rows.groupBy(by).agg(F.count("*").alias("__n"), F.bit_xor("__h").alias("__x"), F.sum(F.col("__g").cast("decimal(20,0)")).alias("__s"))


def changes(now: DataFrame, before: DataFrame, by: str) -> DataFrame:
    """(by, change): groups that are new, changed or gone between two tables of digests."""
    a, b = now.alias("a"), before.alias("b")
    both = a.join(b, F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")), "full")
    same = F.expr("a.__n <=> b.__n AND a.__x <=> b.__x AND a.__s <=> b.__s")
    change = F.when(F.col("b.__n").isNull(), "new").when(F.col("a.__n").isNull(), "gone").when(~same, "changed")
    return both.select(F.when(F.col("a.__n").isNull(), F.col(f"b.{by}")).otherwise(F.col(f"a.{by}")).alias(by), change.alias("change")).where("change IS NOT NULL")


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _ledger(spark: SparkSession, path: str, by: str, empty: DataFrame) -> tuple[DataFrame, list[str]]:
    """The newest ledger and the names of all; ``empty`` where there is none."""
    fs, at = _store(spark, f"{path}/ledger")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
    whole = [n for n in names if fs.exists(_store(spark, f"{path}/ledger/{n}/_SUCCESS")[1])]
    return (spark.read.schema(empty.schema).parquet(f"{path}/ledger/{whole[-1]}") if whole else empty), names


def refresh(df: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, DataFrame]:
    """(output, changes): the table of build(rows of each group), where only groups whose rows differ from the last call's are built.

    build() must keep ``by`` and give a group's rows from that group's rows alone. Output is parted by group under path/data and replaced
    group by group (dynamic partition overwrite), groups that are gone are deleted, and the ledger is written last: a call that
    fails is made up for by the next, which finds the same groups changed. Groups must be texts or whole numbers.
    """
    spark = df.sparkSession
    now = digests(df, by)
    before, names = _ledger(spark, path, by, now.limit(0))
    number = int(names[-1].split("-")[0]) + 1 if names else 0
    run = f"{number:08d}-{uuid.uuid4().hex[:8]}"
    now.write.parquet(f"{path}/digests/{run}")  # a row per group: the rows are read once for it, and the ledger is a copy
    now = spark.read.schema(now.schema).parquet(f"{path}/digests/{run}")
    found = f"{path}/changes/{run}"
    changes(now, before, by).write.parquet(found)
    diff = spark.read.parquet(found)
    fs, _ = _store(spark, path)
    some = diff.where("change <> 'gone'").select(by)
    if not some.isEmpty():
        rows = df.alias("d").join(some.alias("c"), F.col(f"d.{by}").eqNullSafe(F.col(f"c.{by}")), "left_semi")
        build(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/data")
    for row in diff.where("change = 'gone'").select(F.coalesce(F.col(by).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("g")).toLocalIterator():
        fs.delete(_store(spark, f"{path}/data/{by}={row['g']}")[1], True)
    if not diff.isEmpty() or not names:
        now.write.parquet(f"{path}/ledger/{run}")
    kind = df.schema[by].dataType
    out = spark.read.schema(build(df).schema).parquet(f"{path}/data") if fs.exists(_store(spark, f"{path}/data")[1]) else build(df.limit(0))
    return out.withColumn(by, F.col(by).cast(kind)), diff
