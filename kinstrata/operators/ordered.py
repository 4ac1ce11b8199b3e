"""Order without one task per group: values are dealt into ranges, and ranges meet only in a small table of their totals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys, null keys too; the right side's other columns are added."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # the right side is one row
    a, b = left.alias("a"), right.alias("b")
    on = reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    return a.join(b, on, how).select("a.*", *(f"b.{c}" for c in right.columns if c not in keys))


def ranges(df: DataFrame, keys: list[str], at: str, n: int = 64) -> DataFrame:
    """df with __range: rows with smaller values are never in a later range; equal values share one. Bounds are approximate quantiles of each group."""
    bounds = df.groupBy(*keys).agg(F.percentile_approx(at, [i / n for i in range(1, n)], 1000).alias("__bounds"))
    return _null_safe(df, bounds, keys).withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(at)))).drop("__bounds")


def running(df: DataFrame, keys: list[str], at: str, amounts: list[str], n: int = 64) -> DataFrame:
    """df, whose ``at`` differ inside a group, with run_<amount> (sums up to and with this row) and next (the next row's ``at``)."""
    dealt = ranges(df, keys, at, n)
    totals = dealt.groupBy(*keys, "__range").agg(*(F.sum(a).alias(f"__t_{a}") for a in amounts), F.min(at).alias("__first"))
    over = Window.partitionBy(*keys).orderBy("__range")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__range", *(F.coalesce(F.sum(f"__t_{a}").over(before), F.lit(0)).alias(f"__b_{a}") for a in amounts), F.lead("__first").over(over).alias("__later"))
    inner = Window.partitionBy(*keys, "__range").orderBy(at)
    inside = inner.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"__i_{a}": F.sum(a).over(inside) for a in amounts} | {"__near": F.lead(at).over(inner)})
    out = _null_safe(out, totals, [*keys, "__range"])
    return out.select(*df.columns, *((F.col(f"__i_{a}") + F.col(f"__b_{a}")).alias(f"run_{a}") for a in amounts), F.coalesce("__near", "__later").alias("next"))


def places(df: DataFrame, keys: list[str], at: str, out: str = "place", n: int = 64) -> DataFrame:
    """Places from 1 by ``at`` inside each group; ``at`` differ inside a group."""
    ranked = running(df.withColumn("__one", F.lit(1)), keys, at, ["__one"], n)
    return ranked.withColumnRenamed("run___one", out).drop("__one", "next")


def long_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, x): a row per row and column; NaN is null."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x")) for c in cols))
    return df.select(F.explode(pairs).alias("p")).select("p.name", "p.x")


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, x, k): how often each value stands in a column."""
    return long_columns(df, cols).where("x is not null").groupBy("name", "x").agg(F.count("*").alias("k"))


def exact_quantiles(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(name, n_distinct, one column per share) from value_counts: linear between the two nearest ranks, as numpy and pandas do."""
    ranked = running(counts, ["name"], "x", ["k"])
    sizes = counts.groupBy("name").agg(F.sum("k").alias("__n"), F.count("*").alias("n_distinct"))
    r = _null_safe(ranked, sizes, ["name"])
    found = []
    for share in shares.values():
        at = (F.col("__n") - 1) * F.lit(share)
        for rank in (F.floor(at), F.ceil(at)):
            found.append(F.max(F.when((rank >= F.col("run_k") - F.col("k")) & (rank < F.col("run_k")), F.col("x"))))
    out = r.groupBy("name", "__n", "n_distinct").agg(*(c.alias(f"__q{i}") for i, c in enumerate(found)))
    one = lambda i, share: F.col(f"__q{2 * i}") + (F.col(f"__q{2 * i + 1}") - F.col(f"__q{2 * i}")) * ((F.col("__n") - 1) * share - F.floor((F.col("__n") - 1) * share))
    return out.select("name", "n_distinct", *(one(i, share).alias(name) for i, (name, share) in enumerate(shares.items())))
