"""Column profiles as stored sketches that merge: counts are exact, distinct counts and quantiles within known bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: log2 of the registers of a distinct count (error about 0.6 percent), and k of quantiles (rank error about 0.7 percent).
HLL, KLL = 14, 400


def profile_sketches(df: DataFrame, by: list[str], numeric: list[str], text: list[str] = ()) -> DataFrame:
    """(by ..., name, n, missing, low, top, total, distinct, quantiles): a row per group and column, in one pass over the table.

    ``distinct`` and ``quantiles`` (null for text columns) are sketches of a few kB whatever the group's size, so a day's rows can be
    kept and merged later. NaN counts as missing.
    """
    named = [*((c, True) for c in numeric), *((c, False) for c in text)]
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("name"), (number(c) if is_number else none).alias("x"), (number(c).cast("string") if is_number else F.col(f"`{c}`").cast("string")).alias("s")) for c, is_number in named]
    rows = df.select(*by, F.explode(F.array(*cells)).alias("p")).select(*by, "p.name", "p.x", "p.s")
    return rows.groupBy(*by, "name").agg(
        F.count("s").alias("n"), F.count_if(F.col("s").isNull()).alias("missing"), F.min("x").alias("low"), F.max("x").alias("top"), F.sum("x").alias("total"),
        F.hll_sketch_agg("s", HLL).alias("distinct"), F.kll_sketch_agg_double("x", KLL).alias("quantiles"))


def merge_profiles(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """The same columns for coarser groups: sketches of parts become the sketch of the whole."""
    return sketches.groupBy(*by, "name").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("low").alias("low"), F.max("top").alias("top"), F.sum("total").alias("total"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles", KLL).alias("quantiles"))


def read_profiles(sketches: DataFrame, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by ..., name, n, missing, mean, low, top, n_distinct, a column per share) from sketches. Quantiles are values that occur; null without numbers."""
    some = F.kll_sketch_get_n_double("quantiles") > 0
    return sketches.select(
        *by, "name", "n", "missing", F.try_divide("total", "n").alias("mean"), "low", "top", F.hll_sketch_estimate("distinct").alias("n_distinct"),
        *(F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(name) for name, q in shares.items()))
