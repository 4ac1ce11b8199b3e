"""Joins: null-safe full outer with an indicator, as-of and containment over segments, keep-first annotation, key filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], largest: tuple[str, ...] = (), keep_left: bool = False) -> DataFrame:
    """Null keys meet null keys. Shared columns: the greater of the two where named in ``largest``, else left before right (with
    ``keep_left`` left alone, as older runs came out). source_set: both, left or right."""
    l, r = left.withColumn("__l", F.lit(1)).alias("l"), right.withColumn("__r", F.lit(1)).alias("r")
    on = reduce(and_, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    shared = [c for c in left.columns if c in right.columns]

    def one(c: str) -> Column:
        if c in largest:
            return F.greatest(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c)
        if c in shared:
            return F.when(F.col("l.__l") == 1, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c) if c in keys else (F.col(f"l.{c}") if keep_left else F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}"))).alias(c)
        return F.col(("l." if c in left.columns else "r.") + c).alias(c)

    names = [*left.columns, *(c for c in right.columns if c not in left.columns)]
    source = F.when(F.col("l.__l").isNull(), "right").when(F.col("r.__r").isNull(), "left").otherwise("both").alias("source_set")
    return l.join(r, on, "full").select(*map(one, names), source)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def annotate(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], prefix: str) -> DataFrame:
    """Left join to the first right row of each key; its payload gets a prefix."""
    payload = keep_first(right, keys, order)
    return left.join(payload.select(*keys, *(F.col(c).alias(prefix + c) for c in payload.columns if c not in keys)), keys, "left")


def as_of_segment(points: DataFrame, segs: DataFrame, width: int = 100_000) -> DataFrame:
    """points(chrom, pos, ...) with seg_id and hit: the segment of the chromosome with the greatest start up to pos (then the
    greatest end and id), hit if pos is within it.

    Both sides are sorted together in bins of ``width`` bases, no range join. The last segment before a bin comes from a table
    of bins, and stands first in its bin; so a chromosome is as many tasks' work as it has bins.
    """
    at = F.floor(F.col("pos") / width)
    marks = segs.select(F.col("seg_chrom").alias("chrom"), F.col("seg_start").alias("pos"), F.struct("seg_start", "seg_end", "seg_id").alias("__s")).withColumn("__b", at)
    rows = points.withColumn("__p", F.struct(*points.columns)).select("chrom", "pos", "__p").withColumn("__b", at)
    bins = marks.select("chrom", "__b", "__s").unionByName(rows.select("chrom", "__b"), allowMissingColumns=True).groupBy("chrom", "__b").agg(F.max("__s").alias("__s"))
    before = F.max("__s").over(Window.partitionBy("chrom").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.withColumn("__s", before).where("__s is not null").select("chrom", F.col("__s.seg_start").alias("pos"), "__s", "__b")
    both = marks.unionByName(carried).unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("chrom", "__b").orderBy("pos", F.col("__p").isNotNull(), "__s.seg_end", "__s.seg_id").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__s", F.last("__s", ignorenulls=True).over(w)).where("__p is not null")
    return out.select("__p.*", F.col("__s.seg_id").alias("seg_id"), F.coalesce((F.col("pos") <= F.col("__s.seg_end")).cast("int"), F.lit(0)).alias("hit"))


LEVELS = 8  # widths of 10 kb, 80 kb ... 21 Gb


def interval_bins(segs: DataFrame, width: int = 10_000) -> DataFrame:
    """segs, each once or twice, with __level and __b: the narrowest bins (of width * 8**level bases) that a segment's length fits in,
    so that it lies in one of them or in two neighbours. A segment that ends before it starts is dropped: it contains nothing."""
    length = F.col("seg_end") - F.col("seg_start") + 1
    level, size = F.lit(LEVELS - 1), F.lit(width * 8 ** (LEVELS - 1))
    for k in range(LEVELS - 2, -1, -1):
        fits = length <= width * 8**k
        level, size = F.when(fits, k).otherwise(level), F.when(fits, width * 8**k).otherwise(size)
    dealt = segs.where("seg_end >= seg_start").withColumns({"__level": level, "__size": size.cast("long")})
    ends = F.array_distinct(F.array(F.floor(F.col("seg_start") / F.col("__size")), F.floor(F.col("seg_end") / F.col("__size"))))
    return dealt.withColumn("__b", F.explode(ends)).drop("__size")


def containing_segments(points: DataFrame, segs: DataFrame, width: int = 10_000) -> DataFrame:
    """Pairs with seg_start <= pos <= seg_end, by an index of bins of eight widths: a segment is dealt into one or two bins whatever
    its length, and a point asks one bin of each width that any segment has. The join is by equality first."""
    bins = interval_bins(segs, width)
    levels = bins.select("__level").distinct()  # LEVELS rows at most
    p = points.crossJoin(F.broadcast(levels)).withColumn("__b", F.floor(F.col("pos") / (F.lit(width) * F.pow(F.lit(8.0), F.col("__level")))))
    on = F.expr("p.chrom = s.seg_chrom AND p.__level = s.__level AND p.__b = s.__b AND p.pos BETWEEN s.seg_start AND s.seg_end")
    kept = [f"p.`{c}`" for c in points.columns] + [f"s.`{c}`" for c in segs.columns if c != "seg_chrom"]
    return p.alias("p").join(bins.alias("s"), on).select(*kept)


def in_order(segs: DataFrame) -> DataFrame:
    """Segments whose ends were swapped are turned round."""
    return segs.withColumns({"seg_start": F.least("seg_start", "seg_end"), "seg_end": F.greatest("seg_start", "seg_end")})


def compare_lists(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of each value in two lists, 0 where it is absent."""
    a, b = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((left, "n_left"), (right, "n_right")))
    return a.join(b, key, "full").na.fill(0, ["n_left", "n_right"])


def suspect_loci(variants: DataFrame, segs: DataFrame, how: str) -> DataFrame:
    """variants with loh_patho 0/1: whether the segment that ``how`` picks for a locus (Dialect.cnv) is a loss (seg_loh = 1)."""
    if how == "never":
        return variants.withColumn("loh_patho", F.lit(0))
    loci = variants.select("chrom", "pos").distinct()
    if how == "as_of":
        near = as_of_segment(loci, in_order(segs)).where("hit = 1").join(segs.select("seg_id", "seg_loh"), "seg_id").select("chrom", "pos", F.col("seg_loh").alias("loh_patho"))
    else:
        near = containing_segments(loci, segs).groupBy("chrom", "pos").agg(F.min_by("seg_loh", "seg_id").alias("loh_patho"))
    return variants.join(near.where("loh_patho = 1"), ["chrom", "pos"], "left").withColumn("loh_patho", F.coalesce("loh_patho", F.lit(0)))


def full_outer_annotate(calls: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on null-safe keys, where annotations give only the columns that calls lack (and keys of rows that calls lack)."""
    new = [c for c in annotations.columns if c in keys or c not in calls.columns]
    return full_outer(calls, annotations.select(*new), keys)


def group_max(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Each row with the greatest ``col`` of its group, by an aggregate that is joined back. The aggregate is summed map-side; Spark splits a
    large group's rows in the join only where both sides are shuffled, so write ``df`` as a table first if one group may be very large."""
    top = df.groupBy(*keys).agg(F.max(col).alias(out))
    left, right = df.alias("l"), top.alias("r")
    on = reduce(and_, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    return left.join(right, on).select("l.*", f"r.{out}")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails when a key stands twice on a side."""
    def once(df: DataFrame, side: str) -> DataFrame:
        n = df.groupBy(key).agg(F.count("*").alias("__n"))
        bad = F.assert_true(F.col("__n") == 1, F.concat(F.lit(f"{key} repeats on the {side}: "), F.col(key).cast("string")))
        return df.join(n.withColumn("__ok", bad).where("__ok is null").select(key), key)

    return once(left, "left").join(once(right, "right"), key)


def homozygous_runs(points: DataFrame, runs: DataFrame, limits: tuple[float, float | None] | None, pick: str = "any") -> DataFrame:
    """points(chrom, pos, ...) with in_roh and high 0/1: whether a run (seg_chrom, seg_start, seg_end, phom, phet) contains the place,
    and such a run has at least limits[0] homozygous and at most limits[1] heterozygous sites. None: both are 0.

    pick "any": any run around the place. "as_of": only the run with the greatest start up to the place (then the greatest
    end, then a high one), as one list per chromosome is searched; earlier runs that go on don't count. Ends may be swapped there.
    """
    if limits is None:
        return points.withColumns({"in_roh": F.lit(0), "high": F.lit(0)})
    high = (F.col("phom") >= limits[0]) & (F.col("phet") <= limits[1] if limits[1] is not None else F.lit(True))
    runs = runs.withColumn("seg_id", F.coalesce(high, F.lit(False)).cast("int"))
    loci = points.select("chrom", "pos").distinct()
    if pick == "as_of":
        whole = in_order(runs.where("seg_chrom is not null and seg_start is not null and seg_end is not null"))
        hits = as_of_segment(loci.where("chrom is not null and pos is not null"), whole.select("seg_chrom", "seg_start", "seg_end", "seg_id")).where("hit = 1")
        hits = hits.select("chrom", "pos", F.lit(1).alias("in_roh"), F.col("seg_id").alias("high"))
    else:
        hits = containing_segments(loci, runs).groupBy("chrom", "pos").agg(F.lit(1).alias("in_roh"), F.max("seg_id").alias("high"))
    return points.join(hits, ["chrom", "pos"], "left").na.fill(0, ["in_roh", "high"])
