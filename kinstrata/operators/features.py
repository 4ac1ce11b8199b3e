"""Encoders, imputation, scaling, profiles, splits and samples. Samples are by hashes of keys, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import encoders as C
from ..functions.scalars import number, predictor_score, severity
from ..plans.columns import BINARY, CATEGORICAL, KEYS, NOT_FEATURES, NUMERIC, PICKS
from .ordered import exact_quantiles, long_columns, value_counts


def top_or_other(df: DataFrame, col: str, k: int, out: str = "value") -> DataFrame:
    """The k most frequent values (ties by value) stay, the others become OTHER."""
    top = df.groupBy(col).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), col).limit(k).select(F.col(col).alias("__v"))
    return df.join(F.broadcast(top), F.col(col) == F.col("__v"), "left").withColumn(out, F.coalesce("__v", F.lit("OTHER"))).drop("__v")


SHARES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """A row per numeric column: n, missing, distinct, mean, std, low, quantiles, top. Quantiles are exact, from counts per value."""
    moments = long_columns(df, cols).groupBy("name").agg(
        F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("top"))
    out = moments.join(exact_quantiles(value_counts(df, cols), SHARES), "name", "left")
    return out.select("name", "n", "missing", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mean", "std", "low", *SHARES, "top")


def top_values(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """(name, value, n, rank): the k most frequent values of text columns, ties by value; nulls count as a value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols))
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("value"), F.lit(64))  # first inside 64 parts of a column's values, then among what is left
    first = counts.withColumn("__p", part).withColumn("__r", F.row_number().over(Window.partitionBy("name", "__p").orderBy(F.desc("n"), "value"))).where(F.col("__r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k).select("name", "value", "n", "rank")


def describe(df: DataFrame) -> DataFrame:
    """A row per column of any type: name, dtype, n, missing, n_distinct."""
    pairs = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"`{f.name}`").cast("string").alias("value")) for f in df.schema))
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.dtype", "p.value").agg(F.count("*").alias("k"))
    here = F.col("value").isNotNull()
    return counts.groupBy("name", "dtype").agg(F.coalesce(F.sum(F.when(here, F.col("k"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~here, F.col("k"))), F.lit(0)).alias("missing"), F.count("value").alias("n_distinct"))


def low_variance(df: DataFrame, fewer_than: int = 5) -> DataFrame:
    """(name, n_distinct) of the columns with fewer than so many values."""
    return describe(df).where(F.col("n_distinct") < fewer_than).select("name", "n_distinct")


def rates(df: DataFrame, **flags: Column) -> DataFrame:
    """One row: the share of rows where each flag holds; null flags count for none."""
    return df.agg(*(F.avg(c.cast("double")).alias(n) for n, c in flags.items()))


def weighted_means(df: DataFrame, by: list[str], values: list[str], weight: str) -> DataFrame:
    """Means of per-batch values, weighted by batch size, over all workers' rows."""
    return df.groupBy(*by).agg(*(F.try_divide(F.sum(F.col(v) * F.col(weight)), F.sum(F.when(F.col(v).isNotNull(), F.col(weight)))).alias(v) for v in values))


def uncorrelated(df: DataFrame, cols: list[str], most: float = 0.95) -> list[str]:
    """cols without those that correlate with an earlier kept one beyond ``most``; all pairs come from one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if not pairs:
        return list(cols)
    found = df.agg(*(F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    close = {p for p, c in zip(pairs, found, strict=True) if c is not None and abs(c) > most}
    kept: list[str] = []
    for c in cols:
        if not any((k, c) in close for k in kept):
            kept.append(c)
    return kept


def impute_median(df: DataFrame, *cols: str) -> DataFrame:
    """Nulls of the columns become their medians (0 if all are null)."""
    found = exact_quantiles(value_counts(df, list(cols)), {"m": 0.5}).groupBy().pivot("name", list(cols)).agg(F.first("m"))
    found = found.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"__{i}") for i, c in enumerate(cols)))
    out = df.join(F.broadcast(found))
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"__{i}")) for i, c in enumerate(cols)}).select(df.columns)


def fit_zscore(df: DataFrame, col: str) -> DataFrame:
    """One row (mean, std); a std of almost 0 is 1. Fit on training rows, use for all."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std")).select("mean", F.when(F.coalesce("std", F.lit(0.0)) < 1e-8, 1.0).otherwise(F.col("std")).alias("std"))


def apply_zscore(df: DataFrame, col: str, fitted: DataFrame, out: str) -> DataFrame:
    return df.join(F.broadcast(fitted)).withColumn(out, (F.coalesce(F.col(col), F.col("mean")) - F.col("mean")) / F.col("std")).drop("mean", "std")


def stratified(df: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """n distinct keys by hash, with each label's share of the keys (rounded; the smallest label takes what is left over), topped up by hash where a label has too few.

    A key counts once, with its least label; null keys are left out, and all keys stay if there are no more than n.
    """
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    keys = keys.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    sizes = keys.groupBy(label).agg(F.count("*").alias("k")).collect()
    total = sum(r["k"] for r in sizes)
    if total <= n:
        return keys.drop("__h")
    known = sorted((r for r in sizes if r[label] is not None), key=lambda r: r[label])
    counted, quota = sum(r["k"] for r in known), {}
    for r in known[1:]:
        quota[r[label]] = min(r["k"], round(n * r["k"] / counted))
    if known:
        quota[known[0][label]] = min(known[0]["k"], n - sum(quota.values()))
    first = None
    for value, most in quota.items():
        some = keys.where(F.col(label) == value).orderBy("__h", key).limit(most)
        first = some if first is None else first.unionByName(some)
    if first is None:
        return keys.orderBy("__h", key).limit(n).drop("__h")
    rest = keys.join(first.select(key), key, "left_anti").orderBy("__h", key).limit(n - sum(quota.values()))
    return first.unionByName(rest.select(first.columns)).drop("__h")


def held_out_families(df: DataFrame, families: Column, held: list[str] | None = None, pattern: str | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """split: test where any of a row's families is held out: those named, else those whose name has the pattern (ValueError if
    none has), else that share of all families, those with the least hashes (one at least).

    A row's split follows from its own families: by the pattern, or by the greatest hash that is held out, a single value
    found beforehand. So it doesn't depend on how rows are dealt or computed again. Rows without families are train.
    """
    if held is not None:
        hit = F.arrays_overlap(families, F.array(*map(F.lit, held)))
    elif pattern is not None:
        hit = F.exists(families, lambda f: f.rlike(pattern))
        if df.where(hit).isEmpty():
            raise ValueError(f"no family matches {pattern!r}")
    else:
        place = lambda f: F.struct(F.xxhash64(f, F.lit(seed)).alias("h"), f.alias("f"))
        every = df.select(F.explode(families).alias("f")).where("f is not null").distinct().select(place(F.col("f")).alias("p"))
        last = every.orderBy("p").limit(max(1, round((share or 0.0) * every.count()))).agg(F.max("p").alias("p")).first()["p"]
        if last is None:
            return df.withColumn("split", F.lit("train"))
        hit = F.exists(families, lambda f: place(f) <= F.struct(F.lit(last["h"]).cast("long").alias("h"), F.lit(last["f"]).alias("f")))
    return df.withColumn("split", F.when(hit, "test").otherwise("train"))


def worker_share(df: DataFrame, place: str, worker: int, workers: int) -> DataFrame:
    """The rows that one of several workers reads: places worker, worker + workers, and so on."""
    return df.where(F.pmod(F.col(place), F.lit(workers)) == worker)


def vocabulary(df: DataFrame, col: str, most: int | None = None) -> list[str]:
    """Values of a text column (null: NA), the most frequent first where ``most`` bounds them, else all in order. ValueError beyond
    10,000: each value becomes a column."""
    counts = df.groupBy(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("NA")).alias("v")).agg(F.count("*").alias("n"))
    rows = counts.orderBy("v").limit(10_001).collect() if most is None else counts.orderBy(F.desc("n"), "v").limit(most).collect()
    if len(rows) > 10_000:
        raise ValueError(f"{col} has over 10,000 values")
    return [r["v"] for r in rows]


def encoded(df: DataFrame) -> DataFrame:
    """Adds the derived columns of the numeric view: predictors, severities, origin and loss as numbers."""
    none = F.lit(None).cast("double")
    of = lambda what, encode, other=F.lit(0): C.picked(df, PICKS[what], encode, other)
    return df.withColumns({
        "SIFT_score": of("sift", predictor_score, none), "SIFT_bin": of("sift", lambda c: C.mentions(c, "deleterious")), "PolyPhen_ord": of("polyphen", C.polyphen, none), "PolyPhen_score": of("polyphen", predictor_score, none),
        "Consequence_num": of("consequence", severity), "Impact_num": of("impact", C.impact), "VariantClass_num": of("variant_class", C.variant_class), "Biotype_num": of("biotype", C.biotype),
        "Canonical_num": of("canonical", C.canonical), "Origin_num": of("origin", C.origin), "CNV_LOH_status_num": of("cnv_loh", C.loss),
    })


def numeric_view(df: DataFrame, values: dict[str, list[str]] | None = None) -> DataFrame:
    """Keys and labels that df has, all NUMERIC and BINARY columns (absent or no number: 0) and a 0/1 column per value of the
    CATEGORICAL ones; ``values`` fixes these (say, of the training rows), else they are all of df's."""
    df = encoded(df)
    present = [c for c in CATEGORICAL if c in df.columns]
    values = {c: vocabulary(df, c) for c in present} if values is None else values
    real = lambda c: F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    hot = [(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) == v).cast("int").alias(f"{c}_{v}") for c in present for v in values.get(c, ())]
    return df.select(*(f"`{c}`" for c in KEYS if c in df.columns), *(real(c).alias(c) for c in NUMERIC), *(real(c).cast("int").alias(c) for c in BINARY), *hot)


CONSEQUENCES = (
    "missense_variant", "stop_gained", "frameshift_variant", "splice_acceptor_variant", "splice_donor_variant", "splice_region_variant", "start_lost", "stop_lost", "inframe_insertion", "inframe_deletion",
    "protein_altering_variant", "synonymous_variant", "utr_variant", "intron_variant", "intergenic_variant", "regulatory_region_variant",
)
SMALL = {"IMPACT": ("IMPACT", 10), "VARIANT_CLASS": ("VC", 20), "BIOTYPE": ("BIOTYPE", 20)}


def feature_matrix(df: DataFrame, keys: list[str], numeric: list[str]) -> DataFrame:
    """keys and float features: numeric columns that df has, multi-hot consequences, small vocabularies (rare values: OTHER),
    canonical; nulls become the column's median."""
    df = C.without_sample_columns(df)
    present = [c for c in numeric if c in df.columns]
    made = {c: number(F.col(f"`{c}`")) for c in present}
    if "Consequence" in df.columns:
        made |= {f"CONS__{t}": F.coalesce(F.lower("Consequence").contains(t).cast("double"), F.lit(0.0)) for t in CONSEQUENCES}
    for c, (prefix, most) in SMALL.items():
        if c in df.columns:
            kept, v = vocabulary(df, c, most), F.coalesce(F.col(c).cast("string"), F.lit("NA"))
            made |= {f"{prefix}_{x}": (v == x).cast("double") for x in kept} | {f"{prefix}_OTHER": (~v.isin(*kept)).cast("double")}
    if "CANONICAL" in df.columns:
        made["CANONICAL__1"] = F.coalesce(F.upper(F.trim("CANONICAL")).isin("YES", "Y", "1", "TRUE").cast("double"), F.lit(0.0))
    out = df.select(*keys, *(v.alias(k) for k, v in made.items()))
    out = impute_median(out, *present) if present else out
    return out.select(*keys, *(F.col(f"`{c}`").cast("float").alias(c) for c in made))


def feature_columns(columns: list[str], label: str = "labels") -> list[str]:
    """Columns that are no key, no label and no statement of the label."""
    return [c for c in columns if c not in NOT_FEATURES and c != label]


def multi_hot(c: Column, terms: list[str]) -> dict[str, Column]:
    return {f"has_{t}": F.coalesce(F.lower(c).contains(t).cast("int"), F.lit(0)) for t in terms}


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows with the least hashes of their key: a seeded sample that repeats."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def classification_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1, weighted F1, from one count per label and prediction."""
    cells = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    both = cells.select("n", (F.col("l") == F.col("p")).alias("hit"), F.explode(F.array(F.struct(F.col("l").alias("c"), F.lit(1).alias("is_label")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_label")))).alias("x"))
    by = both.groupBy("x.c").agg(F.coalesce(F.sum(F.when(F.col("x.is_label") == 1, F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(F.col("x.is_label") == 0, F.col("n"))), F.lit(0)).alias("predicted"), F.coalesce(F.sum(F.when(F.col("hit") & (F.col("x.is_label") == 1), F.col("n"))), F.lit(0)).alias("tp"))
    zero = F.lit(0.0)
    by = by.withColumns({"precision": F.coalesce(F.try_divide("tp", "predicted"), zero), "recall": F.coalesce(F.try_divide("tp", "support"), zero), "f1": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero)})
    return by.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
