"""Feature encoders that are fitted once, saved as JSON, and applied to unseen rows without a refit."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import number
from ..sources.sinks import json_file
from .features import vocabulary
from .ordered import exact_quantiles, value_counts


@dataclass
class FeatureEncoder:
    """Numeric columns (median for missing, then z-scores), categories (a 0/1 column per known value, rare and unknown ones in OTHER) and
    term lists (a 0/1 column per known term).

    ``fit`` reads the training rows alone; ``transform`` uses what was learnt and never looks at the whole of its table. An
    absent column is all missing. The learnt values are a few per column and are kept in the object.
    """

    numeric: list[str] = field(default_factory=list)
    categories: dict[str, int] = field(default_factory=dict)
    terms: dict[str, int] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)
    known: dict[str, list[str]] = field(default_factory=dict)
    rows: int = 0

    def fit(self, df: DataFrame) -> FeatureEncoder:
        """Learn medians, means and scales (of the filled columns), the most frequent values and the most frequent terms (ties by name)."""
        here = [c for c in self.numeric if c in df.columns]
        numbers = df.select(*(number(F.col(f"`{c}`")).alias(c) for c in here))
        self.rows = df.count()
        found = {r["name"]: r["m"] for r in exact_quantiles(value_counts(numbers, here), {"m": 0.5}).collect()} if here else {}
        self.medians = {c: float(found.get(c) or 0.0) for c in self.numeric}
        filled = {c: F.coalesce(F.col(f"`{c}`"), F.lit(self.medians[c])) for c in here}
        row = numbers.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(filled.values())), *(F.stddev_samp(x).alias(f"s{i}") for i, x in enumerate(filled.values()))).first() if here else None
        self.means = {c: float(row[f"m{here.index(c)}"] or 0.0) if c in here and row else 0.0 for c in self.numeric}
        scale = {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(here)} if row else {}
        self.scales = {c: scale[c] if scale.get(c, 0.0) >= 1e-8 else 1.0 for c in self.numeric}
        self.values = {c: vocabulary(df, c, most) if c in df.columns else [] for c, most in self.categories.items()}
        self.known = {}
        for c, most in self.terms.items():
            seen = df.select(F.explode(F.array_distinct(F.col(f"`{c}`"))).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n")) if c in df.columns else None
            self.known[c] = [r["t"] for r in seen.orderBy(F.desc("n"), "t").limit(most).collect()] if seen is not None else []
        return self

    def names(self) -> list[str]:
        """The columns that transform() makes, in order."""
        hot = [f"{c}_{v}" for c, values in self.values.items() for v in [*values, "OTHER"]]
        return [*self.numeric, *hot, *(f"{c}_has_{t}" for c, ts in self.known.items() for t in ts)]

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """``keep`` and the features as doubles. ValueError where a kept column has a feature's name."""
        made = {}
        for c in self.numeric:
            x = number(F.col(f"`{c}`")) if c in df.columns else F.lit(None).cast("double")
            made[c] = (F.coalesce(x, F.lit(self.medians[c])) - F.lit(self.means[c])) / F.lit(self.scales[c])
        for c, values in self.values.items():
            v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) if c in df.columns else F.lit("NA")
            made |= {f"{c}_{x}": (v == x).cast("double") for x in values}
            made[f"{c}_OTHER"] = (~v.isin(*values)).cast("double") if values else F.lit(1.0)
        for c, known in self.known.items():
            have = F.col(f"`{c}`") if c in df.columns else F.array().cast("array<string>")
            made |= {f"{c}_has_{t}": F.coalesce(F.array_contains(have, t), F.lit(False)).cast("double") for t in known}
        if clash := sorted(set(keep) & set(made)):
            raise ValueError(f"columns are kept and made: {clash}")
        return df.select(*(F.col(f"`{c}`") for c in keep), *(x.alias(n) for n, x in made.items()))

    def save(self, spark: SparkSession, path: str) -> None:
        json_file(spark, path, asdict(self))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureEncoder:
        return cls(**json_file(spark, path))
