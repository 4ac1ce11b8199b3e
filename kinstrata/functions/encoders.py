"""Encoders of annotation columns to numbers, and choices of columns when a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.columns import PER_SAMPLE
from .scalars import na_if

# Numbers of impact, variant class, biotype, origin and loss.
IMPACT = {"HIGH": 4, "MODERATE": 3, "LOW": 2, "MODIFIER": 1}
VARIANT_CLASS = {"SNV": 1, "substitution": 1, "sequence_alteration": 1, "insertion": 2, "deletion": 2, "indel": 2}
BIOTYPE = {"protein_coding": 3, "processed_transcript": 2, "lncRNA": 2, "lncrna": 2, "miRNA": 2, "snRNA": 2, "snoRNA": 2, "rRNA": 2, "pseudogene": 1, "processed_pseudogene": 1}
ORIGIN = {"germline": 1, "somatic": 2, "both": 3, "germline+somatic": 3}
LOSS = {"loh": 2, "partial_loh": 1}


def mapped(c: Column, values: dict[str, int]) -> Column:
    """The number of a trimmed value, 0 for others and null."""
    out = F.lit(0)
    for name, number in values.items():
        out = F.when(F.trim(c.cast("string")) == name, number).otherwise(out)
    return out


def impact(c: Column) -> Column:
    return mapped(F.upper(c), IMPACT)


def variant_class(c: Column) -> Column:
    return mapped(c, VARIANT_CLASS)


def biotype(c: Column) -> Column:
    return mapped(c, BIOTYPE)


def canonical(c: Column) -> Column:
    return mapped(c, dict.fromkeys(("YES", "1", "true", "True"), 1))


def origin(c: Column) -> Column:
    return mapped(F.lower(c), ORIGIN)


def loss(c: Column) -> Column:
    return mapped(F.lower(c), LOSS)


def mentions(c: Column, *words: str) -> Column:
    """1 if the lower-cased text has any of the words."""
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False)).cast("int")


def polyphen(c: Column) -> Column:
    """2 probably, 1 possibly, 0 benign, else null."""
    t = F.lower(c)
    return F.when(t.contains("probably"), 2).when(t.contains("possibly"), 1).when(t.contains("benign"), 0).cast("double")


def pick(df: DataFrame, names: Iterable[str]) -> str | None:
    """The first of the names that df has."""
    return next((n for n in names if n in df.columns), None)


def picked(df: DataFrame, names: Iterable[str], encode, other: Column) -> Column:
    name = pick(df, names)
    return encode(F.col(f"`{name}`")) if name else other


def without_sample_columns(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if "." in c and c.rsplit(".", 1)[1] in PER_SAMPLE))


def family_list(c: Column) -> Column:
    """The families of a list cell parted by , | ; or blanks, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c.cast("string"), F.lit("")), r"[,|;\s]+"), lambda x: F.trim(x)), lambda x: na_if(x).isNotNull()))


def spaced(c: Column) -> Column:
    """Characters parted by blanks, as sequence tokenizers take them."""
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), " ")


def chosen_alleles(df: DataFrame, snv_only: bool = False) -> DataFrame:
    """ref_used and alt_used: allele_1 and allele_2 where df has both, else ref and alt. With snv_only single letters alone."""
    a, b = ("allele_1", "allele_2") if {"allele_1", "allele_2"} <= set(df.columns) else ("ref", "alt")
    out = df.withColumns({"ref_used": F.upper(F.trim(a)), "alt_used": F.upper(F.trim(b))})
    return out.where("length(ref_used) = 1 and length(alt_used) = 1") if snv_only else out


def global_lists(df: DataFrame) -> DataFrame:
    """FAMILY_ID_LIST_GLOBAL and PATIENT_ID_LIST_GLOBAL: kept, else from the list without _GLOBAL, else from the id, else empty."""
    made = {}
    for who in ("FAMILY", "PATIENT"):
        name = pick(df, (f"{who}_ID_LIST_GLOBAL", f"{who}_ID_LIST", f"{who}_ID"))
        made[f"{who}_ID_LIST_GLOBAL"] = F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")
    return df.withColumns(made)


def unified_depth(df: DataFrame, prefix: str = "", allele: int = 1) -> DataFrame:
    """dp_uni: DP, else <prefix>.DP. vaf_uni: VAF, else <prefix>.BAF, else the share of the ``allele``-th ALT in <prefix>.AD (or AD) of it and REF; null where that is 0 of 0."""
    from .scalars import number

    col = lambda *names: F.coalesce(*(number(F.col(f"`{n}`")) for n in names if n in df.columns), F.lit(None).cast("double"))
    ad = pick(df, (f"{prefix}.AD", "AD"))
    parts = F.split(F.col(f"`{ad}`"), ",") if ad else F.array().cast("array<string>")
    ref, alt = (number(F.try_element_at(parts, F.lit(i))) for i in (1, allele + 1))
    return df.withColumns({"dp_uni": col("DP", f"{prefix}.DP"), "vaf_uni": F.coalesce(col("VAF", f"{prefix}.BAF"), F.try_divide(alt, ref + alt))})
