"""Scalar rules as Column expressions: missing tokens, chromosomes, classifications, severities, genotypes, sequences, terms."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Spellings of a missing value.
NA_TOKENS = ("", ".", "nan", "None", "NA", "na", "N/A", "null", "NULL")

# Consequence terms that change the protein.
NONSYNONYMOUS = (
    "missense_variant", "stop_gained", "frameshift_variant", "splice_acceptor_variant", "splice_donor_variant", "start_lost", "stop_lost", "inframe_insertion", "inframe_deletion", "protein_altering_variant",
)

# Severity by consequence term; unknown terms are 1, none 0.
SEVERITY = {
    5: ("transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant", "stop_lost", "start_lost"),
    4: ("missense_variant", "inframe_insertion", "inframe_deletion", "protein_altering_variant"),
    3: ("splice_region_variant",),
    2: ("synonymous_variant", "stop_retained_variant", "start_retained_variant"),
}

# Text patterns.
LITERATURE = "(cancer|tumou?r|carcinoma|leukemia|lymphoma|sarcoma|melanoma)"
LOSS_CALL = r"\bloh\b|loss|deletion|del"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def na_if(c: Column, tokens=NA_TOKENS) -> Column:
    return F.when(~F.trim(c).isin(*tokens), c)


def number(c: Column) -> Column:
    """A double where the trimmed text is a plain number, else null (also for nan, inf and 5d)."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def coalesce_na(*cols: Column) -> Column:
    return F.coalesce(*(na_if(c) for c in cols))


def normalize_chrom(c: Column) -> Column:
    return F.trim(F.replace(F.replace(c, F.lit("chr"), F.lit("")), F.lit("CHR"), F.lit("")))


def chrom_rank(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(1, 22), n).when(c == "X", 23).when(c == "Y", 24).when(c.isin("M", "MT"), 25).otherwise(1000)


def acmg_class(raw: Column) -> Column:
    """0..5 from a classification's text; digits pass; "conflicting ... pathogenicity" counts as pathogenic."""
    t = F.lower(F.trim(na_if(raw)))
    return (
        F.when(t.rlike("^[0-9]+$"), t.try_cast("int")).when(t.contains("pathogenic") & ~t.contains("likely"), 5).when(t.contains("likely") & t.contains("pathog"), 4)
        .when(t.contains("uncertain") | t.contains("vus"), 3).when(t.contains("likely") & t.contains("benign"), 2).when(t.contains("benign"), 1).when(t.contains("non") & t.contains("class"), 0)
    )


def path5(raw: Column) -> Column:
    """1..5 alone: conflicting statements, class 0 and digits beyond 5 are null."""
    t = F.lower(F.trim(na_if(raw)))
    cls = acmg_class(raw)
    return F.when(~t.contains("conflicting") & cls.between(1, 5), cls)


def max_ignoring_null(*cols: Column) -> Column:
    """Row-wise maximum; NaN counts as null."""
    clean = [F.nanvl(c, F.lit(None).cast("double")) for c in cols]
    return F.greatest(*clean) if len(clean) > 1 else clean[0]


def is_nonsynonymous(c: Column) -> Column:
    t = F.lower(c)
    return F.coalesce(~t.contains("synonymous_variant") & reduce(or_, (t.contains(x) for x in NONSYNONYMOUS)), F.lit(False))


def matches(pattern: str, *cols: Column) -> Column:
    return F.lower(F.concat_ws(" | ", *(na_if(c) for c in cols))).rlike(pattern)


def is_positive(c: Column) -> Column:
    """No missing token and not zero as a number."""
    return F.coalesce(na_if(c.cast("string")).isNotNull() & F.coalesce(number(c) != 0, F.lit(True)), F.lit(False))


def any_positive(*cols: Column) -> Column:
    return reduce(or_, map(is_positive, cols))


def loh_class(maf: Column, cn: Column, log2: Column) -> Column:
    return (
        F.when(maf.isNull() | cn.isNull() | log2.isNull(), "Unknown").when((cn <= 1.2) & (maf < 0.05) & (log2 < -0.35), "Deletion_LOH").when(cn.between(1.7, 2.3) & (maf < 0.05) & (F.abs(log2) < 0.3), "CopyNeutral_LOH")
        .when((maf < 0.1) & (cn <= 2.3), "Possible_Subclonal_LOH").when(maf >= 0.1, "No_LOH").otherwise("Possible_LOH")
    )


def pathogenic_rank(c: Column) -> Column:
    """1 if a segment's ranking is a whole number of 3 or more."""
    t = F.trim(c.cast("string"))
    return F.coalesce(F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long") >= 3), F.lit(False)).cast("int")


def pathogenic_call(*cols: Column) -> Column:
    """1 if the text of a segment's call or type speaks of a loss."""
    return matches(LOSS_CALL, *cols).cast("int")


def suspect_loss(loh: Column, pathogenic: Column) -> Column:
    """1 for a pathogenic segment of a class that is or may be a loss."""
    return (loh.isin("Deletion_LOH", "CopyNeutral_LOH", "Possible_Subclonal_LOH", "Possible_LOH") & (pathogenic == 1)).cast("int")


def predictor_score(c: Column) -> Column:
    """The number in parentheses, else the whole as a number."""
    return F.coalesce(number(F.nullif(F.regexp_extract(c, r"\(([^()]+)\)", 1), F.lit(""))), number(c))


def severity(c: Column) -> Column:
    terms = F.filter(F.transform(F.split(F.coalesce(na_if(c), F.lit("")), r"[,&|]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")

    def rank(x: Column) -> Column:
        out = F.lit(1)
        for value, names in sorted(SEVERITY.items()):
            out = F.when(x.isin(*names), value).otherwise(out)
        return out

    return F.coalesce(F.array_max(F.transform(terms, rank)), F.lit(0))


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column, tx: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("bigint").cast("string"), ref, alt, F.coalesce(na_if(tx), F.lit("NO_TX")))


def info_field(info: Column, name: str) -> Column:
    """k=v of a ;-list: v (split at the first =), "True" for a bare flag, else null."""
    hit = F.try_element_at(F.filter(F.split(info, ";"), lambda x: (x == name) | x.startswith(name + "=")), F.lit(1))
    return F.when(hit == name, "True").otherwise(F.substr(hit, F.lit(len(name) + 2)))


def allele(gt: Column, which: int, ref: Column, alt: Column) -> Column:
    """Allele ``which`` (1 or 2) of a genotype a/b or a|b; null if it is missing, out of range or haploid."""
    parts = F.split(gt, r"[/|]")
    index = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(which)).try_cast("int"))
    return F.when(index >= 0, F.try_element_at(F.concat(F.array(ref), F.split(alt, ",")), index + 1))


def allele_fraction(vaf: Column, ad: Column) -> Column:
    """VAF, else alt/(ref+alt) of an AD pair."""
    parts = F.split(ad, ",")
    r, a = (number(F.try_element_at(parts, F.lit(i))) for i in (1, 2))
    return F.coalesce(vaf, F.try_divide(a, r + a))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANtgcan"))


def clean_sequence(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.regexp_replace(s, r"\s+", "")), "[^ACGTN]", "N")


def clean_any_sequence(s: Column) -> Column:
    """clean_sequence for any text: white space of all scripts goes, a null is empty, each other character past ACGTN is N."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)[\s\x1c-\x1f]+", "")), "[^ACGTN]", "N")


def split_terms(c: Column, most: int = 25) -> Column:
    """Trimmed distinct terms of a ;,| list in order, the first ``most``."""
    terms = F.transform(F.split(F.coalesce(na_if(c), F.lit("")), r"[;,|]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(terms, lambda x: ~x.isin(*NA_TOKENS))), 1, most)


def labelled_text(**cols: Column) -> Column:
    return F.concat_ws(" | ", *(F.when(na_if(c).isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in cols.items()))


def one_hot(c: Column, values: list[str]) -> dict[str, Column]:
    v = F.coalesce(na_if(c), F.lit("NA"))
    return {f"is_{x.lower()}": (v == x).cast("int") for x in values}


def unit_scale(c: Column, top: float) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(top)) / top
