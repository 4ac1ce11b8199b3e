"""Collapses of rows to patients, families and all families, with deterministic aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from functools import reduce
from operator import or_

from ..functions.scalars import LITERATURE, acmg_class, is_nonsynonymous, is_positive, matches, na_if, normalize_chrom, number
from ..plans.dialect import Dialect, GENOME, MERGED

LOCUS = ["chrom", "pos", "ref", "alt", "tx"]


def first_by(c: Column, order: Column) -> Column:
    """The first value that isn't missing, by an explicit order."""
    return F.min_by(na_if(c), F.when(na_if(c).isNotNull(), order))


def joined_set(c: Column, sep: str = "|") -> Column:
    return F.array_join(F.array_sort(F.collect_set(na_if(c))), sep)


def joined_tokens(c: Column, seps: str = r"[|,]", sep: str = ",") -> Column:
    """Sorted distinct tokens of list-like texts."""
    tokens = F.flatten(F.collect_set(F.split(na_if(c), seps)))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda x: x != ""))), sep)


def max_or_first(c: Column, order: Column) -> Column:
    """The greatest number if any value is one, else the first that isn't missing; as text."""
    return F.coalesce(F.max(number(c)).cast("string"), first_by(c, order))


def vote(c: Column, share: float = 0.8) -> Column:
    """The greatest number if ``share`` of the present values are numbers, else the joined set."""
    return F.when(F.count(number(c)) >= share * F.count(na_if(c)), F.max(number(c)).cast("string")).otherwise(joined_set(c))


def payload(df: DataFrame, taken: list[str], joined: list[str], order: Column) -> list[Column]:
    """An aggregate for each column that isn't taken: the joined set where it is named in ``joined``, else the greatest number or the first value."""
    return [(joined_set(F.col(c)) if c in joined else max_or_first(F.col(c).cast("string"), order)).alias(c) for c in df.columns if c not in taken]


def with_flags(v: DataFrame, d: Dialect = GENOME) -> DataFrame:
    """Row pass flags of a dialect: base gates, then depth and allele fraction by origin; or a suspect segment (loh_patho, where
    there is such a column) under a variant of class 4 or 5."""
    acmg = acmg_class(F.col("acmg_raw"))
    gate = lambda classes: F.coalesce(acmg.isin(*classes), F.lit(False))
    loh = F.coalesce(F.col("loh_patho"), F.lit(0)) if "loh_patho" in v.columns else F.lit(0)
    base = F.coalesce(F.col("pop_af") < d.af_max, F.lit(d.af_null_passes)) & is_nonsynonymous(F.col("consequence")) & gate(d.acmg_snv)
    germ = base & (F.col("origin") == "germline") & (F.col("dp") > 10) & (F.col("vaf") > 0.25)
    som = base & (F.col("origin") == "somatic") & (F.col("dp") > 20) & (F.col("vaf") > 0.05)
    cnv = (loh == 1) & gate((4, 5))
    return v.withColumns({
        "chrom": normalize_chrom(F.col("chrom")), "acmg": acmg, "loh_patho": loh, "germ_pass": germ.cast("int"), "som_pass": som.cast("int"), "cnv_pass": cnv.cast("int"), "row_pass": (germ | som | cnv).cast("int"),
        "pathway_hit": matches(d.pathway, F.col("pathway")).cast("int"), "dna_repair": matches(d.repair, F.col("pathway")).cast("int"),
    })


FLAGS = ("germ_pass", "som_pass", "cnv_pass", "row_pass", "loh_patho", "pathway_hit", "dna_repair")


def cancer_status(v: DataFrame) -> DataFrame:
    """A row per patient, few beside the loci: affected 0/1, whether any row is somatic."""
    return v.groupBy("family_id", "patient_id").agg(F.max((F.col("origin") == "somatic").cast("int")).alias("affected"))


def collapse_patients(flagged: DataFrame, d: Dialect = GENOME, keep: list[Column] = ()) -> DataFrame:
    """A row per family, patient and locus: presence by origin, greatest depth and fraction by origin, greatest class and flags, and
    ``keep`` (payload). affected 0/1: the patient's cancer status as the dialect counts it (Dialect.cancer); a dialect that counts the
    whole patient takes it from a column ``affected`` of the rows, where there is one, and else reads the rows once more for it."""
    g, s = F.col("origin") == "germline", F.col("origin") == "somatic"
    known = d.cancer == "patient" and "affected" in flagged.columns
    patients = flagged.groupBy("family_id", "patient_id", *LOCUS).agg(
        F.max(g.cast("int") if d.germ_rows else F.lit(0)).alias("has_germ"), F.max(s.cast("int")).alias("has_som"), F.max(F.when(g, F.col("dp"))).alias("dp_germ"), F.max(F.when(s, F.col("dp"))).alias("dp_som"),
        F.max(F.when(g, F.col("vaf"))).alias("vaf_germ"), F.max(F.when(s, F.col("vaf"))).alias("vaf_som"), F.max(F.when(g, F.col("acmg"))).alias("acmg_germ"), F.max("acmg").alias("acmg"),
        *(F.max(c).alias(c) for c in FLAGS), F.count("*").alias("n_rows"), *keep, *([F.coalesce(F.max("affected"), F.lit(0)).alias("affected")] if known else []),
    )
    if known:
        return patients
    if d.cancer == "row":
        return patients.withColumn("affected", F.col("has_som"))
    a, b = patients.alias("a"), cancer_status(flagged).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("family_id", "patient_id")]
    return a.join(b, same, "left").select("a.*", F.coalesce("b.affected", F.lit(0)).alias("affected"))


def patient_evidence(patients: DataFrame, d: Dialect = MERGED, genes: list[str] = (), drivers: list[str] = (), texts: list[str] = ()) -> DataFrame:
    """Adds predisposition (a germline class of the dialect in a gene that any of ``genes`` marks), driver (somatic, any of
    ``drivers``), two_hit (both origins, and a suspect segment or two of the three passes), literature (any of ``texts``) and
    evidence 0..5."""
    any_of = lambda cols: reduce(or_, (is_positive(F.col(c)) for c in cols)) if cols else F.lit(False)
    both = (F.col("has_germ") == 1) & (F.col("has_som") == 1)
    out = patients.withColumns({
        "predisposition": ((F.col("has_germ") == 1) & F.coalesce(F.col("acmg_germ").isin(*d.acmg_predisposition), F.lit(False)) & any_of(genes)).cast("int"),
        "driver": ((F.col("has_som") == 1) & any_of(drivers)).cast("int"),
        "two_hit": (both & ((F.col("loh_patho") == 1) | (F.col("germ_pass") + F.col("som_pass") + F.col("cnv_pass") >= 2))).cast("int"),
        "literature": (matches(LITERATURE, *(F.col(c) for c in texts)) if texts else F.lit(False)).cast("int"),
    })
    return out.withColumn("evidence", F.least(F.lit(5), F.col("predisposition") + 2 * F.col("driver") + 2 * F.col("two_hit") + F.col("literature")))


def segregation(n_pat: Column, n_cancer: Column, n_non: Column, overwrites: bool = False) -> Column:
    """4: two or more affected and no other carrier; 3: one; 2: any affected; 1: a single carrier; else 0. With ``overwrites``
    1 comes before 2, and 3 and 4 are never reached."""
    if overwrites:
        return F.when(n_pat == 1, 1).when(n_cancer >= 1, 2).otherwise(0)
    return F.when((n_cancer >= 2) & (n_non == 0), 4).when((n_cancer == 1) & (n_non == 0), 3).when(n_cancer >= 1, 2).when(n_pat == 1, 1).otherwise(0)


def collapse_families(patients: DataFrame, d: Dialect = GENOME, keep: list[Column] = ()) -> DataFrame:
    """A row per family and locus with carrier counts (affected ones by ``affected``), segregation, family evidence, integrated score, class and its reasons, and ``keep`` (payload)."""
    cancer = F.col("affected") == 1
    two_hit = F.col("two_hit") if "two_hit" in patients.columns else F.lit(0)
    out = patients.groupBy("family_id", *LOCUS).agg(
        F.count("*").alias("n_patients"), F.count_if(cancer).alias("n_cancer"), F.count_if(~cancer).alias("n_noncancer"), F.count_if((F.col("has_germ") == 1) & (F.col("has_som") == 0)).alias("n_germ_only"),
        F.count_if((F.col("has_germ") == 1) & (F.col("has_som") == 1)).alias("n_both"), F.array_join(F.array_sort(F.collect_set("patient_id")), ",").alias("patient_ids"),
        F.max("acmg_germ").alias("acmg_germ"), F.max(two_hit).alias("strict"), *(F.max(c).alias(c) for c in FLAGS), *keep,
    )
    passes = F.col("row_pass") == 1
    two = (F.col("n_patients") >= 2) & (passes if d.count_needs_pass else F.lit(True))
    out = out.withColumns({
        "label_of_interest": ((F.col("n_cancer") >= 1) & (F.col("n_noncancer") == 0) & passes).cast("int"), "count_ge_2": two.cast("int"),
        "segregation": segregation(F.col("n_patients"), F.col("n_cancer"), F.col("n_noncancer"), d.segregation_overwrites),
    })
    return score_points(integrated_inputs(out)) if d.score == "points" else score_sum(out)


def integrated_class(score: Column) -> Column:
    return F.when(score >= 9, "TOP").when(score >= 7, "HIGH").when(score >= 4, "MODERATE").otherwise("LOW")


def score_sum(families: DataFrame) -> DataFrame:
    """family_evidence 0..4 (one each for an affected carrier, both origins, a pass, repair), score, integrated_class, evidence."""
    out = families.withColumn("family_evidence", (F.col("n_cancer") >= 1).cast("int") + (F.col("n_both") >= 1).cast("int") + F.col("row_pass") + F.col("dna_repair"))
    out = out.withColumn("score", F.col("family_evidence") + F.col("segregation") + F.col("pathway_hit") + F.col("dna_repair"))
    reasons = F.concat_ws(
        "|", F.when(F.col("germ_pass") == 1, "GERM_SNV_PASS"), F.when(F.col("som_pass") == 1, "SOM_SNV_PASS"), F.when(F.col("cnv_pass") == 1, "CNV_PASS"), F.when(F.col("n_both") >= 1, "GERM_AND_SOM"),
        F.when(F.col("count_ge_2") == 1, "COUNT_GE_2"), F.when(F.col("segregation") > 0, F.concat(F.lit("SEG"), F.col("segregation").cast("string"))),
        F.when(F.col("family_evidence") > 0, F.concat(F.lit("FAM_EVD"), F.col("family_evidence").cast("string"))), F.when(F.col("pathway_hit") == 1, "PATHWAY_HIT"), F.when(F.col("dna_repair") == 1, "DNA_REPAIR"),
    )
    return out.withColumns({"integrated_class": integrated_class(F.col("score")), "evidence": reasons})


def integrated_inputs(families: DataFrame) -> DataFrame:
    """Adds what score_points reads and families lacks: germ_tier (class 5: 1, 4: 2), partial (a suspect segment), origin_profile."""
    made = {
        "germ_tier": F.when(F.col("acmg_germ") == 5, 1).when(F.col("acmg_germ") == 4, 2).otherwise(0), "partial": F.greatest("loh_patho", "cnv_pass"),
        "origin_profile": F.when(F.col("n_both") > 0, "both").when(F.col("n_germ_only") > 0, "germline-only").otherwise("somatic-only"),
    }
    return families.withColumns({n: c for n, c in made.items() if n not in families.columns})


def score_points(families: DataFrame) -> DataFrame:
    """Five-axis score 0..12: family_evidence 0..4 (2 at most where others carry the variant too), score, integrated_class, evidence."""
    b = lambda c: c.cast("int")
    partial = b((F.col("strict") == 0) & (F.col("partial") == 1))
    fam = F.when(F.col("n_cancer") >= 2, 2).when(F.col("n_cancer") == 1, 1).otherwise(0) + b(F.col("n_both") >= 1) + 2 * F.col("strict") + partial + F.col("row_pass")
    out = families.withColumn("family_evidence", F.least(fam, F.when(F.col("n_noncancer") > 0, 2).otherwise(4)))
    seg = F.when(F.col("segregation") >= 4, 3).when(F.col("segregation") == 3, 2).when(F.col("segregation") == 2, 1).otherwise(0)
    own = F.when(F.col("family_evidence") >= 4, 2).when(F.col("family_evidence") == 3, 1).otherwise(0)
    carriers = b((seg == 0) & (F.col("count_ge_2") == 1))
    tier = F.when(F.col("germ_tier") == 1, 2).when(F.col("germ_tier") == 2, 1).otherwise(0)
    origin = b(F.col("origin_profile") == "both")
    total = 2 * F.col("germ_pass") + tier + 3 * F.col("strict") + partial + seg + own + carriers + F.col("pathway_hit") + F.col("dna_repair") + origin
    plus = lambda name, c: F.when(c > 0, F.concat(F.lit(name), c.cast("string")))
    reasons = F.concat_ws(
        "|", F.when(F.col("germ_pass") == 1, "GERM_PASS"), plus("GERM_TIER+", tier), F.when(F.col("strict") == 1, "TWO_HIT_STRICT").when(F.col("partial") == 1, "TWO_HIT_EVIDENCE"), plus("SEG+", seg),
        plus("FAM_EVD+", own), F.when(carriers == 1, "COUNT_GE_2"), F.when(F.col("pathway_hit") == 1, "PATHWAY_HIT"), F.when(origin == 1, "ORIGIN_MOD+1"),
    )
    out = out.withColumn("score", F.least(total, F.lit(12)))
    return out.withColumns({"integrated_class": integrated_class(F.col("score")), "evidence": reasons})


def collapse_all(families: DataFrame, d: Dialect = GENOME) -> DataFrame:
    """A row per locus over all families; the dialect says whether carriers are summed or the greatest family counts."""
    f = F.sum if d.global_counts == "sum" else F.max
    return families.groupBy(*LOCUS).agg(
        F.count("*").alias("n_families"), F.array_join(F.array_sort(F.collect_set("family_id")), ",").alias("family_ids"), *(f(c).alias(c) for c in ("n_patients", "n_cancer", "n_noncancer")),
        F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("integrated_class")), ",").alias("classes"),
    )


def collapse_runs(rows: DataFrame, run: Column) -> DataFrame:
    """Somatic rows to runs, then to a row per patient and locus: repeats summed, runs counted, greatest depth and fraction."""
    one = rows.withColumn("run", run).groupBy("patient_id", *LOCUS, "run").agg(F.count("*").alias("n"), F.max("dp").alias("dp"), F.max("vaf").alias("vaf"))
    return one.groupBy("patient_id", *LOCUS).agg(F.sum("n").alias("repeats"), F.count("*").alias("n_runs"), F.max("dp").alias("dp_som"), F.max("vaf").alias("vaf_som"))
