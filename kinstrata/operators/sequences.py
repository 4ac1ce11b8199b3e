"""Windows of a genome around variants, from overlapping chunks: each window lies in one chunk, so one equi-join finds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import reverse_complement


def chunks(contigs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(contig, contig_length, bin, bases) of contigs (contig, seq): ``size`` bases and the ``overlap`` after them."""
    some = contigs.where(F.length("seq") > 0).withColumn("contig_length", F.length("seq"))
    some = some.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("contig_length") - 1) / size))))
    return some.select("contig", "contig_length", "bin", F.substring("seq", F.col("bin") * size + 1, F.lit(size + overlap)).alias("bases"))


def _spliced(seq: Column, before: Column, ref: Column, alt: Column) -> Column:
    return F.concat(F.substring(seq, F.lit(1), before), alt, F.substring(seq, before + F.length(ref) + 1, F.length(seq)))


def centred_windows(variants: DataFrame, genome: DataFrame, size: int, width: int) -> DataFrame:
    """seq_ref and seq_alt of ``width`` bases around pos (1-based); null where the contig is too short on a side. A single base is
    put in unchecked; other alleles need the reference allele there, else seq_alt is null, and are cut or filled with N on the right."""
    half = width // 2
    v = variants.withColumn("__left", F.col("pos") - 1 - half).withColumn("bin", F.floor(F.col("__left") / size))
    v = v.join(genome, ["contig", "bin"], "left")
    inside = (F.col("__left") >= 0) & (F.col("__left") + width <= F.col("contig_length"))
    v = v.withColumn("seq_ref", F.when(inside, F.substring("bases", F.col("__left") - F.col("bin") * size + 1, F.lit(width))))
    alt = _spliced(F.col("seq_ref"), F.lit(half), F.col("ref"), F.col("alt"))
    single = (F.length("ref") == 1) & (F.length("alt") == 1)
    there = F.substring("seq_ref", F.lit(half + 1), F.length("ref")) == F.col("ref")
    return v.withColumn("seq_alt", F.when(single, alt).when(there, F.rpad(alt, width, "N"))).drop("__left", "bin", "bases", "contig_length")


def padded_windows(variants: DataFrame, genome: DataFrame, size: int, half: int, strand: Column | None = None) -> DataFrame:
    """seq_ref, seq_alt and ref_match for up to ``half`` bases on each side: windows are clamped to the contig, cut at the end and
    filled with N on both sides to 2 * half + 1; a strand of - gives reverse complements."""
    width = 2 * half + 1
    v = variants.withColumn("__left", F.greatest(F.col("pos") - 1 - half, F.lit(0))).withColumn("bin", F.floor(F.col("__left") / size))
    v = v.join(genome, ["contig", "bin"], "left")
    take = F.least(F.col("pos") + half, F.col("contig_length")) - F.col("__left")
    v = v.withColumn("__w", F.substring("bases", F.col("__left") - F.col("bin") * size + 1, take)).withColumn("__at", F.col("pos") - 1 - F.col("__left"))
    v = v.withColumn("ref_match", F.coalesce(F.substring("__w", F.col("__at") + 1, F.length("ref")) == F.col("ref"), F.lit(False)))

    def fixed(s: Column) -> Column:
        cut = F.substring(s, 1, width)
        out = F.rpad(F.concat(F.repeat(F.lit("N"), F.floor((width - F.length(cut)) / 2).cast("int")), cut), width, "N")
        return out if strand is None else F.when(strand == "-", reverse_complement(out)).otherwise(out)

    changed = F.when(F.col("ref_match"), _spliced(F.col("__w"), F.col("__at"), F.col("ref"), F.col("alt"))).otherwise(F.col("__w"))
    return v.withColumns({"seq_ref": fixed(F.col("__w")), "seq_alt": fixed(changed)}).drop("__left", "bin", "bases", "contig_length", "__w", "__at")


def problems(seq: Column, most: int = 512) -> Column:
    """What is wrong with a sequence: missing, empty, too long, spaces, alphabet; else null."""
    return F.when(seq.isNull(), "missing").when(seq == "", "empty").when(F.length(seq) > most, "too long").when(seq.rlike(r"\s"), "spaces").when(~seq.rlike("^[ACGTN]+$"), "alphabet")
