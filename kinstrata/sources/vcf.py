"""VCF text as DataFrames: header, per-file ANN fields, records, and one row per ALT and annotation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.encoders import pick, unified_depth
from ..functions.scalars import acmg_class, allele, info_field, is_nonsynonymous, matches, max_ignoring_null, na_if, normalize_chrom, number
from ..plans.dialect import GENOME, Dialect

# Columns of classifications, transcripts, clinical significance and genes.
ACMG = ("Prediction_ACMG_tapes", "EXOME_Prediction_ACMG_tapes", "Prediction_ACMG", "EXOME_Prediction_ACMG", "Classification_ACMG", "EXOME_Classification_ACMG")
CLNSIG = ("clinvar_CLNSIG", "ClinVar_CLNSIG", "CLIN_SIG")
GENES = ("Gene_Name", "HGNC_Name", "SYMBOL", "Gene")
TRANSCRIPTS = ("TX", "Feature_RefSeq", "Transcript", "NM", "Feature")
ANN_FALLBACK = ("Allele", "Consequence", "IMPACT", "SYMBOL", "Gene", "Feature_type", "Feature", "BIOTYPE")


def header(spark: SparkSession, path: str) -> dict:
    """INFO and FORMAT ids, column names, and the fields of ANN entries, of one file. ValueError without a #CHROM line."""
    lines = [r[0] for r in spark.read.text(path).where("value like '#%'").collect()]
    columns = next((x[1:].split("\t") for x in lines if x.startswith("#CHROM")), None)
    if columns is None:
        raise ValueError(f"{path}: no #CHROM line")

    def ids(kind: str) -> list[str]:
        return [x.split("ID=", 1)[1].split(",", 1)[0].rstrip(">") for x in lines if x.startswith(f"##{kind}=<ID=")]

    ann = next((x for x in lines if x.startswith("##INFO=<ID=ANN")), "")
    quoted = ann.split("'")[1] if ann.count("'") >= 2 else ann.partition("Format: ")[2].rstrip('">')
    fields = [f.strip().replace(" ", "") for f in quoted.split("|") if f.strip()]
    return {"info": ids("INFO"), "format": ids("FORMAT"), "columns": columns, "ann": fields or list(ANN_FALLBACK)}


def records(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, pos a long, chrom normalised, alt_raw the ALT list."""
    columns = header(spark, path)["columns"]
    parts = F.split("value", "\t")
    df = spark.read.text(path).where("value not like '#%' and value <> ''").select(*(F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(columns)))
    return df.withColumns({"CHROM": normalize_chrom(F.col("CHROM")), "POS": number(F.col("POS")).cast("long"), "alt_raw": F.col("ALT")})


def flatten(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, ALT (alt_index from 1) and ANN entry of that allele (one row without ANN if none), with INFO and first-sample fields."""
    h = header(spark, path)
    df = records(spark, path)
    if len(h["columns"]) > 9:
        sample = h["columns"][9]
        values = F.map_from_entries(F.arrays_zip(F.split("FORMAT", ":").alias("k"), F.slice(F.concat(F.split(F.col(f"`{sample}`"), ":"), F.array_repeat(F.lit(None).cast("string"), F.size(F.split("FORMAT", ":")))), F.lit(1), F.size(F.split("FORMAT", ":"))).alias("v")))
        df = df.withColumn("__f", values).withColumns({f"sample_{k}": F.col("__f")[k] for k in h["format"]}).drop("__f")
        if "GT" in h["format"]:
            df = df.withColumns({f"allele_{i}": allele(F.col("sample_GT"), i, F.col("REF"), F.col("alt_raw")) for i in (1, 2)})
    df = df.withColumns({f"info_{k}": info_field(F.col("INFO"), k) for k in h["info"] if k != "ANN"})
    df = df.drop("ALT").select("*", F.posexplode(F.split("alt_raw", ",")).alias("alt_index", "alt")).withColumn("alt_index", F.col("alt_index") + 1)
    entries = F.transform(F.split(F.coalesce(info_field(F.col("INFO"), "ANN"), F.lit("")), ","), lambda e: F.split(e, r"\|"))
    mine = F.filter(entries, lambda e: F.try_element_at(e, F.lit(1)) == F.col("alt"))
    df = df.withColumn("__a", mine).select("*", F.explode_outer("__a").alias("__e"))
    return df.withColumns({f"ann_{f}": F.try_element_at("__e", F.lit(i + 1)) for i, f in enumerate(h["ann"])}).drop("__a", "__e", "INFO", "FILTER")


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """(family, patient, kind, run, role, path) of the nested manifest JSON."""
    rows = []
    for family, patients in json.loads(text).items():
        for patient, files in patients.items():
            rows += [(family, patient, "germline", 0, role, path) for role, path in (files.get("germline_files") or {}).items()]
            rows += [(family, patient, "somatic", i, role, path) for i, run in enumerate(files.get("somatic_runs") or []) for role, path in run.items()]
    return spark.createDataFrame(rows, "family string, patient string, kind string, run int, role string, path string")


def typed(spark: SparkSession, path: str) -> DataFrame:
    """A row per record and ALT of a file with exactly one sample (else ValueError): CHROM, POS, REF, ALT, QUAL (double), FILTER
    (missing: PASS), GT, allele_1, allele_2, DP, VAF (that ALT's share of REF and it in AD; null where both are 0) and AF (of that ALT in INFO)."""
    columns = header(spark, path)["columns"]
    if len(columns) != 10:
        raise ValueError(f"{path} has {max(0, len(columns) - 9)} samples, not one")
    names, values = F.split("FORMAT", ":"), F.split(F.col(f"`{columns[9]}`"), ":")
    of = lambda k: F.try_element_at(values, F.nullif(F.array_position(names, k), F.lit(0)).cast("int"))
    df = records(spark, path).withColumns({"__gt": of("GT"), "__dp": of("DP"), "__ad": F.split(of("AD"), ","), "__af": F.split(info_field(F.col("INFO"), "AF"), ",")})
    df = df.select("*", F.posexplode(F.split("alt_raw", ",")).alias("__k", "__alt"))
    part = lambda c, i: number(F.try_element_at(c, i))
    ref, alt = part("__ad", F.lit(1)), part("__ad", F.col("__k") + 2)
    missing = F.col("FILTER").isNull() | F.col("FILTER").isin("", ".")
    return df.select(
        "CHROM", "POS", "REF", F.col("__alt").alias("ALT"), number(F.col("QUAL")).alias("QUAL"), F.when(missing, "PASS").otherwise(F.col("FILTER")).alias("FILTER"), F.col("__gt").alias("GT"),
        *(allele(F.col("__gt"), i, F.col("REF"), F.col("alt_raw")).alias(f"allele_{i}") for i in (1, 2)), number(F.col("__dp")).cast("long").alias("DP"), F.try_divide(alt, ref + alt).alias("VAF"), part("__af", F.col("__k") + 1).alias("AF"))


def flatten_all(spark: SparkSession, files: list[str]) -> DataFrame:
    """flatten() of each file, which may name its ANN fields differently; columns that a file lacks are null."""
    out = None
    for path in files:
        one = flatten(spark, path).withColumn("file", F.lit(path))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def headers(lines: DataFrame) -> DataFrame:
    """(file, columns, ann_fields, info_ids, format_ids) of lines (file, value): a row per file, from an aggregate over all files' header lines.

    ``columns`` is null for a file without a #CHROM line; ``ann_fields`` are those that this file's own ANN line names, else the usual ones.
    """
    v = F.col("value")
    ids = lambda kind: F.collect_list(F.when(v.startswith(f"##{kind}=<ID="), F.regexp_extract(v, "ID=([^,>]*)", 1)))
    ann = F.max(F.when(v.startswith("##INFO=<ID=ANN"), v))
    h = lines.where("value like '#%'").groupBy("file").agg(F.max(F.when(v.startswith("#CHROM"), v)).alias("chrom"), ann.alias("a"), ids("INFO").alias("info_ids"), ids("FORMAT").alias("format_ids"))
    quoted = F.coalesce(F.nullif(F.regexp_extract("a", "'([^']*)'", 1), F.lit("")), F.regexp_replace(F.regexp_extract("a", "Format: (.*)", 1), '["> ]+$', ""), F.lit(""))
    fields = F.filter(F.transform(F.split(quoted, r"\|"), lambda f: F.replace(F.trim(f), F.lit(" "), F.lit(""))), lambda f: f != "")
    usual = F.array(*map(F.lit, ANN_FALLBACK))
    return h.select("file", F.split(F.substring("chrom", 2, 1 << 30), "\t").alias("columns"), F.when(F.size(fields) > 0, fields).otherwise(usual).alias("ann_fields"), "info_ids", "format_ids")


def flatten_many(spark: SparkSession, paths: str | list[str], ann: list[str] = ANN_FALLBACK, info: list[str] = (), sample: list[str] = ("GT", "AD", "DP")) -> DataFrame:
    """Rows as flatten() gives them, of any number of files in one scan: file, the fixed columns, alt_index and alt, info_<key>,
    sample_<key> of the first sample, allele_1 and allele_2, ann_<field>.

    Each file has its own header, so fields are found by name in a row of ``headers`` that is joined to the file's records; the
    plan's size depends on the fields asked for, not on the files. Fields that a file doesn't declare are null. A file with
    records but no #CHROM line fails the query when its rows are read. Spark picks the join by the headers' size.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    h = headers(lines)
    records = lines.where("value not like '#%' and value <> ''").join(h, "file", "left")
    known = F.when(F.col("columns").isNull(), F.raise_error(F.concat("file", F.lit(": no #CHROM line")))).otherwise(F.col("columns"))
    df = records.withColumns({"__c": known.cast("array<string>"), "__p": F.split("value", "\t")})
    at = lambda values, names, name: F.try_element_at(values, F.nullif(F.array_position(names, F.lit(name)), F.lit(0)).cast("int"))
    df = df.select("file", "ann_fields", "info_ids", "format_ids", "__p", *(at(F.col("__p"), F.col("__c"), c).alias(c) for c in ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "INFO", "FORMAT")))
    df = df.withColumnRenamed("ALT", "alt_raw").withColumns({"CHROM": normalize_chrom(F.col("CHROM")), "POS": number(F.col("POS")).cast("long")})
    declared = lambda kind, k, c: F.when(F.array_contains(kind, k), c).alias
    names, values = F.split("FORMAT", ":"), F.split(F.try_element_at("__p", F.lit(10)), ":")
    made = {f"info_{k}": declared("info_ids", k, info_field(F.col("INFO"), k))(f"info_{k}") for k in info}
    made |= {f"sample_{k}": declared("format_ids", k, at(values, names, k))(f"sample_{k}") for k in dict.fromkeys([*sample, "GT"])}
    df = df.withColumns(made)
    df = df.withColumns({f"allele_{i}": allele(F.col("sample_GT"), i, F.col("REF"), F.col("alt_raw")) for i in (1, 2)})
    df = df.select("*", F.posexplode(F.split("alt_raw", ",")).alias("__i", "alt")).withColumn("alt_index", F.col("__i") + 1)
    entries = F.transform(F.split(F.coalesce(info_field(F.col("INFO"), "ANN"), F.lit("")), ","), lambda e: F.split(e, r"\|"))
    df = df.withColumn("__m", F.filter(entries, lambda e: F.try_element_at(e, F.lit(1)) == F.col("alt"))).select("*", F.explode_outer("__m").alias("__e"))
    return df.select(
        "file", "CHROM", "POS", "ID", "REF", "QUAL", "FORMAT", "alt_raw", "alt_index", "alt", *made, "allele_1", "allele_2", *(at(F.col("__e"), F.col("ann_fields"), f).alias(f"ann_{f}") for f in ann),
    )


def base_table(df: DataFrame, prefix: str = "", d: Dialect = GENOME) -> DataFrame:
    """Raw columns in their settled form: CHROM normalised, missing tokens null, TX or NO_TX (of the first transcript column there is),
    gene and clnsig (the first column that has a value), dp_uni and vaf_uni, acmg, max_pop_af over the dialect's frequency
    columns, pathway flags by its patterns, nonsyn (without a Consequence column: as the dialect says)."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in ("CHROM", "REF", "ALT")]
    out = df.withColumns({c: na_if(F.col(f"`{c}`")) for c in texts} | {"CHROM": normalize_chrom(F.col("CHROM"))})
    out = unified_depth(out, prefix)
    freqs = [number(F.col(f"`{c}`")) for c in d.pop_af if c in out.columns]
    marks = [F.coalesce(*some) for names in d.pathway_texts if (some := [F.col(f"`{c}`") for c in names if c in out.columns])]
    acmg, tx, consequence = pick(out, ACMG), pick(out, TRANSCRIPTS), pick(out, d.consequence)
    first = lambda names: F.coalesce(*(F.col(f"`{c}`") for c in names if c in out.columns), F.lit(None).cast("string"))
    made = {"gene": first(GENES), "clnsig": first(CLNSIG), "TX": F.coalesce(F.col(f"`{tx}`").cast("string") if tx else F.lit(None), F.lit("NO_TX")), "acmg": acmg_class(F.col(acmg)) if acmg else F.lit(None).cast("int"), "max_pop_af": max_ignoring_null(*freqs) if freqs else F.lit(None).cast("double")}
    made["nonsyn"] = (is_nonsynonymous(F.col(f"`{consequence}`")) if consequence else F.lit(d.no_consequence_passes)).cast("int")
    return out.withColumns(made | {"pathway_hit": (matches(d.pathway, *marks) if marks else F.lit(False)).cast("int"), "dna_repair": (matches(d.repair, *marks) if marks else F.lit(False)).cast("int")})
