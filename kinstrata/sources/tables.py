"""Delimited and whitespace tables, FASTA contigs, and sinks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import normalize_chrom, number


def delimited(spark: SparkSession, path: str, wanted: list[str] | None = None, sep: str = "\t") -> DataFrame:
    """All columns as strings; of ``wanted`` those that the file has (ValueError if it has none)."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    if wanted is None:
        return df
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError(f"{path} has none of the columns {wanted}")
    return df.select(*(F.col(f"`{c}`") for c in found))


def whitespace(spark: SparkSession, path: str) -> DataFrame:
    """A table whose fields are parted by runs of blanks; the first line of each file names them (all files have the same names).

    Line numbers of a file aren't known in Spark, so a header is a line equal to the first file's first one.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    first = lines.first()
    if first is None:
        return spark.createDataFrame([], "value string")
    names = first[0].split()
    parts = F.split("value", r"\s+")
    return lines.where(F.col("value") != first[0]).select(*(F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(names)))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def one_file(spark: SparkSession, folder: str, suffix: str) -> str | None:
    """The only file of a folder that ends in ``suffix``; None if there is none, ValueError if there are several."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*{suffix}")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    names = sorted(f.getPath().toString() for f in found if f.isFile())
    if len(names) > 1:
        raise ValueError(f"{folder} has several files *{suffix}: {names}")
    return names[0] if names else None


def first_file(spark: SparkSession, folders: list[str], suffix: str) -> str | None:
    """one_file of the first folder that has one."""
    return next((f for d in folders if (f := one_file(spark, d, suffix))), None)


def annotation_path(vcf: str, mark: str = "_Genetic_Variants", own: str = "_Exome_Genetic_Variants", suffix: str = ".txt") -> str:
    """The annotation table that belongs to a VCF file: its name with ``own`` for ``mark`` and another suffix. ValueError without the mark."""
    folder, _, name = vcf.rpartition("/")
    if mark not in name:
        raise ValueError(f"{vcf} has no {mark} in its name")
    stem = name.replace(mark, own, 1)
    for ending in (".vcf.gz", ".vcf"):
        stem = stem.removesuffix(ending)
    return (f"{folder}/" if folder else "") + stem + suffix


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """An annotation table with CHROM, POS, REF and ALT as strings of any of their usual spellings; REF and ALT may be absent.

    A file that isn't there gives an empty table; one whose first line has no tab is read as parted by blanks.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "CHROM string, POS long, REF string, ALT string")
    head = spark.read.text(path).where("trim(value) <> ''").first()
    df = delimited(spark, path) if head is None or "\t" in head[0] else whitespace(spark, path)
    names = {c.lstrip("#").lower(): c for c in reversed(df.columns)}
    spell = lambda *options: next((names[o] for o in options if o in names), None)
    chrom, pos = spell("chrom", "chr", "chromosome"), spell("pos", "position", "start")
    if chrom is None or pos is None:
        raise ValueError(f"{path} has no column of chromosomes or positions")
    ref, alt = spell("ref"), spell("alt")
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c else F.lit("")
    rest = [c for c in df.columns if c not in (chrom, pos, ref, alt)]
    return df.select(normalize_chrom(F.col(f"`{chrom}`")).alias("CHROM"), number(F.col(f"`{pos}`")).cast("long").alias("POS"), text(ref).alias("REF"), text(alt).alias("ALT"), *(f"`{c}`" for c in rest))


def sequence_rows(spark: SparkSession, path: str, key: str = "ROW_ID", sequences: tuple[str, ...] = ("REF_SEQ", "ALT_SEQ")) -> DataFrame:
    """(key, sequences) of a delimited table in upper case, keyed rows alone; ValueError if a column is absent."""
    df = delimited(spark, path)
    if lost := [c for c in (key, *sequences) if c not in df.columns]:
        raise ValueError(f"{path} lacks {lost}")
    return df.where(F.col(key).isNotNull()).select(key, *(F.upper(F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in sequences))


def segments(df: DataFrame, chrom: tuple[str, ...] = ("SV_chrom", "CHROM", "chr", "CHR"), start: str = "SV_start", end: str = "SV_end") -> DataFrame:
    """Copy-number or homozygosity rows with seg_chrom, seg_start and seg_end; other columns stay. Use POS1 and POS2 for the latter."""
    name = next(c for c in chrom if c in df.columns)
    return df.withColumns({"seg_chrom": normalize_chrom(F.col(name)), "seg_start": number(F.col(start)).cast("long"), "seg_end": number(F.col(end)).cast("long")})


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, line): the lines of each contig in upper case with the place (from 0) of their first letter.

    A line knows its file block and its order in there; which contig it belongs to and how many letters come before it are
    carried from block to block in a table of blocks, so neither a contig nor a file has to be in one task.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    heads = raw.withColumns({"head": F.when(F.col("value").startswith(">"), normalize_chrom(F.split(F.substring("value", 2, 1 << 20), r"\s+")[0])), "line": F.upper(F.regexp_replace("value", r"\s+", ""))})
    inside = Window.partitionBy("file", "block").orderBy("n")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("head").isNull(), F.length("line")).otherwise(0)
    rows = heads.withColumn("size", size).withColumns({"own": F.last("head", ignorenulls=True).over(upto), "turn": F.count("head").over(upto), "total": F.sum("size").over(upto)})
    turns = Window.partitionBy("file", "block", "turn").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(turns), F.lit(0)))
    # of each block: its last contig, and the letters after its last head
    last = rows.groupBy("file", "block", "turn").agg(F.sum("size").alias("letters"), F.first("own").alias("own"))
    ends = last.groupBy("file", "block").agg(F.max_by(F.struct("own", "letters"), "turn").alias("end"), F.max("turn").alias("turns"))
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"run": F.sum(F.when(F.col("turns") > 0, 1).otherwise(0)).over(order), "contig": F.last(F.col("end.own"), ignorenulls=True).over(earlier)})
    # letters of the carried contig in the blocks since its head
    ends = ends.withColumn("carried", F.sum("end.letters").over(Window.partitionBy("file", "run").orderBy("block")))
    ends = ends.withColumn("carried", F.coalesce(F.lag("carried").over(order), F.lit(0))).select("file", "block", "contig", "carried")
    out = rows.where("head is null and line <> ''").join(ends, ["file", "block"])
    return out.select(F.coalesce("own", "contig").alias("contig"), (F.col("before") + F.when(F.col("turn") == 0, F.col("carried")).otherwise(0)).alias("start"), "line").where("contig is not null")


def fasta_chunks(spark: SparkSession, path: str, size: int, overlap: int) -> DataFrame:
    """(contig, start, seq): pieces of a contig every ``size`` letters, each ``overlap`` letters longer than that where the contig goes on."""
    lines = fasta_lines(spark, path)
    n, at = F.length("line"), F.col("start")
    first = F.greatest(F.lit(0), F.floor((at - overlap) / size))
    dealt = lines.withColumn("k", F.explode(F.sequence(first.cast("long"), F.floor((at + n - 1) / size).cast("long"))))
    low = F.greatest(F.lit(0), F.col("k") * size - at)
    high = F.least(n.cast("long"), F.col("k") * size + size + overlap - at)
    part = dealt.withColumn("part", F.struct(F.greatest(at, F.col("k") * size).alias("at"), F.substr("line", (low + 1).cast("int"), (high - low).cast("int")).alias("s")))
    parts = part.where(high > low).groupBy("contig", "k").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.where(F.col("parts")[0]["at"] < (F.col("k") + 1) * size).select("contig", (F.col("k") * size).alias("start"), F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("seq"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, seq) without chr prefixes, in upper case; a contig is one row here (fasta_chunks keeps long ones in pieces)."""
    lines = fasta_lines(spark, path).groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("start", "line"))).alias("parts"))
    return lines.select("contig", F.array_join(F.transform("parts", lambda p: p["line"]), "").alias("seq"))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).csv(path, sep=sep, header=True)


def minimal_view(df: DataFrame, base: list[str], labels: list[str]) -> DataFrame:
    """Base columns (absent: empty text) and labels (absent or null: 0)."""
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in base), *((F.coalesce(F.col(c), F.lit(0)) if c in df.columns else F.lit(0)).alias(c) for c in labels))


#: Rows of a family or global table that are exported by themselves; classes of a global table are a list.
SUBSETS = {
    "row_pass": "row_pass = 1", "of_interest": "label_of_interest = 1", "count_ge_2": "count_ge_2 = 1",
    "top": "array_contains(split(integrated_class, ','), 'TOP')", "high_or_top": "arrays_overlap(split(integrated_class, ','), array('TOP', 'HIGH'))",
}


def export_subsets(families: DataFrame, path: str) -> None:
    """One folder per subset, parted by family."""
    for name, rows in SUBSETS.items():
        write_delimited(families.where(rows), f"{path}/{name}", by=("family_id",))


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; built and written first where there is none (a half-written one has no _SUCCESS file)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_key(inputs: dict) -> str:
    """md5 of the inputs as sorted JSON; a file's length and time of change count, if ``stamped`` put them in."""
    return hashlib.md5(json.dumps(inputs, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def stamped(spark: SparkSession, *paths: str) -> dict[str, list[int]]:
    """path -> [bytes, time of change] of each file that a path names."""
    out = {}
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
            out[f.getPath().toString()] = [f.getLen(), f.getModificationTime()]
    return out


def cached(spark: SparkSession, folder: str, inputs: dict, build: Callable[[], DataFrame], order: str | None = None, rows: int | None = None) -> DataFrame:
    """The table of these inputs under folder/<md5>, built once; with ``rows`` its first ones by ``order``, cut after reading."""
    df = reuse(spark, f"{folder.rstrip('/')}/{cache_key(inputs)}", build)
    return df.orderBy(order).limit(rows) if rows is not None and order else df
