"""Queries of sources, indexes and fitted objects: array files by row, many variant files in one scan, an inverted file of vectors,
interval bins, similar sets, mergeable profiles, saved encoders."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .operators import joins as J, neighbours as N, ordered as O, profiles as P, setjoin as S
from .operators.fitted import FeatureEncoder
from .plans import ledger
from .plans.views import segments, table, variants
from .queries import WITH_V, query
from .sources import arrays, fasta_index, vcf
from .sources.shared import shared_folder


@query("array_rows", """SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, len(embedding) AS dim, CAST(embedding[1] AS DOUBLE) AS x0,
 round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2 FROM embeddings""")  # fmt: skip
def _(spark, d):
    """Vectors go to an array file by place and come back by place, joined to their ids."""
    placed = O.places(table(spark, d, "embeddings").select("vec_id", "embedding"), [], "vec_id").withColumn("place", F.col("place") - 1)
    path = shared_folder(spark, "array-rows")
    arrays.write_arrays(placed, "place", "embedding", path)
    back = arrays.read_arrays(spark, path)
    out = placed.select("vec_id", "place").join(back, F.col("place") == F.col("row"))
    x = F.col("vector")
    norm = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    return out.select("vec_id", "place", F.size(x).cast("long").alias("dim"), F.get(x, 0).cast("double").alias("x0"), F.round(norm, 6).alias("norm2"))


@query("ivf_neighbours")
def _(spark, d):
    return N.neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


@query("vcf_scan", f"""{WITH_V} SELECT family_id, replace(chrom, 'chr', '') AS chrom, consequence, count(*) AS n, CAST(sum(dp) AS BIGINT) AS dp, min(gene_name) AS first_gene, count(DISTINCT patient_id) AS patients
 FROM variants GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    """The variants as a VCF file per family and chromosome, whose ANN fields have two orders, read back in one scan."""
    v = variants(spark, d).withColumn("key", F.concat_ws("_", "family_id", "chrom"))
    odd = F.pmod(F.xxhash64("key"), F.lit(2)) == 1
    ann = F.when(odd, F.concat_ws("|", "alt", "gene_name", "consequence")).otherwise(F.concat_ws("|", "alt", "consequence", "gene_name"))
    line = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", F.lit("50"), F.lit("PASS"), F.concat(F.lit("DP="), F.col("dp").cast("string"), F.lit(";P="), "patient_id", F.lit(";ANN="), ann), F.lit("GT"), F.lit("0/1"))
    rows = v.select("key", F.lit(3).alias("at"), line.alias("value"))
    fields = F.when(odd, F.lit("Allele | SYMBOL | Consequence")).otherwise(F.lit("Allele | Consequence | SYMBOL"))
    head = [F.lit("##INFO=<ID=DP,Number=1>"), F.lit("##INFO=<ID=P,Number=1>"), F.concat(F.lit("##INFO=<ID=ANN,Description=\"Functional annotations: '"), fields, F.lit("'\">")), F.lit("##FORMAT=<ID=GT,Number=1>"), F.lit("#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1"]))]
    top = v.select("key").distinct().select("key", F.posexplode(F.array(*head)).alias("at", "value")).withColumn("at", F.col("at") - 10)
    path = shared_folder(spark, "vcf-scan")
    both = rows.unionByName(top).repartition("key").sortWithinPartitions("key", "at")
    both.select("key", "value").write.mode("overwrite").partitionBy("key").text(path)
    out = vcf.flatten_many(spark, path, ["Consequence", "SYMBOL"], ["DP", "P"], ["GT"])
    family = F.regexp_extract("file", "key=([^/_]*)_", 1)
    return out.groupBy(family.alias("family_id"), F.col("CHROM").alias("chrom"), F.col("ann_Consequence").alias("consequence")).agg(
        F.count("*").alias("n"), F.sum(F.col("info_DP").try_cast("double")).cast("long").alias("dp"), F.min("ann_SYMBOL").alias("first_gene"), F.count_distinct("info_P").alias("patients"))


@query("interval_depth", f"""{WITH_V}, p AS (SELECT chrom, pos, count(*) AS n FROM variants GROUP BY ALL), long AS (SELECT * FROM segments UNION ALL
 SELECT seg_chrom, 0, 250000000, seg_loh, seg_id + 1000000 FROM (SELECT *, row_number() OVER (PARTITION BY seg_chrom ORDER BY seg_id) AS r FROM segments) WHERE r = 1)
 SELECT seg_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS depth, count(pos) AS loci FROM long LEFT JOIN p ON chrom = seg_chrom AND pos BETWEEN seg_start AND seg_end GROUP BY seg_id""")  # fmt: skip
def _(spark, d):
    """Rows and loci under each segment, whole chromosomes among them, by the interval index."""
    s = segments(spark, d)
    first = s.withColumn("r", F.row_number().over(Window.partitionBy("seg_chrom").orderBy("seg_id"))).where("r = 1").drop("r")
    whole = first.withColumns({"seg_start": F.lit(0).cast("long"), "seg_end": F.lit(250_000_000).cast("long"), "seg_id": F.col("seg_id") + 1_000_000})
    every = s.unionByName(whole)
    p = variants(spark, d).groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    under = J.containing_segments(p, every).groupBy("seg_id").agg(F.sum("n").alias("depth"), F.count("*").alias("loci"))
    return every.select("seg_id").join(under, "seg_id", "left").na.fill(0, ["depth", "loci"])


DAYS = "SELECT CAST(ts AS DATE) AS day, value, event_type, CASE WHEN user_id % 7 > 0 THEN user_id END AS user_id FROM events"
PROFILED = {"value": ("value", "CAST(value AS DOUBLE)"), "user_id": ("user_id", "CAST(user_id AS DOUBLE)"), "event_type": ("event_type", "CAST(NULL AS DOUBLE)")}


@query("profile_by_day", f"WITH d AS ({DAYS}) " + " UNION ALL ".join(
    f"SELECT '{n}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({x}), 6) AS mean, min({x}) AS low, max({x}) AS top FROM d" for n, (c, x) in PROFILED.items()))
def _(spark, d):
    """Sketches of each day, written as a table and merged to the whole: the exact part of the profile."""
    day = table(spark, d, "events").select(F.to_date("ts").alias("day"), "value", "event_type", F.when(F.col("user_id") % 7 > 0, F.col("user_id")).alias("user_id"))
    path = shared_folder(spark, "profiles") + "/days"
    P.profile_sketches(day, ["day"], ["value", "user_id"], ["event_type"]).write.parquet(path)
    merged = P.read_profiles(P.merge_profiles(spark.read.parquet(path)), {})
    return merged.select("name", "n", "missing", F.round(F.when(F.col("low").isNotNull(), F.col("mean")), 6).alias("mean"), "low", "top")


@query("encoded_unseen", f"""{WITH_V}, r AS (SELECT family_id, ord_key, ord_line, dp, pop_af, consequence FROM variants), f AS (SELECT * FROM r WHERE family_id <> 'F4'),
 m AS (SELECT median(pop_af) AS med FROM f), s AS (SELECT avg(dp) AS dm, stddev_samp(dp) AS ds, avg(coalesce(pop_af, med)) AS pm, stddev_samp(coalesce(pop_af, med)) AS ps FROM f, m),
 v AS (SELECT consequence AS c, row_number() OVER (ORDER BY count(*) DESC, consequence) AS k FROM f GROUP BY 1)
 SELECT ord_key, ord_line, round((dp - dm) / ds, 6) + 0.0 AS dp, round((coalesce(pop_af, med) - pm) / ps, 6) + 0.0 AS pop_af, CAST(consequence IN (SELECT c FROM v WHERE k = 1) AS DOUBLE) AS most,
 CAST(consequence NOT IN (SELECT c FROM v WHERE k <= 3) AS DOUBLE) AS other FROM r, m, s WHERE family_id = 'F4'""")  # fmt: skip
def _(spark, d):
    """Fitted without family F4, saved, loaded and applied to F4."""
    v = variants(spark, d)
    path = shared_folder(spark, "encoder") + "/encoder.json"
    FeatureEncoder(["dp", "pop_af"], {"consequence": 3}).fit(v.where("family_id <> 'F4'")).save(spark, path)
    enc = FeatureEncoder.load(spark, path)
    out = enc.transform(v.where("family_id = 'F4'"), ["ord_key", "ord_line"])
    first = enc.values["consequence"][0]
    return out.select("ord_key", "ord_line", *((F.round(c, 6) + 0.0).alias(c) for c in ("dp", "pop_af")), F.col(f"`consequence_{first}`").alias("most"), F.col("consequence_OTHER").alias("other"))


@query("similar_term_sets", f"""{WITH_V}, t AS (SELECT pos, list_sort(list(DISTINCT consequence || '/' || origin)) AS terms FROM variants GROUP BY 1), s AS (SELECT min(pos) AS set_id, terms FROM t GROUP BY terms)
 SELECT a, b, round(o / (na + nb - o), 6) AS jaccard FROM (SELECT x.set_id AS a, y.set_id AS b, len(x.terms) AS na, len(y.terms) AS nb, len(list_intersect(x.terms, y.terms)) AS o FROM s x JOIN s y ON x.set_id < y.set_id)
 WHERE o / (na + nb - o) >= 0.5""")  # fmt: skip
def _(spark, d):
    """Loci by what is seen at them: pairs of different sets with a Jaccard similarity of a half or more."""
    t = variants(spark, d).groupBy("pos").agg(F.collect_set(F.concat_ws("/", "consequence", "origin")).alias("terms"))
    _, sets = S.term_sets(t, "pos", F.col("terms"))
    return S.similar_sets(sets, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("fasta_windows", f"""{WITH_V}, p AS (SELECT DISTINCT chrom, pos, ref FROM variants), g AS (SELECT chrom, string_agg(ref || 'n' || lower(ref), '' ORDER BY pos) AS s FROM p GROUP BY 1),
 w AS (SELECT DISTINCT chrom, CAST(pos // 1000 % 250 AS BIGINT) AS start FROM p) SELECT replace(w.chrom, 'chr', '') AS contig, start, upper(substr(s, start + 1, 41)) AS seq FROM w JOIN g USING (chrom)""")  # fmt: skip
def _(spark, d):
    """The variants' reference letters as FASTA files with lines of 60 letters, and windows of 41 letters by byte offset."""
    p = variants(spark, d).select("chrom", "pos", "ref").distinct()
    seq = p.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: F.concat(x["ref"], F.lit("n"), F.lower(x["ref"]))), "").alias("s"))
    # a contig's head and lines come from one row: rows of a union needn't share a partition, even after a repartition that Spark takes for done
    line = lambda k: F.when(k < 0, F.concat(F.lit(">"), "chrom")).otherwise(F.substr("s", k * 60 + 1, F.lit(60)))
    lines = seq.select("chrom", F.posexplode(F.transform(F.sequence(F.lit(-1), F.floor((F.length("s") - 1) / 60).cast("int")), line)).alias("k", "value"))
    path = shared_folder(spark, "fasta") + "/genome"
    lines.repartition("chrom").sortWithinPartitions("chrom", "k").select("value").write.text(path)
    windows = p.select(F.col("chrom").alias("contig"), (F.floor(F.col("pos") / 1000) % 250).alias("start"), F.lit(41).alias("length")).distinct()
    return fasta_index.fasta_windows(windows, fasta_index.fasta_index(spark, path)).select("contig", "start", "seq")


@query("families_incremental", f"{WITH_V} SELECT family_id, count(*) AS n, count(DISTINCT patient_id) AS patients, round(max(vaf), 6) AS vaf FROM variants GROUP BY 1")
def _(spark, d):
    """Built without one patient first, then with all: only that patient's family is built again, and the table equals a whole run.
    The columns that the build reads are written once, as the ledger digests and builds from them in several passes."""
    rows = shared_folder(spark, "ledger-rows") + "/rows"
    variants(spark, d).select("family_id", "patient_id", "vaf").write.parquet(rows)
    v = spark.read.parquet(rows)
    one = lambda rows: rows.groupBy("family_id").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.round(F.max("vaf"), 6).alias("vaf"))
    path, first = shared_folder(spark, "ledger"), v.agg(F.min("patient_id")).first()[0]
    ledger.refresh(v.where(F.col("patient_id") != first), "family_id", one, path)
    return ledger.refresh(v, "family_id", one, path)[0].select("family_id", "n", "patients", "vaf")
