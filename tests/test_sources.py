"""Array files, many variant files, the inverted file, interval bins, splits, cancer status and runs, against plain Python."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinstrata.operators import aggregates as A, features as E, joins as J, neighbours as N, vectors as V
from kinstrata.plans.dialect import EXOME, GENOME, MERGED
from kinstrata.sources import arrays, fasta_index, vcf

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["array_rows", "vcf_scan", "interval_depth", "fasta_windows", "mutation_features", "roh_flags_genome", "roh_flags_merged", "family_collapse_exome", "cnv_first_containment", "held_out_pattern"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    columns = sorted(c[0] for c in con.description)
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == columns
    at = [[c[0] for c in con.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in at)) for r in want) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


def test_array_files_round_trip_by_row(spark, tmp_path):
    n, dim = 100_000, 6
    rows = spark.range(n, numPartitions=7).select((F.lit(n - 1) - F.col("id")).alias("place"), F.array(*((F.col("id") * k % 1000 / 8).cast("float") for k in range(dim))).alias("v"))
    path = str(tmp_path / "parts")
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        arrays.write_arrays(rows, "place", "v", path, "float16")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    back = arrays.read_arrays(spark, path, partitionbytes=200_000)
    assert back.rdd.getNumPartitions() >= 6
    both = rows.join(back, F.col("place") == F.col("row"))
    assert both.count() == n and both.where("v <> vector").count() == 0  # eighths below 125 are half floats exactly
    x = np.arange(40, dtype=np.float32).reshape(10, 2, 2)
    np.save(tmp_path / "x.npy", x)
    got = arrays.read_arrays(spark, str(tmp_path / "x.npy"), partitionbytes=32).collect()
    assert [r.row for r in sorted(got)] == list(range(10)) and [r.vector for r in sorted(got)] == x.reshape(10, 4).tolist()
    x.astype("<f2").tofile(tmp_path / "x.raw")
    raw = arrays.read_arrays(spark, f"file://{tmp_path}/x.raw", dtype="float16", dim=4)
    assert raw.where("row = 3").first().vector == x.reshape(10, 4)[3].tolist()
    with pytest.raises(Exception, match="no multiple"):
        arrays.read_arrays(spark, str(tmp_path / "x.raw"), dtype="float16", dim=7).count()
    with pytest.raises(Exception, match="gap or a repeat|no positions"):
        arrays.write_arrays(rows.where("place <> 5"), "place", "v", str(tmp_path / "gap"))
    arrays.write_arrays(rows.where("place < 0"), "place", "v", str(tmp_path / "none"))
    assert arrays.read_arrays(spark, str(tmp_path / "none")).count() == 0


def _vcf(i, r):
    order = ["Allele", "Consequence", "SYMBOL"] if i % 2 else ["Allele", "SYMBOL", "Consequence"]
    lines = ["##fileformat=VCFv4.2", "##INFO=<ID=DP,Number=1,Type=Integer>", f"##INFO=<ID=ANN,Number=.,Description=\"Functional annotations: '{' | '.join(order)}'\">", "##FORMAT=<ID=GT,Number=1>"]
    lines += ["##FORMAT=<ID=DP,Number=1>"] if i % 3 else []
    lines.append("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts" + str(i))
    for k in range(r.randint(1, 4)):
        alts = r.choice(["C", "C,G"])
        ann = ",".join("|".join({"Allele": a, "Consequence": "missense", "SYMBOL": f"g{i}"}[f] for f in order) for a in r.choice([["C"], ["C", "G"], ["T"]]))
        lines.append(f"chr{i % 22 + 1}\t{k * 10 + i}\t.\tA\t{alts}\t5\tPASS\tDP={k};ANN={ann}\tGT:DP\t0/1:{k + 3}")
    return "\n".join(lines) + "\n"


def test_many_variant_files_in_one_scan(spark, tmp_path):
    r = random.Random(1)
    for i in range(12):
        (tmp_path / f"f{i}.vcf").write_text(_vcf(i, r))
    asked = dict(ann=["Consequence", "SYMBOL"], info=["DP"], sample=["GT", "DP"])
    out = vcf.flatten_many(spark, str(tmp_path), **asked)
    names = ["CHROM", "POS", "REF", "alt", "alt_index", "info_DP", "sample_GT", "sample_DP", "allele_1", "allele_2", "ann_Consequence", "ann_SYMBOL"]
    one = vcf.flatten_all(spark, [str(tmp_path / f"f{i}.vcf") for i in range(12)])
    # a file's own header names its first format alone where it declares one
    assert sorted(map(repr, out.select(*names).collect())) == sorted(map(repr, one.select(*names).collect()))
    plan = len(out._jdf.queryExecution().optimizedPlan().toString())
    for i in range(12, 1000):
        (tmp_path / f"f{i}.vcf").write_text(_vcf(i, r))
    more = vcf.flatten_many(spark, str(tmp_path), **asked)
    assert abs(len(more._jdf.queryExecution().optimizedPlan().toString()) - plan) < 200 and more.select("file").distinct().count() == 1000
    (tmp_path / "bad.vcf").write_text("##x\n1\t2\t.\tA\tC\t.\t.\tDP=1\n")
    with pytest.raises(Exception, match="no #CHROM line"):
        vcf.flatten_many(spark, str(tmp_path), **asked).count()


def test_base_table_by_dialect(spark):
    raw = spark.createDataFrame([("chr1", "NM_1", "0.2", "0.4", "x", "genome stability", "."), ("2", ".", "0.1", None, None, None, None)], "CHROM string, Transcript string, gnomAD_AF string, gnomAD_Global_AF string, Feature string, KEGG_Pathway string, EXOME_KEGG_Pathway string")
    g, m = (vcf.base_table(raw, d=d).orderBy("CHROM").collect() for d in (GENOME, MERGED))
    assert [x.TX for x in g] == ["NM_1", "NO_TX"] and [x.max_pop_af for x in g] == [0.2, 0.1] and [x.max_pop_af for x in m] == [0.4, None]
    assert [x.nonsyn for x in g] == [0, 0] and [x.nonsyn for x in m] == [1, 1]  # no Consequence column
    assert [x.dna_repair for x in g] == [0, 0] and [x.dna_repair for x in m] == [1, 0]  # only the long patterns know it
    first = raw.withColumns({"EXOME_KEGG_Pathway": F.lit("p53"), "EXOME_Consequence": F.lit("stop_gained"), "Consequence": F.lit("intron_variant")})
    assert [(x.dna_repair, x.pathway_hit, x.nonsyn) for x in vcf.base_table(first, d=MERGED).collect()] == [(0, 1, 0)] * 2
    assert [x.nonsyn for x in vcf.base_table(first, d=EXOME).collect()] == [1, 1]


def test_splits_by_family_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 997).alias("k"), F.concat(F.lit("F"), (F.col("id") * 7 % 60).cast("string")).alias("f"))
    for parts in (2, 8, 33):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            t = rows.groupBy("k").agg(F.collect_set("f").alias("fs"))
            for n, asked in enumerate(({"pattern": "[13]$"}, {"share": 0.1, "seed": 4})):
                path = str(tmp_path / f"{parts}-{n}")
                E.held_out_families(t, F.col("fs"), **asked).write.parquet(path)
                got = spark.read.parquet(path).collect()
                if "pattern" in asked:
                    held = {f"F{i}" for i in range(60) if str(i)[-1] in "13"}
                else:
                    hashes = [(x.h, x.f) for x in rows.select("f").distinct().select("f", F.xxhash64("f", F.lit(4)).alias("h")).collect()]
                    held = {f for _, f in sorted(hashes)[:6]}
                assert len(got) == 997 and all((x.split == "test") == bool(held & set(x.fs)) for x in got)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 2)
    empty = spark.createDataFrame([(1, None), (2, [])], "k int, fs array<string>")
    assert {x.split for x in E.held_out_families(empty, F.col("fs"), share=0.5).collect()} == {"train"}


def test_cancer_status_by_patient_or_by_row(spark):
    cols = "family_id string, patient_id string, chrom string, pos long, ref string, alt string, tx string, origin string, dp double, vaf double, acmg_raw string, pop_af double, consequence string, pathway string"
    seen = lambda p, pos, origin: ("F", p, "1", pos, "A", "C", "t", origin, 50.0, 0.5, "Pathogenic", 0.001, "stop_gained", ".")
    rows = spark.createDataFrame([seen("a", 1, "germline"), seen("a", 2, "somatic"), seen("b", 1, "germline"), seen(None, 1, "germline"), seen(None, 3, "somatic")], cols)

    def families(d):
        got = A.collapse_families(A.collapse_patients(A.with_flags(rows, d), d), d).collect()
        return {x.pos: (x.n_patients, x.n_cancer, x.n_noncancer, x.n_germ_only) for x in got}

    assert families(GENOME) == {1: (3, 0, 3, 3), 2: (1, 1, 0, 0), 3: (1, 1, 0, 0)}
    assert families(MERGED) == families(EXOME) == {1: (3, 2, 1, 3), 2: (1, 1, 0, 0), 3: (1, 1, 0, 0)}


def test_nested_runs_tell_the_rules_apart(spark):
    runs = spark.createDataFrame([("1", 10, 100, 0.9, 0.0), ("1", 40, 20, 0.1, 0.0), ("2", 5, 9, 0.6, 0.5), ("3", None, 9, 0.9, 0.0)], "seg_chrom string, seg_start long, seg_end long, phom double, phet double")
    points = spark.createDataFrame([("1", 15), ("1", 30), ("1", 50), ("2", 9), ("2", 10), ("3", 5), (None, 5)], "chrom string, pos long")
    of = lambda pick: sorted((x.chrom or "", x.pos, x.in_roh, x.high) for x in J.homozygous_runs(points, runs, (0.5, None), pick).collect())
    assert of("as_of") == [("", 5, 0, 0), ("1", 15, 1, 1), ("1", 30, 1, 0), ("1", 50, 0, 0), ("2", 9, 1, 1), ("2", 10, 0, 0), ("3", 5, 0, 0)]
    assert of("any") == [("", 5, 0, 0), ("1", 15, 1, 1), ("1", 30, 1, 1), ("1", 50, 1, 1), ("2", 9, 1, 1), ("2", 10, 0, 0), ("3", 5, 0, 0)]


def test_interval_bins(spark):
    r = random.Random(3)
    segs = [("1", s := r.randint(0, 10**8), s + r.choice([0, 5, 9_999, 10_000, 10**6, 2 * 10**8]), k) for k in range(300)] + [("1", 0, 2 * 10**8, 900), ("1", 50, 49, 901)]
    df = spark.createDataFrame(segs, "seg_chrom string, seg_start long, seg_end long, seg_id long")
    dealt = J.interval_bins(df).groupBy("seg_id").count().collect()
    assert len(dealt) == 301 and max(x["count"] for x in dealt) <= 2
    points = sorted({r.randint(0, 3 * 10**8) for _ in range(200)} | {s for _, s, _, _ in segs} | {e for _, _, e, _ in segs})
    got = {(x.pos, x.seg_id) for x in J.containing_segments(spark.createDataFrame([("1", p) for p in points], "chrom string, pos long"), df).collect()}
    assert got == {(p, k) for p in points for _, s, e, k in segs if s <= p <= e}


def test_inverted_file_finds_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    truth = V.nearest(e, "vec_id", "embedding", 5)
    assert N.recall(N.neighbours(e, "vec_id", "embedding", 5), truth).first().recall >= 0.9
    every = N.search(e, e, "vec_id", "embedding", 5, probes=10**6, per_block=90).select("i", "j", "rank").collect()
    assert sorted(every) == sorted(truth.select("i", "j", "rank").collect())
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0]), (3, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert [(x.i, x.j) for x in N.neighbours(some, "vec_id", "embedding", 5, probes=9).orderBy("i").collect()] == [(1, 3), (3, 1)]


def test_compared_share_falls_with_rows():
    r = np.random.default_rng(2)
    shares = []
    for n in (1_000, 4_000, 16_000):
        x = r.normal(size=(n // 100, 32)).repeat(100, 0) + 0.4 * r.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        lists = int(np.ceil(np.sqrt(n)))
        c = N.centroids_of(x[r.choice(n, min(n, lists * N.SAMPLE), replace=False)].astype(np.float32), lists)
        home, asked = N.assign(x.astype(np.float32), c, 1)[0][:, 0], N.assign(x.astype(np.float32), c, 8)[0]
        shares.append(np.bincount(home, minlength=lists)[asked].sum() / n / n)
    assert shares[0] > 1.6 * shares[1] > 1.6**2 * shares[2]


def test_blocks_of_a_join_meet_once(spark):
    left = spark.range(500).withColumn("g", F.col("id") % 7).join(spark.range(7).withColumnRenamed("id", "g"), "g")
    rows = left.select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("embedding"))
    got = V.nearest(rows, "vec_id", "embedding", 3, per_block=60)
    want = V.nearest(rows, "vec_id", "embedding", 3, per_block=10_000)
    assert sorted(got.select("i", "j", "rank").collect()) == sorted(want.select("i", "j", "rank").collect())


def test_fasta_windows_by_byte_offset(spark, tmp_path):
    r = random.Random(8)
    genome = {f"chr{k}": "".join(r.choice("ACGTacgtN") for _ in range(n)) for k, n in enumerate((1, 59, 60, 61, 5000, 300_000, 0))}
    for name, ending in (("a.fa", "\n"), ("b.fa", "\r\n")):
        with open(tmp_path / name, "w", newline="") as f:
            for contig, s in genome.items():
                f.write(f">{contig}{name[0]} some words{ending}" + "".join(s[i : i + 60] + ending for i in range(0, len(s), 60)))
    index = fasta_index.fasta_index(spark, str(tmp_path), partitionbytes=1000)
    got = {x.contig: (x.length, x.even) for x in index.collect()}
    assert got == {f"{k[3:]}{e}": (len(s), True) for k, s in genome.items() for e in "ab"}
    asked = [(f"{k}{e}", r.randint(-30, len(s) + 20), r.randint(0, 200)) for k, s in genome.items() for e in "ab" for _ in range(40)] + [("nowhere", 5, 9)]
    counter = spark.sparkContext.accumulator(0)
    out = fasta_index.fasta_windows(spark.createDataFrame(asked, "contig string, start long, length long"), index, counter=counter).collect()
    want = lambda c, s, n: genome.get(f"chr{c[:-1]}", "")[max(0, s) : max(0, s + n)].upper()
    assert {(x.contig, x.start, x.length): x.seq for x in out} == {(c.removeprefix("chr"), s, n): want(c.removeprefix("chr"), s, n) for c, s, n in asked}
    assert 0 < counter.value < 250_000 < sum(f.stat().st_size for f in tmp_path.iterdir())  # of 620 kB
    (tmp_path / "uneven.fa").write_text(">u\nACGT\nAC\nACGT\n")
    uneven = fasta_index.fasta_index(spark, str(tmp_path / "uneven.fa"))
    assert not uneven.first().even
    with pytest.raises(Exception, match="lines differ in length"):
        fasta_index.fasta_windows(spark.createDataFrame([("u", 0, 5)], "contig string, start long, length long"), uneven).collect()
