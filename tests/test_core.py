"""Rules on literal rows, and a few queries against their SQL."""

import os
import re

import pytest
from pyspark.sql import functions as F

from kinstrata.functions import scalars as S
from kinstrata.operators import aggregates as A, joins as J
from kinstrata.sources import vcf

DATA = "/root/testdata/sf0.001"


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_classifications(spark):
    raw = ["Pathogenic", "Likely pathogenic", "Pathogenic/Likely_pathogenic", "Conflicting_interpretations_of_pathogenicity", "VUS", "Likely_benign", "Benign", "non classified", "7", ".", None]
    assert col(spark, raw, S.acmg_class) == [5, 4, 4, 5, 3, 2, 1, 0, 7, None, None]
    assert col(spark, raw, S.path5) == [5, 4, 4, None, 3, 2, 1, None, None, None, None]


def test_numbers_and_chromosomes(spark):
    assert col(spark, ["1.5", "nan", "5d", "inf", "-2e3", " 7 ", "", None], S.number) == [1.5, None, None, None, -2000.0, 7.0, None, None]
    assert col(spark, ["chr1", "CHRX", " 2", None], S.normalize_chrom) == ["1", "X", "2", None]
    assert col(spark, ["deleterious(0.02)", "0.3", "x", None], S.predictor_score) == [0.02, 0.3, None, None]
    assert col(spark, ["splice_donor_variant&intron_variant", "odd", ".", None], S.severity) == [5, 1, 0, 0]


def test_genotypes_and_info(spark):
    assert col(spark, ["0/1", "1|2", "./1", "1", "3/0", None], lambda g: S.allele(g, 1, F.lit("A"), F.lit("C,G"))) == ["A", "C", None, None, None, None]
    assert col(spark, ["A=1;F;X=a=b", "F", None], lambda c: S.info_field(c, "X")) == ["a=b", None, None]
    assert col(spark, ["A=1;F", "F2"], lambda c: S.info_field(c, "F")) == ["True", None]


def test_segregation_grid(spark):
    rows = [(p, c, n) for p in range(3) for c in range(3) for n in range(3)]
    got = spark.createDataFrame(rows, "p int, c int, n int").select("*", A.segregation(F.col("p"), F.col("c"), F.col("n")).alias("s")).collect()
    for r in got:
        want = 4 if r.c >= 2 and r.n == 0 else 3 if r.c == 1 and r.n == 0 else 2 if r.c else 1 if r.p == 1 else 0
        assert r.s == want


def test_segments_as_of_and_containment_differ(spark):
    segs = spark.createDataFrame([("1", 10, 100, 0, 1), ("1", 20, 30, 1, 2)], "seg_chrom string, seg_start long, seg_end long, seg_loh int, seg_id long")
    points = spark.createDataFrame([("1", p) for p in (5, 25, 50, 100, 101)], "chrom string, pos long")
    assert [(r.pos, r.hit) for r in J.as_of_segment(points, segs).orderBy("pos").collect()] == [(5, 0), (25, 1), (50, 0), (100, 0), (101, 0)]
    assert sorted((r.pos, r.seg_id) for r in J.containing_segments(points, segs, 7).collect()) == [(25, 1), (25, 2), (50, 1), (100, 1)]


def test_full_outer_meets_null_keys(spark):
    a = spark.createDataFrame([(1, None, 5), (2, "x", 1)], "k int, t string, d int")
    b = spark.createDataFrame([(1, None, 7), (3, "y", 2)], "k int, t string, d int")
    got = {(r.k, r.t, r.d, r.source_set) for r in J.full_outer(a, b, ["k", "t"], ("d",)).collect()}
    assert got == {(1, None, 7, "both"), (2, "x", 1, "left"), (3, "y", 2, "right")}


def test_aggregates(spark):
    rows = [("a", str(x)) for x in range(10)] + [("b", "1"), ("b", "t"), ("c", "."), ("d", "x"), ("d", "y|x")]
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v string, o int")
    got = {r.k: r for r in df.groupBy("k").agg(A.vote(F.col("v")).alias("vote"), A.max_or_first(F.col("v"), F.col("o")).alias("m"), A.joined_tokens(F.col("v")).alias("t")).collect()}
    assert got["a"].vote == "9.0" and got["b"].vote == "1|t" and got["b"].m == "1.0" and got["d"].t == "x,y"


def test_vcf(spark, tmp_path):
    text = "##INFO=<ID=ANN,Number=.,Description=\"Functional annotations: 'Allele | Consequence | IMPACT'\">\n##INFO=<ID=AF>\n##INFO=<ID=DB>\n##FORMAT=<ID=GT>\n##FORMAT=<ID=AD>\n##FORMAT=<ID=DP>\n"
    text += "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\nchr1\t10\t.\tG\tA,T\t5\tPASS\tAF=0.1;DB;ANN=A|missense|HIGH,A|other|LOW\tGT:AD:DP\t1/2:10,5\n"
    (tmp_path / "a.vcf").write_text(text)
    rows = vcf.flatten(spark, str(tmp_path / "a.vcf")).orderBy("alt_index", "ann_Consequence").collect()
    assert [(r.CHROM, r.POS, r.alt, r.ann_Consequence, r.allele_1, r.allele_2, r.info_DB, r.sample_AD, r.sample_DP) for r in rows] == [
        ("1", 10, "A", "missense", "A", "T", "True", "10,5", None), ("1", 10, "A", "other", "A", "T", "True", "10,5", None), ("1", 10, "T", None, "A", "T", "True", "10,5", None)]
    (tmp_path / "b.vcf").write_text("##x\n")
    with pytest.raises(ValueError):
        vcf.header(spark, str(tmp_path / "b.vcf"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["family_collapse_merged", "global_collapse_genome", "cnv_asof", "block_merge"])
def test_against_sql(spark, name):
    import duckdb

    from kinstrata.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    key = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert key(df.select(cols).collect()) == key(con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall())


def test_sequences_of_any_text(spark, tmp_path):
    from kinstrata.queries import QUERIES

    texts = ["ACgtN", "a c\tg\nt", "né\xa0A\u3000日本🧬c\x1fT", "straße ŉ", "e\u0301A", "", None]
    texts += [f"A{chr(c)}g" for c in [*range(1, 0xD800), *range(0xE000, 0x3000 + 0xE000, 7), *range(0x10000, 0x11000, 5)]]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    swap = str.maketrans("ACGTNacgtn", "TGCANtgcan")
    rc = {r.item_id: r.rc for r in QUERIES["revcomp"](spark, str(tmp_path)).collect()}
    assert rc == {i: None if t is None else t.translate(swap)[::-1] for i, t in enumerate(texts)}
    seq = {r.item_id: r.seq for r in QUERIES["seq_clean"](spark, str(tmp_path)).collect()}
    want = {i: re.sub("[^ACGTN]", "N", re.sub(r"\s+", "", (t or "").upper())) for i, t in enumerate(texts)}
    assert seq == want, [(texts[i], seq[i], want[i]) for i in want if seq.get(i) != want[i]][:20]
