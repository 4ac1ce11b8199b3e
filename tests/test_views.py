"""Readers, sinks, encoders, samples, losses and ordered operators against plain Python and small fixtures."""

import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinstrata.functions import encoders as C, scalars as S, texts as T
from kinstrata.operators import aggregates as A, features as E, joins as J, ordered as O, vectors as V
from kinstrata.plans.dialect import MERGED
from kinstrata.sources import sinks, tables, vcf

VCF = "\n".join([
    "##INFO=<ID=AF,Number=A>", "##INFO=<ID=ANN,Number=.,Description=\"Functional annotations: 'Allele | Consequence | IMPACT'\">", "##FORMAT=<ID=GT>", "##FORMAT=<ID=DP>", "##FORMAT=<ID=AD>",
    "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "S1"]),
    "\t".join(["chr1", "10", ".", "A", "C,G", "50.5", ".", "AF=0.1,0.2;ANN=C|missense_variant|MODERATE", "GT:DP:AD", "1/2:30:10,5,15"]),
    "\t".join(["chrX", "7", ".", "T", "G", ".", "q10", "DB", "GT:AD", "0/1:0,0"]), "",
])


def test_typed_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    rows = {(r.CHROM, r.POS, r.ALT): r for r in vcf.typed(spark, str(tmp_path / "a.vcf")).collect()}
    a, b, c = rows[("1", 10, "C")], rows[("1", 10, "G")], rows[("X", 7, "G")]
    assert (a.VAF, a.AF, a.DP, a.QUAL, a.FILTER, a.allele_1, a.allele_2) == (5 / 15, 0.1, 30, 50.5, "PASS", "C", "G") and (b.VAF, b.AF) == (0.6, 0.2)
    assert (c.VAF, c.AF, c.DP, c.QUAL, c.FILTER, c.GT) == (None, None, None, None, "q10", "0/1")
    (tmp_path / "b.vcf").write_text(VCF.replace("\tFORMAT\tS1", "\tFORMAT\tS1\tS2"))
    with pytest.raises(ValueError):
        vcf.typed(spark, str(tmp_path / "b.vcf"))
    (tmp_path / "c.vcf").write_text(VCF.replace("Allele | Consequence | IMPACT", "Allele | Gene"))
    both = vcf.flatten_all(spark, [str(tmp_path / "a.vcf"), str(tmp_path / "c.vcf")])
    assert {"ann_Consequence", "ann_Gene"} <= set(both.columns) and both.count() == 6 and both.where("ann_Gene = 'missense_variant'").count() == 1


def test_base_table(spark):
    df = spark.createDataFrame([("chr2", "5", "A", "C", "30", "6,2", "Likely_pathogenic", "0.2", "DNA repair", "."), ("3", "6", "A", "C", None, "0,0", ".", "0.1", ".", "G")], "CHROM string, POS string, REF string, ALT string, `S1.DP` string, `S1.AD` string, Prediction_ACMG string, MAX_AF string, KEGG_Pathway string, HGNC_Name string")
    a, b = vcf.base_table(df, "S1").orderBy("CHROM").collect()
    assert (a.CHROM, a.dp_uni, a.vaf_uni, a.acmg, a.max_pop_af, a.dna_repair, a.pathway_hit, a.TX, a.gene) == ("2", 30.0, 0.25, 4, 0.2, 1, 1, "NO_TX", None)
    assert (b.dp_uni, b.vaf_uni, b.acmg, b.dna_repair, b.gene) == (None, None, None, 0, "G")


def test_files_and_annotations(spark, tmp_path):
    (tmp_path / "x_Exome_Genetic_Variants.txt").write_text("chr\tpos\tref\talt\tnote\nchr1\t5\tA\tC\tn\n")
    (tmp_path / "blank.tab").write_text("Chr Position value\nchr2  7   z\n")
    root = str(tmp_path)
    assert tables.one_file(spark, root, ".txt").endswith("x_Exome_Genetic_Variants.txt") and tables.one_file(spark, root, ".nope") is None
    (tmp_path / "y.txt").write_text("a\n")
    with pytest.raises(ValueError):
        tables.one_file(spark, root, ".txt")
    assert tables.first_file(spark, [root + "/none", root], ".tab").endswith("blank.tab")
    assert tables.annotation_path(f"{root}/x_Genetic_Variants.vcf.gz") == f"{root}/x_Exome_Genetic_Variants.txt"
    assert tables.annotations(spark, f"{root}/x_Exome_Genetic_Variants.txt").collect() == [("1", 5, "A", "C", "n")]
    assert tables.annotations(spark, f"{root}/blank.tab").collect() == [("2", 7, "", "", "z")]
    assert tables.annotations(spark, f"{root}/absent.txt").count() == 0
    (tmp_path / "s.tsv").write_text("ROW_ID\tREF_SEQ\tALT_SEQ\n1\tacg\tT\n\tA\tC\n")
    assert tables.sequence_rows(spark, f"{root}/s.tsv").collect() == [("1", "ACG", "T")]
    with pytest.raises(ValueError):
        tables.sequence_rows(spark, f"{root}/y.txt")


def test_fasta_blocks(spark, tmp_path):
    r = np.random.default_rng(3)
    letters = {f"chr{i}": "".join(r.choice(list("acgt"), n)) for i, n in enumerate([0, 1, 59, 60, 61, 4000], 1)}
    text = "".join(f">{c} note\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for c, s in letters.items())
    (tmp_path / "g.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("500", before):  # many blocks, and one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {x.contig: x.seq for x in tables.fasta(spark, str(tmp_path / "g.fa")).collect()}
            assert got == {c.removeprefix("chr"): s.upper() for c, s in letters.items() if s}
            chunks = {(x.contig, x.start): x.seq for x in tables.fasta_chunks(spark, str(tmp_path / "g.fa"), 100, 7).collect()}
            assert chunks == {(c.removeprefix("chr"), k): s[k : k + 107].upper() for c, s in letters.items() for k in range(0, len(s), 100)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("F1", "k1", 1, "0.5", "stop_gained", "DNA repair"), ("F2", "k2", 0, ".", "missense_variant", ".")], "FAMILY_ID string, VARIANT_KEY string, labels int, DP_GERM string, Consequence string, KEGG_Pathway string")
    assert sinks.safe_save(df, f"{root}/all") == (2, 6) and tables.delimited(spark, f"{root}/all").count() == 2
    views = sinks.ml_views(df, "F2")
    sinks.export_views(views, f"{root}/ml", df.where("FAMILY_ID = 'F1'"))
    assert tables.delimited(spark, f"{root}/ml/EVAL/NUMERIC").count() == 1
    back = spark.read.csv(f"{root}/ml/NUMERIC", sep="\t", header=True)
    assert [r["split"] for r in back.collect()] == ["test"]
    num = views["NUMERIC"].orderBy("FAMILY_ID").collect()
    assert [(r.DP_GERM, r.Consequence_num, r.Consequence_stop_gained, r.GERM_PASS, r.split) for r in num] == [(0.5, 5.0, 1, 0, "train"), (0.0, 4.0, 0, 0, "test")]
    assert sorted(r.ONTO_KEGG for r in views["ONTO"].collect()) == ["", "DNA repair"]
    assert sinks.json_file(spark, f"{root}/m/info.json", {"a": ["é"]}) and sinks.json_file(spark, f"{root}/m/info.json") == {"a": ["é"]}
    for epoch in (0, 1):
        sinks.append_metrics(spark, f"{root}/log", epoch=epoch, split="train", loss=0.5)
    assert spark.read.csv(f"{root}/log", header=True).count() == 2
    emb = sinks.write_embeddings(df, "VARIANT_KEY", ["Consequence"], lambda p: {"z": np.stack([[len(c), 1.0] for c in p["Consequence"]])}, ["z"], f"{root}/z")
    assert {(r.VARIANT_KEY, tuple(r.z)) for r in emb.collect()} == {("k1", (11.0, 1.0)), ("k2", (16.0, 1.0))}
    sinks.write_profile(df.withColumn("x", F.col("labels")), ["x"], ["Consequence"], f"{root}/profile")
    assert tables.delimited(spark, f"{root}/profile/numeric").first()["median"] == "0.5"
    built = []
    inputs = {"rows": 3, "files": tables.stamped(spark, f"{root}/m/info.json")}
    for _ in range(2):
        got = tables.cached(spark, f"{root}/cache", inputs, lambda: built.append(1) or df, order="VARIANT_KEY", rows=1)
    assert len(built) == 1 and [r.VARIANT_KEY for r in got.collect()] == ["k1"] and tables.cache_key({"b": 1, "a": 2}) == tables.cache_key({"a": 2, "b": 1})
    g = spark.createDataFrame([(5, 3, 4), (3, None, 1)], "acmg_germ int, acmg_som int, patient_class int")
    sinks.export_global_subsets(g, f"{root}/g")
    assert [tables.delimited(spark, f"{root}/g/{n}").count() for n in ("class_5", "class_3", "patient_class_ge_3")] == [1, 1, 1]


def test_ordered_operators(spark):
    r = np.random.default_rng(5)
    rows = [(None if g == 2 else f"g{g}", float(x), int(k)) for g, n in ((0, 700), (1, 3), (2, 40)) for x, k in zip(r.permutation(n * 3)[:n] / 7, r.integers(1, 9, n), strict=True)]
    df = spark.createDataFrame(rows, "g string, x double, k int")
    got = {(x.g, x.x): (x.run_k, x.next) for x in O.running(df, ["g"], "x", ["k"], n=8).collect()}
    for g in {a for a, *_ in rows}:
        own = sorted((x, k) for a, x, k in rows if a == g)
        total = 0
        for i, (x, k) in enumerate(own):
            total += k
            assert got[(g, x)] == (total, own[i + 1][0] if i + 1 < len(own) else None)
    assert {(x.g, x.x): x.place for x in O.places(df, ["g"], "x", n=4).collect()} == {(g, x): 1 + sum(b == g and y < x for b, y, _ in rows) for g, x, _ in rows}
    values = [None, float("nan")] + [float(v) for v in r.integers(0, 30, 501)]
    stats = E.column_stats(spark.createDataFrame([(v, 1.0) for v in values], "a double, b double"), ["a", "b"]).where("name = 'a'").first()
    clean = np.array(values[2:])
    for name, share in E.SHARES.items():
        assert math.isclose(stats[name], np.quantile(clean, share))
    assert (stats.n, stats.missing, stats.n_distinct, stats.low, stats.top) == (501, 2, len(set(clean)), clean.min(), clean.max())
    fixed = E.impute_median(spark.createDataFrame([(1.0, None), (None, None), (4.0, None)], "a double, b double"), "a", "b").collect()
    assert sorted(fixed) == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0)]
    s = spark.createDataFrame([("1", i * 10, i * 10 + 400 * (i % 3), i) for i in range(200)] + [("2", 5, 6, 900)], "seg_chrom string, seg_start long, seg_end long, seg_id long")
    p = spark.createDataFrame([(c, x) for c in ("1", "2", "3") for x in range(0, 3000, 37)], "chrom string, pos long")
    wide = {(x.chrom, x.pos): (x.seg_id, x.hit) for x in J.as_of_segment(p, s, width=100).collect()}
    assert wide == {(x.chrom, x.pos): (x.seg_id, x.hit) for x in J.as_of_segment(p, s, width=10**9).collect()} and wide[("1", 2960)] == (199, 0) and wide[("3", 0)] == (None, 0)


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 4 == 0 and 1 or 0) for i in range(400)] + [(0, 1), (None, 1)], "k long, y int")
    got = E.stratified(df, "k", "y", 40, seed=3).collect()
    assert len(got) == len({r.k for r in got}) == 40 and abs(sum(r.y for r in got) - 10) <= 1 and got and E.stratified(df, "k", "y", 10_000).count() == 400
    few = E.stratified(spark.createDataFrame([(i, 1) for i in range(30)] + [(100, 0)], "k long, y int"), "k", "y", 20).collect()
    assert len(few) == 20
    t = spark.createDataFrame([(1, ["F1"]), (2, ["F2", "F3"]), (3, [])], "k int, f array<string>")
    assert [r.split for r in E.held_out_families(t, F.col("f"), pattern="3$").orderBy("k").collect()] == ["train", "test", "train"]
    assert [r.split for r in E.held_out_families(t, F.col("f"), ["F1"]).orderBy("k").collect()] == ["test", "train", "train"]
    assert E.held_out_families(t, F.col("f"), share=0.34, seed=1).where("split = 'test'").count() == 1
    with pytest.raises(ValueError):
        E.held_out_families(t, F.col("f"), pattern="zzz")
    many = spark.createDataFrame([(float(i), float(-2 * i), float(i % 7), float(i % 7) + 1) for i in range(50)], "a double, b double, c double, d double")
    assert E.uncorrelated(many, ["a", "b", "c", "d"]) == ["a", "c"]
    with pytest.raises(Exception, match="repeats"):
        J.one_to_one(df, df, "k").collect()
    assert E.feature_columns(["POS", "labels", "x", "INTEGRATED_SCORE"]) == ["x"]


def test_encoders_and_texts(spark):
    df = spark.createDataFrame([("Deleterious(0.02)", "possibly_damaging(0.5)", "F1; NA,F2|F1", "A", "a.STATUT")], "SIFT string, PolyPhen string, fams string, ref string, `S1.GT` string").withColumn("alt", F.lit("AC"))
    r = E.encoded(df).select("SIFT_score", "SIFT_bin", "PolyPhen_ord", "PolyPhen_score", C.family_list(F.col("fams")).alias("f"), C.spaced(F.col("alt")).alias("s")).first()
    assert (r.SIFT_score, r.SIFT_bin, r.PolyPhen_ord, r.PolyPhen_score, r.f, r.s) == (0.02, 1, 1.0, 0.5, ["F1", "F2"], "A C")
    assert "S1.GT" not in C.without_sample_columns(df).columns and C.chosen_alleles(df, snv_only=True).count() == 0 and C.pick(df, ("x", "SIFT")) == "SIFT"
    assert C.global_lists(df.withColumn("PATIENT_ID", F.lit(None).cast("string"))).select("FAMILY_ID_LIST_GLOBAL", "PATIENT_ID_LIST_GLOBAL").first() == ("", "")
    t = spark.createDataFrame([("Cell cycle; mapk signalling", None), (".", "x")], "GO_BP string, HPO string")
    got = T.ontology_categories(t).collect()
    assert got[0].ontology_categories == '["signal transduction","DNA cycle/cell cycle"]' and got[0].primary_ontology_category == "signal transduction" and got[1].primary_ontology_category == "other / unassigned"


def test_text_with_other_letters(spark):
    texts = ["ACGTn", "aç  gß", None, "", "AC GT\n\tx", "日本A"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.clean_any_sequence(F.col("t")).alias("c"), S.reverse_complement(F.col("t")).alias("r")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert r.c == re.sub("[^ACGTN]", "N", re.sub(r"\s+", "", t or "").upper())
        assert r.r == (None if t is None else t.translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))[::-1])


def test_full_outer_keeps_left(spark):
    a, b = spark.createDataFrame([(1, None)], "k int, x string"), spark.createDataFrame([(1, "r"), (2, "s")], "k int, x string")
    assert sorted((r.k, r.x) for r in J.full_outer(a, b, ["k"], keep_left=True).collect()) == [(1, None), (2, None)]
    assert sorted((r.k, r.x) for r in J.full_outer(a, b, ["k"]).collect()) == [(1, "r"), (2, "s")]


def test_segments_make_passes(spark):
    v = spark.createDataFrame([("1", 10, "Pathogenic", "germline"), ("1", 90, "Pathogenic", "germline"), ("1", 10, "Benign", "somatic")], "chrom string, pos long, acmg_raw string, origin string")
    v = v.selectExpr("*", "1.0D AS dp", "0.0D AS vaf", "CAST(null AS double) AS pop_af", "'intron_variant' AS consequence", "'.' AS pathway")
    segs = spark.createDataFrame([("1", 0, 50, 1, 1)], "seg_chrom string, seg_start long, seg_end long, seg_loh int, seg_id long")
    got = {(r.pos, r.origin): (r.cnv_pass, r.row_pass) for r in A.with_flags(J.suspect_loci(v, segs, "containing"), MERGED).collect()}
    assert got == {(10, "germline"): (1, 1), (90, "germline"): (0, 0), (10, "somatic"): (0, 0)}


def test_losses_and_recall(spark):
    r = np.random.default_rng(6)
    n, tau = 23, 0.07
    a, b = r.normal(size=(n, 5)), r.normal(size=(n, 5))
    label = r.integers(0, 4, n)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), int(label[i]), [f"t{i % 3}", f"u{i % 2}"]) for i in range(n)], "k long, a array<double>, b array<double>, y int, t array<string>")
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    x = np.round(ua @ ub.T, 9) / tau
    lse = lambda m: np.log(np.exp(m).sum(1, keepdims=True))
    for weights, back in ((V.own_partner, "renormalised"), (V.same_label, "own"), (V.soft_terms({"t": 1.0}), "renormalised"), (V.mixed_terms({"t": 1.0}), "transposed")):
        same = np.eye(n, dtype=bool)
        jac = np.array([[len({f"t{i % 3}", f"u{i % 2}"} & {f"t{j % 3}", f"u{j % 2}"}) / len({f"t{i % 3}", f"u{i % 2}"} | {f"t{j % 3}", f"u{j % 2}"}) for j in range(n)] for i in range(n)])
        w = {V.own_partner: same.astype(float), V.same_label: ((label[:, None] == label) & ~same).astype(float)}.get(weights)
        if w is None:
            w = np.exp(np.where(same, 0.7, 0.3 * jac) / 0.25) if back == "renormalised" else np.where(same, 0.5, 0.5 * jac)
        total = w.sum(1, keepdims=True)
        t = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
        back_t = {"transposed": t.T, "own": np.divide(w.T, w.T.sum(1, keepdims=True), out=np.zeros_like(w), where=w.T.sum(1, keepdims=True) > 0), "renormalised": t.T / np.maximum(t.T.sum(1, keepdims=True), 1e-12)}[back]
        ab, ba = -(t * (x - lse(x))).sum(1).mean(), -(back_t * (x.T - lse(x.T))).sum(1).mean()
        got = V.contrastive_loss(df, "k", F.col("a"), F.col("b"), weights, {"m": F.col("y"), "t": F.col("t")}, back=back, per_block=10).first()
        assert math.isclose(got.loss_ab, ab, rel_tol=1e-6) and math.isclose(got.loss_ba, ba, rel_tol=1e-6)
    three = V.three_view_loss(df, "k", F.col("a"), F.col("b"), F.col("a"), V.own_partner).first()
    assert math.isclose(three.loss, three.loss_sb + 0.8 * three.loss_st + 0.8 * three.loss_bt)
    good = np.eye(n, dtype=bool) | (jac >= 0.5)
    hits = {k: np.mean([good[i, np.lexsort([np.arange(n), -m[i]])[:k]].any() for m in (x, x.T) for i in range(n)]) for k in (1, 5)}
    rec = V.multi_positive_recall(df, "k", F.col("a"), F.col("b"), F.col("t"), ks=(1, 5), per_block=10).first()
    assert math.isclose(rec.recall_1, hits[1]) and math.isclose(rec.recall_5, hits[5])


def test_pooling_distances_lifetimes(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "t array<array<double>>, m array<int>")
    got = [(r.p, r.f) for r in df.select(V.mean_pool(F.col("t"), F.col("m")).alias("p"), V.first_token(F.col("t")).alias("f")).collect()]
    assert got == [([2.0, 3.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 2.0])]
    d = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (0, 0, 0.0), (1, 1, 0.0)], "i int, j int, d2 double")
    assert V.distance_regulariser(d, d.withColumn("d2", F.col("d2") * 7)).first().mse < 1e-12
    assert V.lifetimes(np.array([[0.0], [1.0], [1.5], [9.0]])).tolist() == [0.5, 1.0, 7.5] and len(V.lifetimes(np.zeros((1, 2)))) == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["family_collapse_merged", "patient_evidence", "full_outer_annotate", "numeric_view", "feature_matrix", "ontology_categories", "column_describe"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want, got = con.execute(entry.oracle_sql()[name]).to_arrow_table(), entry.queries()[name](spark, DATA).toArrow()
    names = sorted(want.column_names)
    assert names == sorted(got.column_names)
    text = lambda t: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row) for row in zip(*(t.column(c).to_pylist() for c in names), strict=True))
    plain = lambda rows: [tuple(re.sub(r"\.0$", "", x) for x in r) for r in rows]
    assert plain(text(want)) == plain(text(got))
