"""Windows, texts, tables, points and metrics on literal rows; queries against their SQL."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinstrata.functions import texts as T
from kinstrata.operators import aggregates as A, features as E, sequences as Q, vectors as V
from kinstrata.sources import tables

DATA = "/root/testdata/sf0.001"


def test_windows_from_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nACGTACGTAC\nGTacgtacgt\n>2\nGGGGG\n")
    genome = Q.chunks(tables.fasta(spark, str(tmp_path / "g.fa")), 4, 7)
    v = spark.createDataFrame([("1", 10, "C", "T"), ("1", 10, "CGT", "A"), ("1", 10, "GG", "A"), ("1", 2, "C", "T"), ("2", 3, "G", "GAA"), ("9", 3, "G", "A")], "contig string, pos long, ref string, alt string")
    got = {(r.contig, r.pos, r.ref): (r.seq_ref, r.seq_alt) for r in Q.centred_windows(v, genome, 4, 7).collect()}
    assert got == {("1", 10, "C"): ("GTACGTA", "GTATGTA"), ("1", 10, "CGT"): ("GTACGTA", "GTAAANN"), ("1", 10, "GG"): ("GTACGTA", None), ("1", 2, "C"): (None, None), ("2", 3, "G"): (None, None), ("9", 3, "G"): (None, None)}
    pad = {(r.contig, r.pos, r.ref): (r.seq_ref, r.seq_alt, r.ref_match) for r in Q.padded_windows(v, genome, 4, 3).where("contig <> '9'").collect()}
    assert pad[("2", 3, "G")] == ("NGGGGGN", "GGGAAGG", True) and pad[("1", 2, "C")] == ("NACGTAN", "NATGTAN", True)


def test_tables(spark, tmp_path):
    (tmp_path / "a.hom").write_text(" CHR  POS1 POS2\n chr1   10  20 \n\n 2 x 5\n")
    rows = tables.segments(tables.whitespace(spark, str(tmp_path / "a.hom")), start="POS1", end="POS2").orderBy("seg_end").collect()
    assert [(r.seg_chrom, r.seg_start, r.seg_end) for r in rows] == [("2", None, 5), ("1", 10, 20)]
    df = spark.createDataFrame([("F1", 1, 0, 1, "LOW,TOP"), ("F2", 0, 1, 0, "HIGH")], "family_id string, row_pass int, label_of_interest int, count_ge_2 int, integrated_class string")
    tables.export_subsets(df, str(tmp_path / "out"))
    assert tables.delimited(spark, str(tmp_path / "out/top"), ["row_pass", "no"]).collect() == [("1",)]
    assert tables.delimited(spark, str(tmp_path / "out/high_or_top")).count() == 2
    with pytest.raises(ValueError):
        tables.delimited(spark, str(tmp_path / "out/top"), ["no"])
    assert tables.minimal_view(df, ["family_id", "x"], ["row_pass", "y"]).orderBy("family_id").collect() == [("F1", "", 1, 0), ("F2", "", 0, 0)]
    built = []
    for _ in range(2):
        out = tables.reuse(spark, str(tmp_path / "kept"), lambda: built.append(1) or df)
    assert out.count() == 2 and len(built) == 1


def test_texts(spark):
    assert T.rule_values([0, 1]) == [0, 0.5, 1] and T.rule_values({"min": 1, "max": 3}) == [1, 2, 3] and T.rule_values({"value": 4}) == [4] and T.rule_values(2) == [2]
    assert T.prototypes(spark, {"a": [0, 1], "b": {"values": list(range(40))}}).count() == 64
    df = spark.createDataFrame([(1, ["a"], ["b"]), (2, [], []), (3, ["a", "b"], ["b"])], "i int, x array<string>, y array<string>")
    assert [r.j for r in df.orderBy("i").select(T.weighted_jaccard([(F.col("x"), F.col("y"), 1.0), (F.col("x"), F.col("x"), 1.0)]).alias("j")).collect()] == [0.5, 0.0, 0.75]
    w = T.tfidf(spark.createDataFrame([(1, "aa bb"), (2, None), (3, "aa")], "k int, t string"), "k", "t").collect()
    assert sorted((r.k, r.term) for r in w) == [(1, "aa"), (1, "aa bb"), (1, "bb"), (3, "aa")] and [r.w for r in w if r.k == 3] == [1.0]


def test_points_and_metrics(spark):
    cols = "n_cancer int, n_noncancer int, n_both int, strict int, partial int, row_pass int, germ_pass int, germ_tier int, segregation int, count_ge_2 int, pathway_hit int, dna_repair int, origin_profile string"
    rows = [(2, 0, 1, 1, 0, 1, 1, 1, 4, 1, 1, 1, "both"), (1, 1, 0, 0, 1, 1, 0, 2, 2, 1, 0, 0, "germline-only"), (0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, "somatic-only")]
    got = A.score_points(spark.createDataFrame(rows, cols)).collect()
    assert sorted((r.family_evidence, r.score, r.integrated_class, r.evidence) for r in got) == [
        (0, 1, "LOW", "COUNT_GE_2"), (2, 3, "LOW", "GERM_TIER+1|TWO_HIT_EVIDENCE|SEG+1"), (4, 12, "TOP", "GERM_PASS|GERM_TIER+2|TWO_HIT_STRICT|SEG+3|FAM_EVD+2|PATHWAY_HIT|ORIGIN_MOD+1")]
    m = E.classification_metrics(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0), (None, 1)], "l int, p int"), "l", "p").first()
    assert m.accuracy == 0.5 and abs(m.macro_f1 - (0.5 + 2 / 3 + 0) / 3) < 1e-9 and abs(m.weighted_f1 - (0.5 * 2 + 2 / 3) / 4) < 1e-9


def test_two_views(spark):
    df = spark.createDataFrame([(0, i, [1.0 if k == i else 0.0 for k in range(4)]) for i in range(4)], "b int, k int, v array<double>")
    pairs = V.two_view_pairs(df, "b", "k", F.col("v"), F.col("v"))
    r = V.recall_at_k(pairs, (1,)).first()
    assert r.recall_1 == 1.0 and V.infonce(pairs, 0.05).first().loss < 1e-6
    assert V.recall_at_k(V.two_view_pairs(df, "b", "k", F.col("v"), F.reverse("v")), (1, 4)).first()[1:] == (0.0, 1.0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["seq_window", "seq_window_padded", "field_pool", "tfidf_cosine"])
def test_against_sql(spark, name):
    import duckdb

    from kinstrata import feature_queries  # noqa: F401
    from kinstrata.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    text = lambda x: format(float(x), ".9g") if isinstance(x, (int, float)) else str(x)
    key = lambda rows: sorted(tuple(map(text, r)) for r in rows)
    assert key(df.select(cols).collect()) == key(con.execute(f"select {', '.join(cols)} from ({SQL[name]})").fetchall())


def test_nearest_crosses_labels_and_blocks(spark):
    x = np.random.default_rng(3).normal(size=(40, 6))
    x[9] = x[31]  # ties
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(90, 0, None), (None, 1, x[0].tolist())], "vec_id long, label int, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    want = {i: sorted((j for j in range(40) if j != i), key=lambda j: (-sim[i, j], j))[:5] for i in range(40)}
    for per_block in (7, 2000):
        got = {}
        for r in V.nearest(df, "vec_id", "embedding", 5, per_block).orderBy("i", "rank").collect():
            got.setdefault(r.i, []).append(r.j)
        assert got == want
    assert any(j % 3 != i % 3 for i in want for j in want[i])
    off = sim[~np.eye(40, dtype=bool)]
    assert abs(V.median_distance(df, "vec_id", "embedding", 7) - np.sort(2 - 2 * off)[len(off) // 2 - 1]) < 1e-9
    top = {r.i: r.top for r in V.softmax_top(df, "vec_id", "embedding", 0.3, 7).collect()}
    e = np.where(np.eye(40, dtype=bool), 0, np.exp(sim / 0.3))
    assert np.allclose([top[i] for i in range(40)], e.max(1) / e.sum(1))
    s = np.round((u[:, :3] / np.linalg.norm(u[:, :3], axis=1, keepdims=True)) @ (u[:, 3:] / np.linalg.norm(u[:, 3:], axis=1, keepdims=True)).T, 9)
    rows = V.two_view_rows(df, "vec_id", F.slice("embedding", 1, 3), F.slice("embedding", 4, 3), 0.07, 7).orderBy("side", "key").collect()
    assert np.allclose([r.loss for r in rows], np.concatenate([np.log(np.exp(t / 0.07).sum(1)) - np.diag(t) / 0.07 for t in (s, s.T)]))
    assert [r.rank for r in rows] == [sorted(range(40), key=lambda j: (-t[i, j], j)).index(i) + 1 for t in (s, s.T) for i in range(40)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["cosine_topk", "row_softmax", "knn_affinity", "infonce", "recall_at_k", "tfidf_cosine"])
def test_whole_table_against_sql(spark, name):
    test_against_sql(spark, name)


def test_sparse_cosine_crosses_id_blocks(spark):
    w = spark.createDataFrame([(i, t, 0.5) for i in (1, 70, 200, 9000) for t in (["x", "y"] if i != 200 else ["x"])], "item_id long, term string, w double")
    for per_part in (1, 1000):
        got = {(r.i, r.j): r.sim for r in T.sparse_cosine_all(w, "item_id", per_part).collect()}
        assert got == {(1, 70): 0.5, (1, 200): 0.25, (1, 9000): 0.5, (70, 200): 0.25, (70, 9000): 0.5, (200, 9000): 0.25}


def test_hierarchical_diffusion(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")

    def brute(h, k, t):
        n = len(h)
        d2 = [[sum((a - b) ** 2 for a, b in zip(h[i], h[j], strict=True)) for j in range(n)] for i in range(n)]
        pairs = sorted(d2[i][j] for i in range(n) for j in range(n) if i != j)
        s2 = pairs[(len(pairs) - 1) // 2] + 1e-8
        a = np.zeros((n, n))
        for i in range(n):
            for j in sorted((j for j in range(n) if j != i), key=lambda j: (d2[i][j], j))[:k]:
                a[i, j] = max(a[i, j], np.exp(-d2[i][j] / (2 * s2 + 1e-8)))
                a[j, i] = max(a[j, i], a[i, j])
        p = a / (a.sum(1, keepdims=True) + 1e-8)
        q = p
        for _ in range(t - 1):
            q = q @ p
        return [[((q[i] - q[j]) ** 2).sum() for j in range(n)] for i in range(n)]

    intra, inter = V.hierarchical_diffusion(df, "vec_id", "embedding", size=12, k=3, t=3)
    rows, blocks = intra.collect(), {}
    for r in rows:
        blocks.setdefault(r.block, set()).add(r.i)
    assert sorted(i for b in blocks.values() for i in b) == list(range(60)) and len(blocks) > 1
    for b, ids in blocks.items():
        ids = sorted(ids)
        want = brute(x[ids], 3, 3)
        assert {(r.i, r.j): pytest.approx(want[ids.index(r.i)][ids.index(r.j)], abs=1e-9) for r in rows if r.block == b} == {(r.i, r.j): r.d2 for r in rows if r.block == b}
    order = sorted(blocks)
    want = brute(np.array([x[sorted(blocks[b])].mean(0) for b in order]), 3, 3)
    got = {(r.a, r.b): r.d2 for r in inter.collect()}
    assert len(got) == len(order) * (len(order) - 1) and all(abs(d - want[order.index(a)][order.index(b)]) < 1e-9 for (a, b), d in got.items())
