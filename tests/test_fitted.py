"""Similar sets, soft targets, encoders and mergeable profiles against plain Python."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinstrata.operators import clusters as C, profiles as P, setjoin as S, vectors as V
from kinstrata.operators.features import column_stats
from kinstrata.operators.fitted import FeatureEncoder
from kinstrata.plans import ledger

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["profile_by_day", "encoded_unseen", "similar_term_sets", "loss_soft_terms", "loss_mixed_terms", "rule_prototypes", "cluster_members", "families_incremental"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("least", [0.0, 0.3, 0.5, 0.75, 0.8, 1.0])
def test_similar_sets_equal_brute_force(spark, least):
    r = random.Random(5)
    rows = [(k, [r.choice(["common", "usual"] + [f"t{i}" for i in range(12)]) for _ in range(r.randint(0, 9))]) for k in range(160)]
    rows += [(200, None), (201, [None, "common"]), (202, ["common"]), (203, [])]
    members, sets = S.term_sets(spark.createDataFrame(rows, "k long, t array<string>"), "k", F.col("t"))
    plain = {k: frozenset(x for x in t or () if x is not None) for k, t in rows}
    least_key = {}
    for k, t in plain.items():
        least_key[t] = min(k, least_key.get(t, k))
    assert {(m.key, m.set_id) for m in members.collect()} == {(k, least_key[t]) for k, t in plain.items()}
    got = {(x.a, x.b): x.jaccard for x in S.similar_sets(sets, least).collect()}
    want = {(least_key[a], least_key[b]): jaccard(a, b) for a, b in itertools.product(least_key, repeat=2) if least_key[a] < least_key[b] and jaccard(a, b) > 0 and jaccard(a, b) >= least}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("back", ["renormalised", "transposed"])
def test_soft_targets_equal_dense_ones(spark, back):
    r = np.random.default_rng(6)
    terms = [[str(t) for t in np.flatnonzero(r.random(5) < 0.4)] for _ in range(60)] + [["x"]] * 30 + [[], None]
    rows = [(k, r.normal(size=4).tolist(), r.normal(size=4).tolist(), t) for k, t in enumerate(terms)] + [(None, [1.0] * 4, [1.0] * 4, ["x"]), (500, None, [1.0] * 4, [])]
    df = spark.createDataFrame(rows, "k long, a array<double>, b array<double>, t array<string>")
    for weights, weight, own in ((V.soft_terms({"t": 1.0}), lambda s: F.exp(0.3 * s / 0.25), math.exp(0.7 / 0.25)), (V.mixed_terms({"t": 1.0}), lambda s: 0.5 * s, 0.5)):
        want = V.contrastive_loss(df, "k", F.col("a"), F.col("b"), weights, {"t": F.col("t")}, back=back).first()
        got = S.soft_target_loss(df, "k", F.col("a"), F.col("b"), F.col("t"), weight, own, back=back, per_block=25).first()
        assert (got.loss_ab, got.loss_ba, got.loss) == pytest.approx((want.loss_ab, want.loss_ba, want.loss), abs=1e-6)


def test_encoder_is_applied_without_a_refit(spark, tmp_path):
    train = spark.createDataFrame([("1", "a", ["p", "q"]), ("3", "b", ["q"]), (".", "a", None), ("5", "c", ["q", None])], "x string, c string, t array<string>")
    enc = FeatureEncoder(["x", "absent"], {"c": 2, "gone": 3}, {"t": 1}).fit(train)
    assert enc.medians == {"x": 3.0, "absent": 0.0} and enc.values == {"c": ["a", "b"], "gone": []} and enc.known == {"t": ["q"]} and enc.rows == 4
    path = str(tmp_path / "encoder.json")
    enc.save(spark, path)
    again = FeatureEncoder.load(spark, path)
    assert again == enc
    new = spark.createDataFrame([("k1", "7", "zzz", ["q"]), ("k2", None, None, []), ("k3", "nan", "a", None)], "key string, x string, c string, t array<string>")
    out = again.transform(new, ["key"])
    assert out.columns == ["key", *enc.names()]
    mean, std = 3.0, np.std([1, 3, 3, 5], ddof=1)
    got = [tuple(r) for r in out.orderBy("key").collect()]
    want = [("k1", 4 / std, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("k2", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0), ("k3", 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0)]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1:] for g in got], [w[1:] for w in want]) and mean == enc.means["x"]
    assert enc.transform(train.where("x = 'none'")).count() == 0 and FeatureEncoder(["x"]).fit(train.where("x = 'none'")).scales == {"x": 1.0}
    with pytest.raises(ValueError, match="kept and made"):
        enc.transform(train, ["x"])


def test_profiles_of_halves_merge_to_the_whole(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("half"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 10_007).cast("double")).alias("x"), F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")).alias("s"))
    shares = {"p05": 0.05, "median": 0.5, "p95": 0.95}
    parts = P.profile_sketches(df, ["half"], ["x"], ["s"])
    merged = {r["name"]: r for r in P.read_profiles(P.merge_profiles(parts), shares).collect()}
    exact = column_stats(df, ["x"]).first()
    x = np.array([r[0] for r in df.where("x is not null").select("x").collect()])
    m = merged["x"]
    assert (m.n, m.missing, m.low, m.top) == (exact.n, exact.missing, exact.low, exact["top"]) and m.mean == pytest.approx(exact["mean"])
    for name, q in shares.items():
        assert abs((x <= m[name]).mean() - q) < 0.02
    assert abs(m.n_distinct / exact.n_distinct - 1) < 0.03 and abs(merged["s"].n_distinct / 3000 - 1) < 0.03 and merged["s"].median is None
    whole = {r["name"]: r for r in P.read_profiles(P.profile_sketches(df, [], ["x"], ["s"]), shares).collect()}
    assert all(abs(whole[c].n_distinct / merged[c].n_distinct - 1) < 0.01 for c in ("x", "s"))
    assert P.read_profiles(P.profile_sketches(df.where("half = 9"), [], ["x"]), shares).count() == 0


def test_spanning_tree_of_all_rows_equals_prim(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    tree = C.spanning_tree(e, "vec_id", "embedding", per_block=40)
    got = C.lifetimes(tree).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(x)))
    assert np.allclose([r.death for r in got], V.lifetimes(np.stack(list(x.values())))[::-1], atol=1e-8)
    cut = got[len(got) // 2].death
    keys = sorted(x)
    reach = {k: k for k in keys}
    for _ in keys:
        for a in keys:
            reach[a] = min([reach[a], *(reach[b] for b in keys if round(float(np.linalg.norm(x[a] - x[b])), 9) <= cut)])
        if all(reach[reach[k]] == reach[k] for k in keys) and _ > 8:
            break
    assert {r.vec_id: r.cluster for r in C.members(e, "vec_id", tree, cut).collect()} == reach


def test_spanning_tree_of_ties_and_few_rows(spark):
    rows = [(k, [float(k // 2), 0.0]) for k in range(8)] + [(None, [0.0, 0.0]), (99, None)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    tree = C.spanning_tree(df, "k", "v", per_block=3)
    assert sorted((r.a, r.b, r.d) for r in tree.collect()) == [(0, 1, 0.0), (0, 2, 1.0), (2, 3, 0.0), (2, 4, 1.0), (4, 5, 0.0), (4, 6, 1.0), (6, 7, 0.0)]
    assert {(r.k, r.cluster) for r in C.members(df, "k", tree, 0.5).collect()} == {(k, k // 2 * 2) for k in range(8)} | {(99, 99)}
    assert C.spanning_tree(df.where("k = 1"), "k", "v").count() == 0 and C.lifetimes(C.spanning_tree(df.where("k < 0"), "k", "v")).count() == 0


def test_only_changed_groups_are_built_again(spark, tmp_path):
    built = []

    def total(rows):
        return rows.groupBy("g").agg(F.sum("x").alias("x"), F.count("*").alias("n"))

    def run(data):
        df = spark.createDataFrame(data, "g string, x long")
        out, diff = ledger.refresh(df, "g", total, str(tmp_path / "t"))
        built.append({(r.g, r.change) for r in diff.collect()})
        assert sorted(map(repr, out.select("g", "x", "n").collect())) == sorted(map(repr, total(df).select("g", "x", "n").collect()))

    first = [("a", 1), ("a", 1), ("b", 2), ("c", 3), (None, 4)]
    run(first)
    run(first[::-1])
    run([("a", 1), ("a", 1), ("b", 2), ("b", 5), ("d", 1), (None, 4)])
    run([("a", 1), ("a", 1), ("a", 1), ("b", 2), ("b", 5), ("d", 1)])
    run([])
    assert built == [{(g, "new") for g in ("a", "b", "c", None)}, set(), {("b", "changed"), ("c", "gone"), ("d", "new")}, {("a", "changed"), (None, "gone")}, {(g, "gone") for g in "abd"}]
