"""Comparisons of all rows: blocks stay few, groups don't meet, and results equal plain numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinstrata.operators import clusters as C, setjoin as S, vectors as V


def test_blocks_stay_few_as_a_table_grows(spark):
    n = 600
    df = spark.range(n).select(F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("a"))
    right = df.select(F.col("i").alias("j"), F.col("a").alias("b"))
    run = lambda t: pd.DataFrame({"x": [len(t.a)], "y": [len(t.b)]})
    got = V.block_products(df, right, run, "x long, y long", per_block=5).collect()
    assert len(got) <= V.BLOCKS**2 and sum(r.x * r.y for r in got) == n * n


def test_groups_are_compared_in_blocks(spark):
    r = np.random.default_rng(8)
    n, x, y = 90, r.normal(size=(90, 8)), r.integers(0, 3, 90)
    x[5], y[5] = x[70], y[70]  # ties
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)] + [(200, None, x[0].tolist())], "k long, label int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim, alike = np.round(u @ u.T, 9), (y[:, None] == y) & ~np.eye(n, dtype=bool)
    near = {}
    for row in V.nearest(df, "k", "v", 4, 7, by="label").orderBy("i", "rank").collect():
        assert row.block == y[row.i]
        near.setdefault(row.i, []).append(row.j)
    assert near == {i: sorted(np.flatnonzero(alike[i]).tolist(), key=lambda j: (-sim[i, j], j))[:4] for i in range(n)}
    e = np.where(alike, np.exp((u @ u.T) / 0.3), 0)
    top = {row.i: row.top for row in V.softmax_top(df, "k", "v", 0.3, 7, by="label").collect()}
    assert np.allclose([top[i] for i in range(n)], e.max(1) / e.sum(1)) and len(top) == n
    s2 = {row.block: row.s2 for row in V.median_distances(df, "k", "v", 7, by="label").collect()}
    for label in range(3):
        d = np.sort(2 - 2 * sim[alike & (y == label)[:, None]])
        assert abs(s2[label] - d[(len(d) - 1) // 2]) < 1e-12
    a, b = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x[:, :4], x[:, 4:]))
    s, both = np.round(a @ b.T, 9), y[:, None] == y
    rows = V.two_view_rows(df, "k", F.slice("v", 1, 4), F.slice("v", 5, 4), 0.07, 7, by="label").orderBy("side", "key").collect()
    for row in rows:
        m = s if row.side == 0 else s.T
        others = np.flatnonzero(both[row.key])
        assert row["rank"] == sorted(others, key=lambda j: (-m[row.key, j], j)).index(row.key) + 1
        assert abs(row.loss - np.log(np.exp(m[row.key, others] / 0.07).sum()) + m[row.key, row.key] / 0.07) < 1e-6
    assert len(rows) == 2 * n


def test_many_ties_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", (3, 4))
    x = np.random.default_rng(2).normal(size=(5, 3))[np.arange(40) % 5]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    t = V.Blocks(pd.DataFrame({"i": np.arange(40)}), pd.DataFrame({"j": np.arange(40)}), u, u)
    best, who = V.k_best(t, 6, lambda r, c, s: s, lambda r, c, s: np.round(s, 9), lambda last: last + 4e-10, 2e-9)
    sim = np.round(u @ u.T, 9)
    assert who.tolist() == [sorted(range(40), key=lambda j: (-sim[i, j], j))[:6] for i in range(40)]


def test_tree_of_groups_that_lists_do_not_leave(spark):
    """Tight groups of more rows than a list holds: their ways out are searched, and with a bound only short edges are given."""
    r = np.random.default_rng(4)
    x = np.concatenate([c + r.normal(scale=0.01, size=(30, 3)) for c in 5 * r.normal(size=(4, 3))])
    x[3] = x[4]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    tree = C.spanning_tree(df, "k", "v", per_block=40, near=3)
    d = sorted(row.d for row in tree.collect())
    assert np.allclose(d, V.lifetimes(x), atol=1e-8) and len(d) == 119
    short = C.spanning_tree(df, "k", "v", per_block=40, most=0.5, near=3)
    assert sorted(row.d for row in short.collect()) == d[:116]
    assert {row.k: row.cluster for row in C.members(df, "k", short, 0.5).collect()} == {i: i // 30 * 30 for i in range(120)}


def test_regulariser_without_a_row_a_pair(spark):
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(i, i // 30, r.normal(size=4).tolist(), r.normal(size=4).tolist() if i else None) for i in range(70)], "k long, block long, x array<double>, y array<double>")
    a, b = (V.diffusion_distances(df, "block", "k", c).select("i", "j", "d2") for c in ("x", "y"))
    for robust in (True, False):
        want = V.distance_regulariser(a, b, robust).first().mse
        got = V.block_regulariser(df, "block", "k", F.col("x"), F.col("y"), robust=robust).first().mse
        assert abs(got - want) < 1e-9 * max(1, want)


def test_targets_of_several_kinds_equal_dense_weights(spark):
    r = np.random.default_rng(10)
    rows = [(i, r.normal(size=4).tolist(), r.normal(size=4).tolist(), int(i % 3), int(i % 5), [f"t{i % 4}", f"u{i % 2}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, a array<double>, b array<double>, m int, g int, terms array<string>")
    one = lambda c: F.array(F.col(c).cast("string"))
    views = df, "k", F.col("a"), F.col("b")
    want = V.contrastive_loss(*views, V.mixed_sources({"terms": 1.0}), {c: F.col(c) for c in ("m", "g", "terms")}, back="transposed").first()
    got = S.soft_target_loss(*views, [one("m"), one("g"), F.col("terms")], [lambda s: s, lambda s: 0.5 * s, lambda s: 0.3 * s], 2.5, back="transposed").first()
    assert abs(got.loss_ab - want.loss_ab) < 1e-6 and abs(got.loss_ba - want.loss_ba) < 1e-6
    want = V.contrastive_loss(*views, V.same_label, {"m": F.col("m")}, back="own").first()
    got = S.soft_target_loss(*views, one("m"), lambda s: s, 0.0, back="own").first()
    assert abs(got.loss_ab - want.loss_ab) < 1e-6 and abs(got.loss_ba - want.loss_ba) < 1e-6


def test_two_blocks_of_a_table_meet_once(spark):
    n = 600
    df = spark.range(n).select(F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("a"))
    run = lambda t, own: pd.DataFrame({"x": [len(t.a)], "y": [len(t.b)], "own": [own]})
    got = V.block_pairs(df, run, "x long, y long, own boolean", per_block=5).collect()
    assert len(got) <= V.BLOCKS * (V.BLOCKS + 1) // 2 and sum(r.x * r.y * (1 if r.own else 2) for r in got) == n * n


def test_float_products_only_choose_what_is_looked_at(spark):
    """Cosines that differ by less than a float can tell, copies, and vectors that are one another's negatives: lists are those of the rounded cosines."""
    r = np.random.default_rng(11)
    x = np.repeat(r.normal(size=(4, 5)), 30, axis=0) + 1e-5 * r.normal(size=(120, 5)) * (np.arange(120) % 3 > 0)[:, None]
    x[60:90] *= -1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [float("nan")] * 5)], "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(np.einsum("ik,jk->ijk", u, u).sum(2), 9)
    near = {}
    for row in V.nearest(df, "k", "v", 4, 25).orderBy("i", "rank").collect():
        near.setdefault(row.i, []).append(row.j)
    assert near == {i: sorted((j for j in range(120) if j != i), key=lambda j: (-sim[i, j], j))[:4] for i in range(120)}


def test_median_is_exact_whatever_the_guess(spark, monkeypatch):
    r = np.random.default_rng(12)
    x = r.normal(size=(70, 3))
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "k long, g int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = ~np.eye(70, dtype=bool)
    want = lambda some: (d := np.sort(2 - 2 * np.round(u @ u.T, 9)[some & off]))[(len(d) - 1) // 2]
    for mid, half, fine in ((0.9, 0.05, 1 << 20), (-0.9, 0.05, 1 << 20), (0.0, 1.0, 1 << 10)):
        monkeypatch.setattr(V, "FINE", fine)
        monkeypatch.setattr(V, "_guess", lambda rows, metric, per_block: (rows if "block" in rows.columns else rows.withColumn("block", F.lit(0).cast("long"))).select("block").distinct().select("block", F.lit(mid).alias("mid"), F.lit(half).alias("half")))
        assert abs(V.median_distance(df, "k", "v", 20) - want(np.ones((70, 70), bool))) < 1e-12
    groups = np.arange(70) % 2
    got = {row.block: row.s2 for row in V.median_distances(df, "k", "v", 20, by="g").collect()}
    assert all(abs(got[g] - want((groups == g)[:, None] & (groups == g)[None, :])) < 1e-12 for g in (0, 1)) and len(got) == 2
