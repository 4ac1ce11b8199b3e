"""The regulariser of a whole table: neighbours, medians and pairs are those of plain numpy on all rows, whatever their ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinstrata.operators import vectors as V, walks as W


def plain(x, y, robust, k=15, t=3):
    """Of two views of the same rows; rows of nan have no view."""
    have = [~np.isnan(v).any(1) for v in (x, y)]
    d = [V.walk_distances(v[h], k, t) for v, h in zip((x, y), have)]
    by = [(np.sort(a[~np.eye(len(a), dtype=bool)])[(len(a) * (len(a) - 1) - 1) // 2] if robust else a.max()) for a in d]
    a, b = (z[np.ix_(both, both)] / (m + 1e-8) for z, m, both in zip(d, by, ((have[0] & have[1])[h] for h in have)))
    return ((a - b) ** 2).mean()


@pytest.mark.parametrize("robust", [True, False])
def test_regulariser_of_a_whole_table(spark, monkeypatch, robust):
    monkeypatch.setattr(W, "DRAWN", 8)
    r = np.random.default_rng(13)
    x, y = r.normal(size=(130, 5)), r.normal(size=(130, 4)) + 3
    x[40:60] += 20
    x[7], y[3] = np.nan, np.nan
    ids = np.r_[np.arange(65), 700 + 499 * np.arange(65)]
    some = lambda v: None if np.isnan(v).any() else v.tolist()
    df = spark.createDataFrame([(int(i), some(a), some(b)) for i, a, b in zip(ids, x, y)] + [(None, [1.0] * 5, [1.0] * 4)], "k long, x array<double>, y array<double>")
    want = plain(x, y, robust)
    assert abs(W.table_regulariser(df, "k", F.col("x"), F.col("y"), robust=robust, per_block=40).first().mse - want) < 1e-7 * max(1, want)


def test_regulariser_has_another_pass_where_a_guess_is_wrong(spark, monkeypatch):
    monkeypatch.setattr(W, "NEAR", 1 << 19)
    monkeypatch.setattr(W, "DRAWN", 1)
    passes, write = [], W.Rounds.write
    monkeypatch.setattr(W.Rounds, "write", lambda self, df: passes.append("kind" in df.columns) or write(self, df))
    r = np.random.default_rng(14)
    x, y = r.normal(size=(30, 3)), r.normal(size=(30, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "k long, x array<double>, y array<double>")
    got = W.table_regulariser(df, "k", F.col("x"), F.col("y"), 5, robust=True).first().mse
    assert abs(got - plain(x, y, True, 5)) < 1e-7 and sum(passes) == 2


def test_query_compares_rows_of_all_ids(spark):
    """2,000 rows of sf0.1 were four blocks of ids that didn't meet."""
    import pyarrow.parquet as pq

    x = np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id")["embedding"].to_numpy()).astype(float)
    got = entry.queries()["distance_regulariser"](spark, "/root/testdata/sf0.1").first().mse
    assert abs(got - plain(x[:, :32], x[:, 32:], True)) < 1e-5
    apart = V.block_regulariser(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("block", F.floor(F.col("vec_id") / 500)), "block", "vec_id", F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), robust=True).first().mse
    assert abs(got - apart) > 1e-3


def test_hubs_and_rows_without_neighbours(spark):
    one = spark.createDataFrame([(4, [1.0, 2.0], [0.5])], "k long, x array<double>, y array<double>")
    assert W.table_regulariser(one, "k", F.col("x"), F.col("y"), robust=True).first().mse == 0
    assert W.table_regulariser(one.where("k > 9"), "k", F.col("x"), F.col("y"), robust=True).first().mse is None
    x = np.vstack([np.zeros((1, 20)), 9 * np.eye(20), -9 * np.eye(20)])  # all have the first row for their nearest
    y = np.random.default_rng(15).normal(size=(41, 3))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "k long, x array<double>, y array<double>")
    want = plain(x, y, False, 1)
    assert abs(W.table_regulariser(df, "k", F.col("x"), F.col("y"), 1).first().mse - want) < 1e-7 * max(1, want)
