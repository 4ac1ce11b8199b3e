"""What grows with the input: rows read and shuffled by the collapses and the ledger, batches of the inverted file."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinstrata.llm import jaccard as J
from kinstrata.operators import neighbours as N, vectors as V
from kinstrata.plans import ledger

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,reads", [("family_collapse_merged", 2), ("family_collapse_merged_compat", 2), ("patient_evidence", 2), ("family_collapse_exome", 2), ("family_collapse_genome_compat", 1)])
def test_collapses_shuffle_rows_by_place_once(spark, name, reads):
    """Rows go by order and by place (with a cancer status: once for it, and once by patient); the collapses shuffle no more."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    lines = plan.splitlines()
    assert sum("lineitem.parquet" in x for x in lines) == reads
    first = next(k for k, x in enumerate(lines) if "Join" in x)
    assert sum("Aggregate" in x for x in lines[:first]) >= 2 and not any("Exchange" in x for x in lines[:first])


def test_refresh_reads_rows_once_for_digests_and_once_to_build(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(f"g{k % 3}", k) for k in range(30)], "g string, x long").mapInArrow(count, "g string, x long")
    out, _ = ledger.refresh(df, "g", lambda rows: rows.groupBy("g").agg(F.sum("x").alias("x")), str(tmp_path / "t"))
    assert {r.g: r.x for r in out.collect()} == {"g0": 135, "g1": 145, "g2": 155} and seen.value == 60
    seen.value = 0
    _, diff = ledger.refresh(df, "g", lambda rows: rows.groupBy("g").agg(F.sum("x").alias("x")), str(tmp_path / "t"))
    assert diff.count() == 0 and seen.value == 30


def test_vectors_go_to_many_lists_in_small_batches(spark, monkeypatch):
    r = np.random.default_rng(3)
    x, centroids = r.normal(size=(300, 16)), r.normal(size=(64, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").coalesce(1)
    assert N.BATCH > 0
    monkeypatch.setattr(N, "BATCH", 10_000)
    run = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.append(f))
    N.in_lists(df, "k", "v", centroids, 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(x.tolist())], ["id", "v"])
    got = list(run[0](iter([batch])))
    assert max(b.num_rows * 16 for b in got) <= 10_000 and sum(b.num_rows for b in got) == 300 * 50
    at, _ = N.assign(x.astype(np.float32), centroids, 50)
    assert [b for g in got for b in g.column("list").to_pylist()] == at.ravel().tolist()
    assert np.array_equal(np.concatenate([g.column("v").flatten().to_numpy() for g in got]).reshape(-1, 16), np.repeat(x, 50, axis=0))
    assert [b for g in got for b in g.column("id").to_pylist()] == np.repeat(np.arange(300), 50).tolist()


def test_queries_go_once_to_a_group_of_lists(spark):
    """50 of 64 lists are asked: copies follow the 5 groups, not the lists, and name the same lists."""
    r = np.random.default_rng(5)
    x, centroids = r.normal(size=(300, 16)), r.normal(size=(64, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = N.in_groups(df, "k", "v", centroids, 50, 5).collect()
    assert len(got) == 300 * 5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = [set() for _ in x]
    for row in got:
        lists[row.id] |= {5 * n + row.group for n in np.flatnonzero(np.unpackbits(np.frombuffer(row.asked, np.uint8), bitorder="little")).tolist()}
    assert lists == [set(at) for at in N.assign(u.astype(np.float32), centroids, 50)[0].tolist()]


def test_search_copies_a_query_to_few_groups(spark, monkeypatch):
    r = np.random.default_rng(7)
    x, centroids = r.normal(size=(300, 16)), r.normal(size=(64, 16)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    run, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: run.append(f) or plain(self, f, schema))
    N.search(df, df, "k", "v", 5, 50, centroids, 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(x.tolist())], ["id", "v"])
    assert run and max(sum(b.num_rows for b in f(iter([batch]))) for f in run) <= 300 * 16


def test_affinity_reads_and_norms_rows_once(spark):
    """Lists and median come from one table of unit vectors, however often blocks are dealt from it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    x = np.random.default_rng(8).normal(size=(50, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").mapInArrow(count, "k long, v array<double>")
    V.nearest_affinity(df, "k", "v", 3, 20).collect()
    assert seen.value == 50


def test_search_of_many_copies_in_small_groups(spark):
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(size=(90, 6)), np.ones((60, 6)), np.ones((20, 6)) + 1e-6 * r.normal(size=(20, 6))])[r.permutation(170)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    got = {}
    for row in N.search(df, df, "k", "v", 4, probes=10**6, per_block=11).orderBy("i", "rank").collect():
        got.setdefault(row.i, []).append(row.j)
    assert got == {i: sorted((j for j in range(170) if j != i), key=lambda j: (-sim[i, j], j))[:4] for i in range(170)}


def test_trees_compare_pairs_in_bounded_memory():
    """A bucket whose 1,000 points leave each pair, and many buckets of few points: the pairs of a plain search, and no table of all pairs' counts."""
    r = np.random.default_rng(4)
    for n, bucket in ((1000, np.zeros(1000, np.int64)), (1200, np.arange(1200) // 3)):
        points = r.poisson(3, (n, J.GROUPS)).astype("<u4")
        sizes = points.sum(1, dtype=np.int64)
        trees = J.RTrees(points, sizes, bucket)
        tracemalloc.start()
        i, j, bound = trees.pairs(50, 100)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        most = {}
        for x, y, b in zip(i.tolist(), j.tolist(), bound.tolist(), strict=True):
            most[min(x, y), max(x, y)] = b
        want = {}
        for x in range(n):
            ys = x + 1 + np.flatnonzero(bucket[x + 1 :] == bucket[x])
            b = np.minimum(points[x], points[ys]).sum(1, dtype=np.int64)
            want |= {(x, y): v for y, v, s in zip(ys.tolist(), b.tolist(), (sizes[x] + sizes[ys]).tolist(), strict=True) if 100 * v >= 50 * (s - v)}
        assert most == want and len(i) == len(want) and peak < 45e6
