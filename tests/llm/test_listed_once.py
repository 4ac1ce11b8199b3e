"""Rows that steps of the pipeline make: one for equal windows of a text, one for a pair of classes that meets in many buckets."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from test_brute import brute_windows

from kinstrata.llm import jaccard, substring
from kinstrata.llm.common import Scratch
from kinstrata.llm.jaccard import jaccard_groups


def repeated_lines(n: int) -> list[tuple]:
    """Texts of one line, again and again, with an own word in front; a text that ends in the line; a text of one word."""
    line = "one very common line of eight words here".split()
    rows = [(i, " ".join([f"own{i}"] + line * 40)) for i in range(n)]
    return [*rows, (n, " ".join([f"z{k}" for k in range(30)] + line * 3)), (n + 1, " ".join(["ab"] * 300)), (n + 2, " ".join(["ab"] * 290 + ["c"]))]


def test_a_line_that_fills_texts_has_few_rows_in_each(spark, monkeypatch):
    rows, seen = repeated_lines(12), []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (out := write(self, df, name), seen.append((name, out.count())) if name in ("chosen", "alive") else None)[0])
    got = {(x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 13).collect()}
    assert got == {(i, *v) for i, v in brute_windows([(i, t, "") for i, t in rows], 13).items()}
    assert sum(n for name, n in seen if name == "chosen") <= 8 * len(rows)
    assert 0 < sum(n for name, n in seen if name == "alive") <= 20 * len(rows)  # a row for each place: about 1,400


def test_places_of_a_chain_are_all_there_once(spark):
    docs = spark.createDataFrame(repeated_lines(3), "doc_id long, text string").withColumn("tag", F.lit(1).cast("long"))
    anchors = docs.mapInArrow(substring._first_level(13), "anchor long, doc_id long, tag long").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors"))
    rows = docs.join(anchors, ["doc_id", "tag"]).mapInArrow(substring._choose(13), substring._CHOSEN).collect()
    for doc in {r.doc_id for r in rows}:
        own = [r for r in rows if r.doc_id == doc]
        places = [p for r in own for p in r.places]
        assert len(places) == len(set(places)) and len({tuple(map(tuple, r.chain)) for r in own}) == len(own)
    assert max(len(r.places) for r in rows) > 10


def test_met_before():
    none = np.iinfo(np.int64).max
    first = np.array([[-5, 3, none], [3, 8, none], [4, 9, 11], [8, 9, none]])
    sig, i, j = np.array([3, 8, 9, 8]), np.array([0, 1, 2, 2]), np.array([1, 3, 3, 1])
    assert jaccard.met_before(first, sig, i, j).tolist() == [False, False, False, False]
    assert jaccard.met_before(first, np.full(3, 10), np.array([0, 2, 0]), np.array([1, 3, 2])).tolist() == [True, True, False]


def test_a_pair_that_meets_in_many_buckets_is_listed_once(spark, monkeypatch):
    r = random.Random(5)
    near, rows = [f"w{k}" for k in range(1500)], []
    for i in range(24):  # two of these share about 0.72 of their shingles, so none link but for the copies
        own = {r.randrange(1500): f"own{i}-{k}" for k in range(50)}
        rows.append((i, " ".join(own.get(k, w) for k, w in enumerate(near))))
    rows += [(100 + i, rows[i][1].replace("w7 ", "w7x ", 1)) for i in range(4)]
    made, cross = [], jaccard._cross
    where = spark.sparkContext.accumulator(0)

    def counted(num, den):
        run = cross(num, den)

        def each(batches):
            for found in run(batches):
                where.add(found.num_rows)
                yield found

        return each

    monkeypatch.setattr(jaccard, "_cross", counted)
    monkeypatch.setattr(jaccard, "_from_trees", lambda keys, pick, pairs=1, old=jaccard._from_trees: old(keys, pick, pairs))  # a batch for each bucket
    across = jaccard._across
    monkeypatch.setattr(jaccard, "_across", lambda *a: (out := across(*a), made.append(out.count()))[0])
    before = where.value
    got = {x.doc_id: x.component_id for x in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    sets = {i: set(jaccard.shingles(t, 5).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                lo, hi = sorted((want[i], want[j]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    assert got == want and len(set(want.values())) > 10
    assert made and made[0] > 50 and where.value - before <= 2 * 3 * made[0]  # twice: counted, and then written
