"""Empty tables, nulls, repeats, clashing column names and long texts in each operator; the pipeline from end to end."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kinstrata.llm import html_main, packing, quality
from kinstrata.llm.common import word_hashes
from kinstrata.llm.embeddings import near_vectors
from kinstrata.llm.jaccard import jaccard_groups
from kinstrata.llm.substring import substring_dedup
from test_llm import brute_windows

CLASH = "kept string, n_removed int, n_words int, spans int, tag long, sig long, id long, score double, bin long, part long, __0 string, doc string"
LONG = " ".join(f"w{i % 7000}" for i in range(40_000))


def clashing(spark, rows):
    """documents whose other columns have names that the operators use."""
    return spark.createDataFrame([(i, t, *["k", 1, 2, 3, 4, 5, 6, 0.5, 7, 8, "z", "d"]) for i, t in rows], f"doc_id long, text string, {CLASH}")


ROWS = [(1, "one two three " * 9), (2, "one two three " * 9), (2, "one two three " * 9), (3, None), (4, ""), (None, "one two three " * 9), (None, None), (5, LONG), (6, LONG + " end"), (7, "\n\t ")]


def test_substring_cases(spark):
    docs = clashing(spark, ROWS)
    out = substring_dedup(docs, 13, docs.columns)
    assert out.columns == [*docs.columns, "_n_words", "_n_removed", "_spans", "_kept"]
    got = {(r["doc_id"], r["_n_words"], r["_n_removed"]) for r in out.collect()}
    want = {(i, w, g) for i, (w, g, _) in brute_windows([(*r, "") for r in ROWS], 13).items()}
    assert {g for g in got if g[0] is not None} == want and out.count() == len(ROWS) and {g for g in got if g[0] is None} == {(None, 27, 0), (None, 0, 0)}
    assert out.first()["kept"] == "k" and substring_dedup(clashing(spark, []), 13, docs.columns).count() == 0


def test_jaccard_cases(spark):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_groups(clashing(spark, ROWS), 3, 90, 100).collect())
    n = len({tuple(LONG.split()[p : p + 3]) for p in range(39_998)})
    assert got == [(-1, 0, None), (-1, 3, None), (1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (5, n, 5), (6, n + 1, 5), (7, 0, 7)]
    assert jaccard_groups(clashing(spark, []), 3, 90, 100).count() == 0


def test_vector_cases(spark):
    r = np.random.default_rng(0)
    v, far = r.normal(size=3000), r.normal(size=3000)
    rows = [(1, v.tolist()), (1, v.tolist()), (2, (v * 3).tolist()), (3, far.tolist()), (4, v[:8].tolist()), (5, None), (None, v.tolist())]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, cid long, v int")
    got = sorted((x.vec_id or -1, x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect())
    assert got == [(-1, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert near_vectors(df.where("vec_id = 99")).count() == 0


def test_html_cases(spark):
    long = "<article>" + "".join(f"<p>word{i} and more</p>" for i in range(8000)) + "</article>"
    rows = [(1, "u", "<article><p>Some words here</p></article>", "x"), (1, "u", "<article><p>Some words here</p></article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", long, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_main.main_text(df).collect()
    texts = sorted(((r.page_id or -1), r.text) for r in got)
    assert texts[:4] == [(-1, ""), (1, "Some words here"), (1, "Some words here"), (2, "")] and texts[4][1].count("and more") == 8000
    assert html_main.main_text(df.where("page_id = 99")).count() == 0


def test_packing_cases(spark):
    docs = clashing(spark, [(i, t) for i, t in ROWS if t != LONG + " end"])
    got = packing.pack_documents(docs, capacity=1024).collect()
    assert {r.length for r in got if r.doc_id in (3, 4)} == {1} and len([r for r in got if r.doc_id == 2]) == 2 and sum(r.length for r in got if r.doc_id == 5) > 40_000
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o + n <= 1024 for s in seqs.values() for o, n in s) and all(sorted(s)[0][0] == 0 for s in seqs.values())
    assert packing.pack_documents(clashing(spark, [])).count() == 0


def test_packing_leaves_no_saving_round(spark):
    from kinstrata.llm.common import Scratch

    r = random.Random(3)
    items = spark.createDataFrame([(i, 0, 0, r.choice([7, 31, 34, 36, 51, 66]), 0, i) for i in range(900)], "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    out = packing.best_fit_pack(items, Scratch(spark, "test"), capacity=100, per_part=40).collect()
    used, lengths = len({x.sequence_id for x in out}), np.array([x[3] for x in items.collect()])
    assert len(out) == 900 and packing.lower_bound(lengths, 100) <= used <= packing.lower_bound(lengths, 100) * 1.05 + 1


def quality_docs():
    r = random.Random(21)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))
    rows, base = [], []
    for i in range(240):
        if i % 5 == 4:
            text = " ".join(r.choice(["$$$", "WIN!!!", "x9x9", "###"]) for _ in range(60))
        elif i % 7 == 3 and base:
            words = r.choice(base).split()
            words[r.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(r.randint(30, 120)))
            base.append(text)
            if i % 11 == 0 and len(base) > 3:
                text += " " + " ".join(base[2].split()[:40])
        rows.append((i, text, "en", "s", len(text), "clash"))
    return rows


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = quality_docs() + [(900, None, None, None, None, None), (901, "", "en", "s", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 5 != 4), 0) for i in range(0, 240, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = quality.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    kept = {r[0]: r[1] or "" for r in rows if quality.score(np.array([quality.features(r[1])]), model)[0] >= quality.THRESHOLD}
    sets = {}
    for i, t in kept.items():
        w = t.lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    left = {i: k if g else kept[i] for i, (_, g, k) in brute_windows([(i, t, "") for i, t in kept.items()], 13).items()}
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole, want = Tokenizer.from_file(path("byte_bpe_50k.json")), set()
    for i, t in left.items():
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        cut = (len(ids) - 1) % 1024 + 1
        bounds = [0, *range(cut, len(ids) + 1, 1024)]
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and 0 < len(left) < len(rows)
    gone = {r[0] for r in rows} - set(left)
    assert len([i for i in gone if i % 5 == 4]) > 30 and len(gone) > 50


def test_stages_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 20, "en", "s", 100) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("kept", "n_removed", "__quality", "score", "_score", "component_id", "n_shingles", "tag")
    docs = docs.withColumns({n: F.lit("1") for n in names})
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r[n] for r in out.collect() for n in names} == {"1"}
    scored = quality.quality_scores(docs, None, docs.columns, "__s")
    assert scored.columns == [*docs.columns, "__s"] and scored.count() == 6


def test_word_hashes_part_words_as_split_does():
    r = random.Random(2)
    seen = {}
    for _ in range(300):
        raw = "".join(r.choice(["a", "bc", " ", "\n", "\x0b", "\x1c", "\xa0", "é"]) for _ in range(r.randint(0, 12))).encode()
        hashes = word_hashes(raw).tolist()
        words = raw.split()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and math.isfinite(len(seen))
