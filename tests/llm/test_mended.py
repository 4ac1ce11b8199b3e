"""Hard pages, very long names, empty tables, the risk's value and the class prior."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinstrata.llm import html_main, quality, urls
from kinstrata.llm.jaccard import jaccard_groups
from kinstrata.llm.common import Scratch

P = "<p>This is a paragraph of the story with a good number of words in it.</p>"
TEXT = "This is a paragraph of the story with a good number of words in it."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1>Title here</h1>{P}<ol><li>one thing here</li><li>two things here</li></ol>{P}</article>", f"Title here {TEXT} one thing here two things here {TEXT}"),
        (f"<article><h1>Title here</h1>{P}<dl><dt>term</dt><dd>what the term means</dd></dl>{P}</article>", f"Title here {TEXT} term what the term means {TEXT}"),
        (f"<article><h1>Title here</h1>{P}<table><tr><td>cell one</td><td>cell two of it</td></tr></table>{P}</article>", f"Title here {TEXT} cell one cell two of it {TEXT}"),
        (f"<div id=page><div class=content><h1>Title</h1>{P}{P}</div><div id=secondary><h2>Recent posts</h2><p>Some other text in the sidebar is here.</p></div></div>", f"Title {TEXT} {TEXT}"),
        (f"<div class='cc-window'>We use cookies on this site. <a href=x>Got it</a></div><article><h1>Title</h1>{P}{P}</article>", f"Title {TEXT} {TEXT}"),
        (f"<article><h1>Title</h1>{P}{P}</article><div id=kommentare><h3>Kommentare</h3><p>Ich finde das sehr gut geschrieben, danke.</p></div>", f"Title {TEXT} {TEXT}"),
        (f"<div class=main><h1>Title</h1>{P}{P}<div id=comentarios><p>Me parece muy bien escrito, gracias.</p></div></div>", f"Title {TEXT} {TEXT}"),
        (f"<div class=hdrx><a href=1>Home</a> <a href=2>News</a></div><div class=main><h1>Title</h1>{P}{P}</div><div class=qqwx><ul><li><a href=3>A link</a></li><li><a href=4>B link</a></li></ul></div>", f"Title {TEXT} {TEXT}"),
    ],
)
def test_hand_made_pages(page, want):
    assert html_main.extract([page])[0] == want


@pytest.mark.parametrize("page", ["<h2>" * 250_000, "<div>" * 100_000 + "</x>" * 100_000, "<ul><li>" * 125_000, "<b>" * 300_000 + "x", "<p>a" * 250_000])
def test_a_megabyte_of_open_tags(page):
    html_main.default_model()
    began = time.process_time()
    html_main.extract([page])
    assert time.process_time() - began < 15


def test_deep_text_stays():
    page = "<article>" + "<div>" * 600 + f"{P}" * 3 + "</div>" * 600 + P + "</article>"
    tree = html_main.parse_html(page)
    assert list(tree.text.values()) == [TEXT] * 4 and max(tree.depth) == html_main.DEEPEST


def test_long_hosts_and_titles(spark):
    letters = "abcdefghij" * 1000
    rows = [(1, f"http://{letters}.com/x", f"<title>{letters}</title>"), (2, f"http://{letters}{letters}.org/y", None), (3, "http://redhouse.org/", "<title>red house</title>"), (4, "http://red-house.com/a", "")]
    began = time.time()
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and time.time() - began < 100
    counts = spark.createDataFrame([("red", 5), ("house", 5), (letters, 3), (letters[:30], 2), (letters[3:40], 2)], "word string, c long")
    labels = spark.createDataFrame([("redhouse",), ("x" + letters + "red",), (letters[:30] + letters[3:40],)], "label string")
    words = {r.label: r.words for r in urls.segmented(labels, counts, 100).collect()}
    assert words == {"redhouse": ["red", "house"], "x" + letters + "red": ["x", letters, "red"], letters[:30] + letters[3:40]: [letters[:30], letters[3:40]]}


def test_quality_of_an_empty_table_and_of_unknown_labels(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).collect() == []
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).collect() == []
    other = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(30)], "doc_id long, text string")
    assert {r.score for r in quality.classify(other, labels).collect()} == {0.5}


def test_risk_in_both_branches():
    fp, fu = np.array([0.0, 2.0]), np.array([-1.0, 1.0, 0.0])
    loss = lambda z: np.log(1 + np.exp(-z))
    positive = 0.6 * (loss(0.0) + loss(2.0)) / 2
    negative = (loss(1.0) + loss(-1.0) + loss(0.0)) / 3 - 0.6 * (loss(0.0) + loss(-2.0)) / 2
    assert negative > 0 and quality.risk(fp, fu, 0.6) == pytest.approx((positive + negative, negative))
    risk, below = quality.risk(fp, np.array([-3.0, -2.0]), 0.6)
    assert below < 0 and risk == pytest.approx(positive)


def test_class_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        held, n = r.normal(2, 1, 3000), 8000
        ones = int(share * n)
        unlabelled = np.concatenate([r.normal(2, 1, ones), r.normal(-2, 1, n - ones)])
        assert abs(quality.class_prior(held, unlabelled) - share) < 0.05


def test_sets_are_made_of_candidates_alone(spark, monkeypatch):
    seen = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: (out := write(self, df, name), seen.append((name, out.count())) if name == "elements" else None)[0])
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(60))) for i in range(50)]
    rows += [(100 + i, " ".join(f"same{k}" for k in range(200)) + f" end{i}") for i in range(3)]
    got = {r.doc_id: r.component_id for r in jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert [got[100 + i] for i in range(3)] == [100] * 3 and all(got[i] == i for i in range(50))
    assert seen and sum(n for _, n in seen) <= 6
