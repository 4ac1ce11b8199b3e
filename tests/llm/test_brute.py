"""Operators against plain Python, enumeration, library results and exact round trips."""

import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest

from pyspark.sql import functions as F

from kinstrata.llm import chat, html_main, media, packing, pieces, quality, substring, urls
from kinstrata.llm.common import components, Scratch
from kinstrata.llm.embeddings import Lattice, plan_for
from kinstrata.llm.jaccard import GROUPS, RTrees, needed, point
from kinstrata.llm.substring import substring_dedup

from test_llm import brute_windows


# ---- op1

def test_long_repeats_are_settled_by_doubling_and_removed_exactly(spark):
    r = random.Random(11)
    word = lambda: r.choice("abcdefghij") + r.choice("abcdefghij") + r.choice("xyz")
    passages = [[word() for _ in range(n)] for n in (13, 14, 25, 26, 27, 52, 104, 130, 300, 900)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 2)):
            text += r.choice(passages) + [word() for _ in range(r.randint(0, 9))]
        rows.append((i, " ".join(text), "x"))
    rows += [(70, " ".join(passages[-1] + passages[-2]), ""), (71, rows[3][1], ""), (71, rows[3][1], ""), (72, None, ""), (73, " ".join("ab" for _ in range(400)), ""), (74, " ".join("ab" for _ in range(390)), "")]
    got = {(x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, tag string"), 13).collect()}
    assert got == {(i, *v) for i, v in brute_windows(rows, 13).items()}


def test_settled_spans_double_and_have_earlier_sources(spark):
    r = random.Random(12)
    passage = [f"w{r.randint(0, 10**6)}" for _ in range(500)]
    rows = [(i, " ".join([f"x{i}-{k}" for k in range(9)] + passage + [f"y{i}-{k}" for k in range(9)])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit(1).cast("long"))
    anchors = docs.mapInArrow(substring._first_level(13), "anchor long, doc_id long, tag long").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors"))
    chosen = docs.join(anchors, ["doc_id", "tag"]).mapInArrow(substring._choose(13), substring._CHOSEN)
    spans = {x.doc_id: x.settled for x in substring.settled_spans(chosen, Scratch(spark, "test"), 13).collect()}
    assert set(spans) == {1, 2, 3, 4, 5}  # the first document has no earlier one
    for got in spans.values():
        assert {s.size for s in got} >= {26, 52, 104, 208} and all(9 <= s.pos and s.pos + s.size <= 509 for s in got)
        assert len(got) < 500 / 6


def test_components_of_a_hot_node(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1009)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == dict.fromkeys(range(400), 0) | dict.fromkeys(range(1000, 1010), 1000)


def test_a_written_aggregate_lets_spark_split_a_hot_key(spark):
    scratch = Scratch(spark, "test")
    rows = scratch.write(spark.range(300_000).selectExpr("if(id % 3 < 2, 7, id) AS k", "id AS v", "xxhash64(id) AS w"), "rows")
    least = scratch.write(rows.groupBy("k").min("v").withColumnRenamed("min(v)", "m"), "least")
    hard = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in hard}
    try:
        for k, v in hard.items():
            spark.conf.set(k, v)
        joined = rows.join(least, "k")
        assert joined.count() == 300_000
        split = joined.select("w", "m")
        split.collect()
        assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ---- op2

@pytest.mark.parametrize("dim", [16, 64, 384])
def test_lattice_recall_at_cosine_09(dim):
    r = np.random.default_rng(dim)
    x = r.normal(size=(1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (1_000, 100_000, 10_000_000):
        lattice = Lattice(dim, **plan_for(n))
        a, b = lattice.cells(x), lattice.cells(y)
        meet = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
        assert meet.mean() >= 0.93


def test_the_share_of_compared_vectors_falls():
    r = np.random.default_rng(1)
    shares = []
    for n in (1_500, 6_000, 24_000):
        x = r.normal(size=(n, 64))
        cells = Lattice(64, **plan_for(n)).cells(x / np.linalg.norm(x, axis=1, keepdims=True))
        met = 0
        for t in range(cells.shape[1]):
            homes, every = Counter(cells[:, t, 0].tolist()), Counter(cells[:, t].ravel().tolist())
            met += sum(h * every[c] for c, h in homes.items()) - n
        shares.append(met / n / n)
    assert shares[0] > 1.9 * shares[1] > 1.9**2 * shares[2]  # the root of four: each vector meets at most twice as many in four times the rows


# ---- op4

def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(k, v, wide=False):
    if isinstance(v, int):
        return _varint(k << 3) + _varint(v)
    return _varint(k << 3 | 5) + v if wide else _varint(k << 3 | 2) + _varint(len(v)) + v


def unigram_model(path, vocabulary):
    """The model file of the same pieces in unigram mode, with the scores that ``vocabulary`` gives them."""
    score, out, i = dict(zip(vocabulary.ids.tolist(), vocabulary.scores.tolist(), strict=True)), b"", 0
    with open(path, "rb") as f:
        for k, v in pieces._fields(f.read()):
            if k == 1:
                d = dict(pieces._fields(v))
                v = _field(1, d[1]) + _field(2, struct.pack("<f", score.get(i, 0.0)), True) + _field(3, d.get(3, 1))
                i += 1
            elif k == 2:
                v = b"".join(_field(a, 1 if a == 3 else b, a in (10, 15, 51)) for a, b in pieces._fields(v))
            out += _field(k, v)
    return out


def test_pieces_equal_the_library_in_unigram_mode():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    mine = pieces.encoder(path)
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(path, mine.pieces))
    r = random.Random(3)
    texts = ["".join(r.choice(["the", "ing", "er", "tion", "a", "e", "s", " ", " ", ",", "ü", "日"]) for _ in range(r.randint(1, 12))) for _ in range(400)]
    texts += ["", "  two  blanks ", "line\nbreak\tand tab", "Grüße aus München, 日本 and 12345!", "x" * 200]
    got = [np.frombuffer(b, "<u4").tolist() for b in mine.encode(texts)]
    want = library.encode(texts, num_threads=1)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(texts)  # the rest are ties of float32 sums
    assert [len(a) for a in got] == [len(b) for b in want] or sum(len(a) != len(b) for a, b in zip(got, want, strict=True)) < 4
    assert [mine.pieces.decode(b) for b in mine.encode(texts)] == texts
    score = dict(zip(mine.pieces.ids.tolist(), mine.pieces.scores.tolist(), strict=True))
    total = lambda ids: sum(score.get(i, mine.pieces.unknown) for i in ids)
    assert all(abs(total(a) - total(b)) < 1e-3 for a, b in zip(got, want, strict=True))  # where ids differ, the sums are equal


def test_a_unigram_model_is_taken_as_it_is(tmp_path):
    import public_tokenizers
    import sentencepiece

    first = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model")).pieces
    made = unigram_model(public_tokenizers.path("piece_bpe_32k.model"), first)
    (tmp_path / "unigram.model").write_bytes(made)
    mine, library = pieces.encoder(str(tmp_path / "unigram.model")), sentencepiece.SentencePieceProcessor(model_proto=made)
    assert np.allclose(mine.pieces.scores, first.scores) and (mine.pieces.ids == first.ids).all()
    texts = ["the state of the water", "Grüße aus München", "", "a b c"]
    assert [np.frombuffer(b, "<u4").tolist() for b in mine.encode(texts)] == library.encode(texts, num_threads=1)


def test_pieces_tables(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "a bc\nd", 5), (2, None, 6), (None, "x", 7), (1, "a bc\nd", 8), (3, "", 9), (4, "wörd " * 20_000, 0)]
    back = pieces.decode_pieces(pieces.encode_pieces(spark.createDataFrame(rows, "doc_id long, text string, ids int"), path), path).collect()
    assert sorted((x.doc_id or 0, x.text) for x in back) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert {x.doc_id for x in back if not x.ids} == {2, 3}
    assert pieces.encode_pieces(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


# ---- op5

def test_links_through_the_trees_equal_brute_force():
    r = np.random.default_rng(4)
    for num, den in ((8, 10), (9, 10)):
        sets, bucket = [], []
        for b, m in enumerate([1, 2, 5, 17, 60, 300]):
            base = np.unique(r.integers(0, 2**63, r.integers(5, 400), dtype=np.uint64) * np.uint64(2))
            for _ in range(m):
                own = base[r.random(len(base)) > r.choice([0.0, 0.02, 0.1, 0.5])]
                sets.append(np.unique(np.concatenate([own, r.integers(0, 2**63, r.integers(1, 6), dtype=np.uint64)])))
                bucket.append(b)
        sizes, bucket = np.array([len(s) for s in sets]), np.array(bucket)
        i, j, bound = RTrees(np.stack([np.frombuffer(point(s), "<u4") for s in sets]), sizes, bucket).pairs(num, den)
        left = {frozenset(p): w for p, w in zip(zip(i.tolist(), j.tolist(), strict=True), bound.tolist(), strict=True)}
        assert len(left) == len(i) and (bucket[i] == bucket[j]).all()
        links = {frozenset((a, b)) for a, b in combinations(range(len(sets)), 2) if bucket[a] == bucket[b]
                 and (both := len(np.intersect1d(sets[a], sets[b], assume_unique=True))) >= needed(len(sets[a]) + len(sets[b]), num, den) and left[frozenset((a, b))] >= both}
        every = sum(math.comb(m, 2) for m in Counter(bucket.tolist()).values())
        found = {p for p in left if (lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= needed(len(sets[a]) + len(sets[b]), num, den))(*p)}
        assert found == links and 100 < len(links) < len(left) < every


def test_points_hold_great_counts():
    s = np.arange(GROUPS * 70_000, dtype=np.uint64) * np.uint64(2**64 // (GROUPS * 70_000))
    assert np.frombuffer(point(s), "<u4").sum() == len(s) and np.frombuffer(point(s), "<u4").max() > 65_536


# ---- op6

class _Potentials:
    def __init__(self, r):
        self.other = np.log(r.dirichlet(np.ones(3), 3))
        self.pair = {t: np.log(r.dirichlet(np.ones(3), 3)) for t in ("div", "p", "#run")}
        self.fact = {f: np.log(r.random(3)) for f in (".a", ".b", "#a", "#b")}


def test_marginals_equal_enumeration():
    r = np.random.default_rng(5)
    for n in (1, 2, 4, 7):
        tree, model = html_main.Tree(), _Potentials(r)
        for _ in range(n - 1):
            tree.add(int(r.integers(0, len(tree.tag))), str(r.choice(["div", "p", "#run", "table"])), tuple(r.choice(["a", "b", "c"], size=2)))
        total, content = 0.0, np.zeros(n)
        for y in product(range(3), repeat=n):
            w = math.log([0.98, 0.01, 0.01][y[0]])
            for i in range(n):
                w += sum(model.fact.get(("#" if tree.tag[i] == "#run" else ".") + f, np.zeros(3))[y[i]] for f in tree.facts[i])
                if i:
                    w += model.pair.get(tree.tag[i], model.other)[y[tree.parent[i]], y[i]]
            total += math.exp(w)
            content += math.exp(w) * (np.array(y) == html_main.CONTENT)
        other = html_main.Tree()
        got = html_main.marginals([tree, other, tree], model)
        assert np.allclose(got[0], content / total) and np.allclose(got[2], got[0])


# ---- op7

def test_area_resize_equals_exact_means():
    r = np.random.default_rng(6)
    for h, w in ((1, 64), (7, 5), (64, 64), (130, 64)):
        x = r.integers(0, 256, (h, w)).astype(np.uint8)
        fine = np.repeat(np.repeat(x.astype(float), 8, 0), 9, 1)
        want = fine.reshape(8, h, 9, w).mean((1, 3))
        for band in (1, 64 * 3, 1 << 20):
            assert np.allclose(media.area_resize(x, 8, 9, band), want)
        bits = (np.round(want, 6)[:, 1:] > np.round(want, 6)[:, :-1]).reshape(-1)
        assert media.difference_hash(x) == np.packbits(bits).tobytes().hex()


def test_media_rows_equal_plain_python(spark):
    rows = [(1, "ab", "x"), (2, None, ""), (None, "é" * 70, ""), (1, "ab", ""), (3, "", ""), (4, "long text " * 30_000, "")]
    got = media.media_features(media.text_media(spark.createDataFrame(rows, "doc_id long, text string, media string"))).collect()
    want = set()
    for doc, text, _ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        want.add((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert len(got) == len(rows) and {tuple(x)[:7] for x in got} == want
    assert len({(x.payload_sha256, x.feature) for x in got}) == len({x.payload_sha256 for x in got})


def test_tiles_cover_the_image(spark):
    x = np.random.default_rng(1).integers(0, 256, (300, 70, 3)).astype(np.uint8)
    rows = [("a", media.encode_netpbm(x)), ("b", b"GIF"), ("c", None)]
    got = media.media_tiles(spark.createDataFrame(rows, "path string, content binary"), tile=64).collect()
    back = np.zeros_like(x)
    for t in got:
        if t.path == "a":
            part = np.load(io.BytesIO(t.npy))
            back[t.row * 64 :, t.col * 64 :][: part.shape[0], : part.shape[1]] = part
    assert (back == x).all() and {t.path for t in got if t.error} == {"b", "c"}


# ---- op8

def fewest_bins(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= sizes[k] and rooms[b] not in rooms[:b]:
                place(k + 1, rooms[:b] + [rooms[b] - sizes[k]] + rooms[b + 1 :])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_bounds_and_packing_against_the_optimum():
    r = random.Random(8)
    for _ in range(60):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        least, used = fewest_bins(sizes, 20), len(packing.best_fit_decreasing(np.array(sizes), 20)[2])
        assert packing.lower_bound(np.array(sizes), 20) <= least <= used <= math.ceil(11 / 9 * least + 1)


def test_pieces_of_documents_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = False
    rows = [(i, t, i) for i, t in enumerate(["one two", None, "", "word " * 900, "\xa0 x  y\n" * 40, "Grüße " * 500, "a"])] + [(0, "one two", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, bin int"), capacity=100, per_part=5).collect()
    want = Counter()
    for doc, text, _ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        cut = (len(ids) - 1) % 100 + 1
        bounds = [0, *range(cut, len(ids) + 1, 100)]
        want.update((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want


# ---- op9

def test_quality_folds_and_labels(spark):
    r = random.Random(9)
    good = lambda: ". ".join(" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 8))) for _ in range(12)).capitalize() for _ in range(6))
    bad = lambda: " ".join(r.choice(["$$$", "WIN!!!", "x9x9", "###"]) for _ in range(80))
    rows = [(i, good() if i % 4 else bad(), "clash") for i in range(400)] + [(900, None, ""), (901, "", ""), (None, "x", ""), (5, "twice", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, 0), (10_000, 1, 0)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = lambda m: spark.createDataFrame(m, "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels(marks)).collect()
    assert len(got) == len(rows) and all(x.held_out == (x.doc_id is not None and fold(x.doc_id)) for x in got)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    held = [(x.score, x.doc_id % 4 > 0) for x in got if x.held_out and x.doc_id < 400]
    pairs = [(a, b) for a, p in held for b, q in held if p and not q]
    assert pairs and sum(a > b for a, b in pairs) / len(pairs) > 0.95
    turned = [(i, 1 - q if q is not None and i is not None and fold(i) else q, t) for i, q, t in marks]
    again = {(x.doc_id, x.score) for x in quality.classify(docs, labels(turned)).collect()}
    assert again == {(x.doc_id, x.score) for x in got}  # held-out labels are never read
    assert {x.score for x in quality.classify(docs, labels([])).collect()} == {0.5}


# ---- op10

def plain_filter(rows, rules=urls.RULES):
    """url_filter without Spark: host, path, rule, then the words of hosts and naive Bayes over all tokens."""
    tokens = lambda t: ["#" + str(len(w)) if w.isnumeric() else w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    pages = []
    for i, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [t for t, _ in rules for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len) if fits else None
        title = re.search(r"(?is)<title[^>]*>([^<]*)", html or "")
        pages.append((i, host, path, rule, dict(rules).get(rule), title[1] if title else ""))
    count = Counter()
    for _, host, path, _, _, title in pages:
        count.update(w for w in tokens(title) if w[0] != "#")
        count.update(tokens(path))
        count.update(w for part in host.split(".") if "-" in part for w in part.split("-") if w)
    total = sum(count.values()) or 1
    cost = lambda w: max(math.log(count[w] / total) if count[w] else -math.inf, math.log(10 / total) - len(w) * math.log(10))

    def split(word):
        best = [(0.0, [])]
        for to in range(1, len(word) + 1):
            best.append(max(((best[at][0] + cost(word[at:to]), best[at][1] + [word[at:to]]) for at in range(to)), key=lambda b: b[0]))
        return best[-1]

    named = set(urls.rule_tokens(rules))
    of = lambda host, path: [t for t in ["host:" + w for part in re.split(r"[.\-_:@]+", host) if part for w in split(part)[1]] + ["path:" + w for w in tokens(path)] if t not in named]
    seen = {"allow": Counter(), "block": Counter()}
    prior = Counter(v for *_, v, _ in pages if v)
    known = set()
    for _, host, path, _, verdict, _ in pages:
        known.update(of(host, path))
        if verdict:
            seen[verdict].update(of(host, path))
    size = {v: sum(c.values()) + len(known) + 1 for v, c in seen.items()}
    out = []
    for i, host, path, rule, verdict, _ in pages:
        s = math.log((prior["block"] + 1) / (prior["allow"] + 1))
        s += sum(math.log((seen["block"][t] + 1) / size["block"]) - math.log((seen["allow"][t] + 1) / size["allow"]) for t in of(host, path))
        out.append((i, host, path, rule, verdict or ("block" if round(s, 9) > 0 else "allow")))
    return out


def test_urls_equal_plain_segmenter_and_bayes(spark):
    r = random.Random(10)
    names = ["casino", "news", "garden", "pills", "cheap", "music", "river"]
    rows = []
    for i in range(160):
        host = r.choice(["", "www.", "m."]) + "".join(r.sample(names, r.randint(1, 2))) + r.choice(["", "-" + r.choice(names)]) + r.choice([".com", ".net", ".org", ".example.com", ".de"])
        path = r.choice(["/en/", "/es/", "/fr/", "/a/", ""]) + r.choice(names) + f"/{r.randint(1, 9999)}"
        rows.append((i, f"https://{host}{path}?q=1", f"<html><title>{r.choice(names)} {r.choice(names)}</title>"))
    rows += [(500, None, None), (501, "no url", ""), (502, "x://", None), (0, "http://UPPER.net/EN/x", None), (None, "http://casinonews.org/river", None), (503, "http://" + "casino" * 300 + ".org/" + "a" * 5000, None)]
    got = urls.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(x)[:5] for x in got), key=key) == sorted(plain_filter(rows), key=key)
    free = [x.verdict for x in got if x.rule is None]
    assert {"allow", "block"} == set(free) and all(x.verdict == x.method for x in got if x.rule is None)


def test_urls_without_rules_pages_or_html(spark):
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    got = urls.url_filter(spark.createDataFrame([(1, "http://a.b/c", "x")], "page_id long, url string, verdict string"), ()).collect()
    assert [(x.rule, x.verdict) for x in got] == [(None, "allow")]


# ---- op3

def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>", 0), (1, 0, "user", None, 0), (2, 0, None, "", 0), (None, None, "assistant", "x", 0), (1, 1, "assistant", "a", 0), (1, 1, "assistant", "a", 0), (3, 5, "assistant", "é" * 50_000, 0)]
    got = {x.conv_id: x for x in chat.read_back(chat.format_chat(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted int"))).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted(((t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        mine = got[conv]
        assert mine.n_turns == len(turns) and mine.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        masked = "".join(b for _, a, b in turns if a == "assistant")
        assert (mine.loss_chars, mine.loss_sha256) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())
    assert chat.read_back(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
