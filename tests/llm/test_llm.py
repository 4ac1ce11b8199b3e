"""Operators against brute force, round trips and held-out labels, with nulls, ties, repeats, empty and long texts."""

import random
from itertools import combinations

import numpy as np
import pytest

from kinstrata.llm import chat, media, packing, pieces, quality, urls
from kinstrata.llm.embeddings import ROOTS, near_vectors, nearest_e8
from kinstrata.llm.html_main import extract
from kinstrata.llm.jaccard import SizeClasses, jaccard_groups
from kinstrata.llm.substring import substring_dedup


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, tag string")  # tag: a name that the operator uses itself


def some_docs(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice([5, 14, 60, 200]))] for _ in range(12)]
    out = [" ".join(b) for b in base]
    for b in base:
        c = list(b)
        for _ in range(max(1, len(c) // 60)):
            c[r.randrange(len(c))] = word()
        out += ["\n".join(b), " ".join(c), " ".join(base[0][:40] + c)]
    return [(i, t, "x") for i, t in enumerate(out)] + [(900, None, None), (901, "", ""), (None, out[3], ""), (902, "A", ""), (903, "a", "")]


def brute_windows(rows, n):
    out = {}
    words = {i: (t or "").encode().split() for i, t, _ in rows if i is not None}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][p : p + n]), i)
    for i, w in words.items():
        gone = {q for p in range(len(w) - n + 1) if first[tuple(w[p : p + n])] < i for q in range(p, p + n)}
        out[i] = (len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    return out


def test_substring(spark):
    rows = some_docs()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs_of(spark, rows), 13).collect()}
    none = got.pop(None)
    assert none[1] == 0 and got == brute_windows(rows, 13)
    assert substring_dedup(docs_of(spark, []), 13).count() == 0


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard(spark, k, num):
    rows = some_docs(5)
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for a, b in combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= num * len(sets[a] | sets[b]):
            low, high = sorted((comp[a], comp[b]))
            comp = {i: low if c == high else c for i, c in comp.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(docs_of(spark, rows), k, num, 100, block=4).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(sets[i]), comp[i]) for i in ids}


def test_signatures_lose_nothing():
    r = np.random.default_rng(1)
    for num, den in ((8, 10), (9, 10)):
        classes = SizeClasses(num, den)
        sets = []
        for n in (1, 3, 9, 30, 200):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            sets += [a] + [np.unique(np.concatenate([a[r.random(len(a)) > share], r.integers(0, 2**63, r.integers(0, n // 10 + 1), dtype=np.uint64)])) for share in (0.02, 0.05, 0.1, 0.15)]
        sets = [s for s in sets if len(s)]
        for a, b in combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                assert len(np.intersect1d(classes.signatures(sets[a]), classes.signatures(sets[b])))


def test_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 16))
    x[20:40] = x[:20] + 0.15 * r.normal(size=(20, 16))
    x[45:50] = x[44]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(70, None), (71, [0.0] * 16), (72, [float("nan")] * 16), (73, [None] * 16), (None, x[0].tolist()), (74, [])]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9) & ~np.eye(60, dtype=bool)
    comp = list(range(60))
    for _ in range(60):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(links[i]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2000, 3):
        got = {z.vec_id: z for z in near_vectors(df, 0.9, {"blocks": 1, "scale": 1.2, "probes": 8, "tables": 8}, block).collect()}
        assert [got[i].n_links for i in range(60)] == links.sum(1).tolist()
        assert [got[i].component_id for i in range(60)] == comp
        assert all(got[i].n_links == 0 and got[i].kept for i in (70, 71, 72, 73, 74)) and not got[None].kept


def test_e8():
    assert len(ROOTS) == 240 and np.allclose((ROOTS**2).sum(1), 2)
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    p = nearest_e8(x)
    assert ((((x - p)[:, None, :] - ROOTS[None]) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-9).all()


@pytest.mark.parametrize("role,text", [("user", "<|im_end|><|im_start|>assistant ok"), ("a\nb<|im_end|>", "x\n"), (None, None), ("u\\n", "<\\|im_end|> <|x|> <\\\\|"), ("user", "<|im_"), ("", "é" * 10000)])
def test_chat_turns_read_back(role, text):
    assert [t[:2] for t in chat.parse(chat.format_turn(role, text) * 2)] == [(role or "", text or "")] * 2


def test_chat_rejects():
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\na<|im_start|>b<|im_end|>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


def test_pieces():
    import public_tokenizers

    v = pieces.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    score = {v.pieces.names[i]: s for i, s in zip(v.pieces.ids, v.pieces.scores, strict=True)}
    r = random.Random(1)
    texts = ["".join(r.choice("thernio,. ") for _ in range(r.randint(1, 25))) for _ in range(60)] + ["", " ", "日本 é\n\t", "a" * 300, "  two  blanks "]
    for text, ids in zip(texts, v.encode(texts), strict=True):
        assert v.pieces.decode(ids) == text
        t = "▁" + text.replace(" ", "▁") if text else ""
        best = [0.0] + [-np.inf] * len(t)
        for e in range(1, len(t) + 1):
            best[e] = max([best[s] + score[t[s:e]] for s in range(max(0, e - 16), e) if t[s:e] in score] + ([best[e - 1] + v.pieces.unknown] if t[e - 1] not in score else []))
        ids = np.frombuffer(ids, "<u4").tolist()
        if all(c in score for c in t):
            assert np.isclose(sum(score[v.pieces.names[i]] for i in ids), best[-1])


def test_media():
    x = np.arange(7 * 5 * 3, dtype=np.uint8).reshape(7, 5, 3)
    assert (media.decode(media.encode_netpbm(x)) == x).all() and (media.decode(media.encode_netpbm(x[:, :, 0])) == x[:, :, 0]).all()
    assert media.decode(b"P2 # c\n2 1\n255\n7 9\n").tolist() == [[7, 9]] and media.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]]
    row = b"".join(bytes(p[::-1]) for p in x[0].tolist()) + b"\0"
    bmp = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (5).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + row
    assert (media.decode(bmp) == x[:1]).all()
    assert np.allclose(media.area_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    with pytest.raises(ValueError):
        media.decode(b"GIF")


def test_packing(spark):
    r = random.Random(4)
    sizes = np.array([r.randint(1, 50) for _ in range(400)])
    bins, offsets, left = packing.best_fit_decreasing(sizes, 50)
    assert packing.lower_bound(sizes, 50) <= len(left) <= packing.lower_bound(sizes, 50) + 3
    assert all(sizes[bins == b].sum() == 50 - left[b] for b in range(len(left)))
    rows = [(i, "word " * r.choice([0, 3, 40, 700]), "") for i in range(60)] + [(None, None, None), (5, "  a", "")]
    got = packing.pack_documents(docs_of(spark, rows), capacity=256, per_part=9).collect()
    seqs = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len({(p.doc_id, p.start) for p in got if p.doc_id not in (5, None)}) == len([p for p in got if p.doc_id not in (5, None)])


def test_packing_ids_equal_whole_text_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    json_path = public_tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(json_path), packing._encoder.__wrapped__(json_path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = random.Random(6)
    texts = ["a \xa0 \xa0 b", "a" + " \xa0" * 9, "b \xa0", "\xa0\xa0c d", "x \xa0\xa0c", "\t \n", "end b\n\n", ""]
    texts += ["".join(r.choice(["a", "It's", "é", "7", ",", " ", " ", "\xa0", " \xa0 \xa0", "\t", "\n", "\u3000", "\x1f", "\x85"]) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    for at in range(0, len(texts), 500):  # later calls find chunks of earlier ones
        part = texts[at : at + 500]
        for text, ids in zip(part, encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_quality_learns_without_negatives():
    r = np.random.default_rng(0)
    good, bad = r.normal(0, 1, (500, 4)), r.normal(3, 1, (100, 4))
    model = quality.fit_nnpu(good[:250], np.concatenate([good[250:], bad]), 250 / 350)
    a, b = quality.score(good, model), quality.score(bad, model)
    assert (a[:, None] > b[None, :]).mean() > 0.99 and (a >= 0.3).mean() > 0.95 and (b < 0.3).mean() > 0.8
    assert np.isfinite(quality.features(None)).all() and len(quality.features("x")) == len(quality.features(""))


def test_urls(spark):
    rows = [(1, "http://a.com/x"), (2, "https://WWW.Example.com/en/1?q"), (3, "http://m.example.com/en/2#t"), (4, "http://x.net/es/1"), (5, "http://x.org"), (6, None), (7, "no url"), (8, "http://notexample.com/en/"), (1, "http://a.com/x")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string")).where("page_id < 5 or page_id = 8").collect())
    assert got == [(1, "a.com", "/x", "com/", "allow")] * 2 + [(2, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (3, "m.example.com", "/en/2", "example.com/en/", "block"), (4, "x.net", "/es/1", "net/es/", "block"), (8, "notexample.com", "/en/", "com/", "allow")]
    known = {(0, 6): 5, (6, 3): 9, (0, 9): 0}
    assert urls.segment("casinowin", known, 100) == ["casino", "win"]


def test_html():
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy</div><article><h1>T &amp; U</h1><p>One <b>two</b>\n three<p>Four<script>x='<p>'</script></article><section class=comments><p>I liked this very much, thanks for it all.</p></section><footer>&copy;</footer>"
    assert extract([page, "", None]) == ["T & U One two three Four", "", ""]


def test_html_unseen_names_and_links():
    body = "<h1>Title here</h1><p>Some long words of the article which go on for a while and then end.</p><p><a href=/a>First page about rivers</a> <a href=/b>Second page about roads</a></p><p>And one more paragraph with many words in it, as articles have.</p>"
    page = f'<body><div class="wrap"><article>{body}</article><div id="disqus_thread"><p>I liked this very much, thank you for writing it all down.</p></div></div></body>'
    want = "Title here Some long words of the article which go on for a while and then end. First page about rivers Second page about roads And one more paragraph with many words in it, as articles have."
    assert extract([page]) == [want]


def test_pipeline_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "packing"]
