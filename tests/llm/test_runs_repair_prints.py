"""Periodic runs, order MinHash and conversation repair against plain Python."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from kinstrata.llm import fingerprints as fp
from kinstrata.llm import repair, runs
from kinstrata.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def save(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# ---- op11

def brute_runs(words, power=4, least=6):
    """Every maximal stretch of every period, kept if no smaller period fits."""
    found, n = [], len(words)
    for q in range(1, n // power + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(least, power * q):
                stretch = words[start : start + length]
                if not any(all(stretch[i] == stretch[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            start = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r = random.Random(1)
    for case in range(400):
        n, alphabet = r.randint(0, 90), r.choice((1, 2, 3, 9))
        words = [r.randrange(alphabet) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            q = r.randint(1, 9)
            at = r.randint(0, n)
            words[at:at] = ([r.randrange(9) for _ in range(q)] * 8)[: r.randint(1, 8 * q)]
        assert [tuple(x) for x in runs.find_runs(np.array(words, np.int64)).tolist()] == brute_runs(words), words
    fibonacci = "ab"
    a, b = "a", "ab"
    for _ in range(9):
        a, b = b, b + a
    assert [tuple(x) for x in runs.find_runs(np.frombuffer(b.encode(), np.uint8).astype(np.int64)).tolist()] == brute_runs(b)


def test_grid_in_small_chunks_and_wrong_hashes(monkeypatch):
    r = random.Random(2)
    words = np.array([0] * 50 + [r.randrange(3) for _ in range(30)] + [1, 2, 3] * 20 + [5] * 9)
    want = runs.find_runs(words).tolist()
    monkeypatch.setattr(runs, "PAIRS", 5)
    assert runs.find_runs(words).tolist() == want == [list(x) for x in brute_runs(words.tolist())]
    monkeypatch.setattr(runs.Prefixes, "equal", lambda self, at, period, length: np.ones(len(at), bool))
    assert runs.find_runs(words).tolist() == want


def test_a_very_long_text_of_one_word():
    got = runs.find_runs(np.zeros(200_000, np.int64))
    assert got.tolist() == [[0, 200_000, 1]] and int(runs.collapsed(200_000, got).sum()) == 1


def damaged_words(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    words = damaged_words(doc_id, WORD.findall(text or ""))
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op11_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(("a", "b", "é", "longer")) for _ in range(r.randint(0, 60))), "x") for i in range(120)]
    rows += [(200, None, ""), (201, "", None), (202, " \t\n", ""), (203, "no\x0bspace\x1fhere " * 9, ""), (None, "ja " * 9, ""), (5, "twice " * 7, ""), (5, "twice " * 7, "")]
    d = save(spark, tmp_path, documents=(rows, "doc_id long, text string, n_words string"))
    got = Counter(tuple(x) for x in runs.op11_periodic_runs(spark, d).collect())
    assert got == Counter(expected_runs(i, t) for i, t, _ in rows)
    kept = runs.periodic_runs(spark.read.parquet(f"{d}/documents.parquet"), ["doc_id", "n_words"], names=("n", "found", "short")).where("doc_id = 203").first()
    assert kept.short == "no\x0bspace\x1fhere".replace("\x0b", " ") and kept.n_words == "" and kept.found[0].period == 2
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- op12

def xx(value: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(value, seed & (2**64 - 1))


def murmur(value: int, size: int, seed: int) -> int:
    def rotated(x, k):
        return (x << k | x >> (32 - k)) & 0xFFFFFFFF

    h = seed & 0xFFFFFFFF
    for k in struct.unpack(f"<{size // 4}I", (value & (1 << 8 * size) - 1).to_bytes(size, "little")):
        h ^= rotated(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rotated(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= size
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    h ^= h >> 16
    return h - 2**32 if h >> 31 else h


def long_bytes(x: int) -> bytes:
    return (x & (2**64 - 1)).to_bytes(8, "little")


def plain_fingerprint(text):
    """The same sketch by dictionaries: number occurrences, take each bin's least, put them in text order, hash."""
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,12}", text or "")
    hashes = [xx(t.encode()) for t in tokens]
    grams = [hashes[i : i + fp.K] for i in range(max(1, len(hashes) - fp.K + 1))] if hashes else []
    seen, bins = Counter(), {}
    for place, gram in enumerate(grams):
        h = 42
        for g in gram:
            h = xx(long_bytes(g), h)
        key = h & 0xFFFFFFFF
        number = seen[key]
        seen[key] += 1
        ranked = xx(struct.pack("<I", number), xx(long_bytes(key))) >> 32
        bins.setdefault(ranked >> 26, []).append((ranked, place))
    out = []
    for b in [*range(32, 64), *range(32)]:
        least = sorted(bins.get(b, []))[: fp.TUPLE]
        h = 0
        for ranked, _ in sorted(least, key=lambda x: x[1]):
            h = murmur(ranked, 8, murmur(h, 4, 42))
        out.append(h)
    return out


def test_fingerprints_equal_plain_python(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(1, 15)))
    texts = [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(40)]
    texts += [None, "", " \n", "one", "x" * 1000, "same " * 500, "ab cd " * 300]
    rows = [(i, t, "k") for i, t in enumerate(texts)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, k1 string")).collect()
    assert {x.doc_id: x.fingerprint for x in got} == {i: plain_fingerprint(t) for i, t, _ in rows}
    assert got[0].k1 == "k" and fp.fingerprints(spark.createDataFrame([], "text string")).collect() == []


def test_order_counts_and_likeness(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    moved = words[1000:] + words[:1000]
    near = [w if r.random() > 0.02 else "new" + w for w in words]
    other = [f"v{i}" for i in range(2000)]
    rows = [(" ".join(words), " ".join(x)) for x in (words, moved, near, other)] + [("", None), ("", "a b")]
    df = spark.createDataFrame(rows, "text string, there string")
    df = fp.fingerprints(fp.fingerprints(df), "there", "second").select(fp.likeness("fingerprint", "second").alias("x"))
    same, swapped, close, far, both, one = (x.x for x in df.collect())
    assert same == both == 1 and far == one == 0 and close > 0.8 and 0.3 < swapped < 0.8  # k-mers are the same when halves swap, tuples aren't


def test_op12_edits_and_neighbours(spark, tmp_path):
    r = random.Random(6)
    ids = r.sample(range(-50, 5000), 150)
    rows = [(i, "".join(r.choice("aé𝄞 b\n") for _ in range(r.choice((0, 1, 2, 7, 50)))), "c") for i in ids]
    rows += [(6000, None, ""), (6001, "equal texts here and there", ""), (6002, "equal texts here and there", ""), (None, "no place", "")]
    d = save(spark, tmp_path, documents=(rows, "doc_id long, text string, n_chars string"))
    got = {x.doc_id: x for x in fp.op12_fingerprints(spark, d).collect()}
    order = sorted((x for x in rows if x[0] is not None), key=lambda x: -x[0])
    for at, (i, text, _) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        cut = len(text) // 2
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].near_edited == 1.0 or edited != text
    assert got[6002].near_next == 1 and got[6002].fingerprint == got[6001].fingerprint and len(got) == len(rows)
    assert got[None].edited_sha256 == hashlib.sha256(b"no p").hexdigest() and got[None].near_next == 0


def test_op12_one_row_none_and_repeats(spark, tmp_path):
    d = save(spark, tmp_path / "a", documents=([(3, "abcd")], "doc_id long, text string"))
    assert fp.op12_fingerprints(spark, d).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    d = save(spark, tmp_path / "b", documents=([], "doc_id long, text string"))
    assert fp.op12_fingerprints(spark, d).collect() == []
    d = save(spark, tmp_path / "c", documents=([(1, "aaaa"), (2, "bb"), (2, "cc"), (2, "cc")], "doc_id long, text string"))
    got = fp.op12_fingerprints(spark, d).collect()
    assert len(got) == 4 and {x.edited_sha256 for x in got if x.doc_id == 1} <= {hashlib.sha256(x).hexdigest() for x in (b"aabb", b"aacc")}


# ---- op13

def best_edits(turns):
    """turns: (initial, fault). All edit strings by exhaustive recursion with memo on (place, state): the least (cost, string)."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    memo = {}

    def go(i, state, inserted):
        if (i, state, inserted) in memo:
            return memo[i, state, inserted]
        options = [(0, "")] if i == len(turns) and state in ("", "a") else []
        if inserted < 3:
            for role in "ua":
                if (state, role) in legal:
                    c, s = go(i, legal[state, role], inserted + 1)
                    options.append((c + 3, "I" + s))
        if i < len(turns):
            initial, fault = turns[i]
            c, s = go(i + 1, state, 0)
            options.append((c + 4, "D" + s))
            if fault not in ("blank", "duplicate"):
                for letter, role, price in [("K", initial, 0), ("R", "u", 3), ("R", "a", 3)]:
                    if (state, role) in legal:
                        c, s = go(i + 1, legal[state, role], 0)
                        options.append((c + price + 3 * (fault == "truncated"), letter + s))
        memo[i, state, inserted] = min(options, default=(10**9, ""))
        return memo[i, state, inserted]

    return go(0, "", 0)


KINDS = {"": repair.NONE, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}


@pytest.mark.parametrize("segment", [repair.SEGMENT, 3])
def test_cheapest_edits_equal_enumeration(segment):
    r = random.Random(7)
    convs = [[(r.choice("suaaux"), r.choice(["", "", "", *KINDS])) for _ in range(n)] for n in [*range(1, 9)] * 40]
    most = max(map(len, convs))
    role, fault = np.full((most, len(convs)), repair.OTHER), np.full((most, len(convs)), repair.ABSENT)
    for k, conv in enumerate(convs):
        for t, (initial, kind) in enumerate(conv):
            role[t, k], fault[t, k] = repair.ROLES.get(initial, repair.OTHER), KINDS[kind]
    cost, audit = repair.cheapest(role, fault, segment)
    for k, conv in enumerate(convs):
        assert (int(cost[k]), audit[k]) == best_edits(conv), conv


def plain_repair(rows):
    """conv_id -> the query's other columns."""
    out = {}
    for conv in {x[0] for x in rows}:
        turns = []
        for _, turn, role, text in [x for x in rows if x[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            turns += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            visible = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        cost, audit = best_edits([(role[:1], f) for (_, role, _), f in zip(turns, faults)]) if turns else (0, "")
        lines, k, state = [], 0, ""
        for letter in audit:
            if letter == "D":
                k += 1
                continue
            due = "assistant" if state == "u" else "user"
            role, text = (due, "") if letter == "I" else (turns[k][1] if letter == "K" else due, turns[k][2])
            k += letter != "I"
            state = role[0]
            lines.append(f"{role}:{text}")
        pairs = Counter(a[1][:1] + b[1][:1] in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), pairs[False], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_op13_rows(spark, tmp_path):
    r = random.Random(8)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = [(c, t, r.choice(roles), r.choice(["Yes.", "No! ", "open end", "a.b", "", None, "…", "Line\nmore?\n"])) for c in range(150) for t in sorted(r.sample(range(-3, 12), r.randint(1, 9)))]
    rows += [(500, None, "user", "a."), (500, None, "user", "b."), (500, 1, "user", "z."), (500, 1, "user", "a."), (500, 1, "user", "a."), (None, 1, "user", "q?"), (None, None, None, None)]
    rows += [(c, t, "user", "all dropped.") for c, t in [(c, t) for c in range(600, 640) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"{t} is long.") for t in range(120)]
    d = save(spark, tmp_path, conversations=([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, copies string"))
    got = {x.conv_id: tuple(x)[1:] for x in repair.op13_conversation_repair(spark, d).collect()}
    assert got == plain_repair(rows)


def test_repaired_turns_are_legal(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No.", "cut", " "])) for c in range(40) for t in range(r.randint(1, 7))]
    out = repair.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv in range(40):
        got = sorted((x.place, x.role[0]) for x in out if x.conv_id == conv)
        assert re.fullmatch("(s?(ua)+)?", "".join(x for _, x in got)) and [p for p, _ in got] == list(range(len(got)))
    assert repair.repaired_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
