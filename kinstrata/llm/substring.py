"""Substring dedup by level-wise doubling: windows that repeat at one length alone are extended to twice that length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BASES, Scratch, Windows, free_names, mix, rolling, slices, table, word_hashes


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchors(h: np.ndarray, n: int) -> np.ndarray:
    """For each window of n words, the smallest hash of its half-length windows: equal windows have equal anchors."""
    half = (n + 1) // 2
    return rolling(np.minimum, Windows(h, BASES[0]).of(half), n - half + 1)


def _first_level(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, tags, values, owners = part.column("doc_id").to_numpy(), part.column("tag").to_numpy(), [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    h = word_hashes(text.encode()) if text else ()
                    if len(h) >= n:
                        a = _anchors(h, n)
                        a = a[np.concatenate([[True], a[1:] != a[:-1]])]
                        values.append(a)
                        owners.append(np.full(len(a), i))
                if values:
                    who = np.concatenate(owners)
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(values))), pa.array(ids[who]), pa.array(tags[who])], ["anchor", "doc_id", "tag"])

    return run


_CHOSEN = "doc_id long, tag long, places array<int>, chain array<struct<a:long,b:int>>"
_SECOND = "doc_id long, tag long, pos int, h1 long, h2 int"


def _isin_runs(a: np.ndarray, values: np.ndarray) -> np.ndarray:
    """np.isin for an array whose equal values stand together."""
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return np.repeat(np.isin(a[first], values), np.diff(np.concatenate([first, [len(a)]])))


def _few_batches(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Few large batches rather than one per document."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class _Text:
    """A text's word hashes, the places of its windows of n words whose half-length anchor recurs, and two hashes of any window."""

    def __init__(self, text: pa.Scalar, anchors: pa.ListScalar, n: int):
        h = word_hashes(text.as_py().encode())
        self.n, self.hit = n, np.zeros(0, bool)
        if len(h) >= n:
            self.hit = _isin_runs(_anchors(h, n), anchors.values.to_numpy().view(np.uint64))
            self.one, self.two = Windows(h, BASES[0]), Windows(mix(h + np.uint64(1)), BASES[1])

    def hashes(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (mix((w.sums[at + length] - w.sums[at]) * w.down[at]) for w in (self.one, self.two))
        return _signed(a), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def chosen_places(hit: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Places among the hits whose hash is the least of some ``width`` neighbours: equal texts have them at equal places."""
    v = np.where(hit, h, np.uint64(2**64 - 1))
    if len(v) < width:
        return np.flatnonzero(hit & (v == v.min(initial=2**64 - 1)))
    low, none = rolling(np.minimum, v, width), np.zeros(width - 1, np.uint64)
    return np.flatnonzero(hit & (rolling(np.maximum, np.concatenate([none, low, none]), width) == v))


def _choose(n: int):
    """Rows of chosen places with the hashes of n, 2n, 4n ... words from there, as far as hits go unbroken. A text's places with the same hashes are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text, anchors in zip(*(batch.column(c) for c in ("doc_id", "tag", "text", "anchors")), strict=True):
                t = _Text(text, anchors, n)
                if not t.hit.any():
                    continue
                p = chosen_places(t.hit, t.one.of(n), 2 * n)
                ends = np.flatnonzero(~np.concatenate([t.hit, [False]]))
                reach = ends[np.searchsorted(ends, p)] + n - 1 - p  # words up to the end of the last hit in a row
                levels = [n << k for k in range(int(reach.max() // n).bit_length())]
                a, b = np.zeros((len(p), len(levels)), np.int64), np.zeros((len(p), len(levels)), np.int32)
                has = reach[:, None] >= np.array(levels)[None, :]
                for k, length in enumerate(levels):
                    a[has[:, k], k], b[has[:, k], k] = t.hashes(p[has[:, k]], length)
                count = has.sum(1)
                last = np.stack([count, *(x[np.arange(len(p)), count - 1] for x in (a, b))], 1)
                order = np.lexsort(last.T)  # places of a chain stay in order
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(last[order], axis=0) != 0).any(1)]))
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(p)).astype(np.int32)), pa.array(p[order].astype(np.int32)))
                a, b, has = (x[order[starts]] for x in (a, b, has))
                offsets = np.concatenate([[0], np.cumsum(has.sum(1))]).astype(np.int32)
                chain = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a[has]), pa.array(b[has])], ["a", "b"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), doc.as_py(), np.int64)), pa.array(np.full(len(starts), tag.as_py(), np.int64)), places, chain], ["doc_id", "tag", "places", "chain"])

    return lambda batches: _few_batches(run(batches), 20_000)


def _pairs_of(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(place, words) of a text's settled spans."""
    if not cell.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(cell.values.field(k).to_numpy().astype(np.int64) for k in ("pos", "size"))


def _within(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge)[:-1] > 0


def _second_level(n: int):
    """Windows of n words whose half-length anchor recurs, but those inside settled spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text, anchors, settled in zip(*(batch.column(c) for c in ("doc_id", "tag", "text", "anchors", "settled")), strict=True):
                t = _Text(text, anchors, n)
                pos, size = _pairs_of(settled)
                at = np.flatnonzero(t.hit & ~_within(len(t.hit), pos, pos + size - n + 1) if len(pos) else t.hit)
                if len(at):
                    h1, h2 = t.hashes(at, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc.as_py(), np.int64)), pa.array(np.full(len(at), tag.as_py(), np.int64)), pa.array(at.astype(np.int32)), pa.array(h1), pa.array(h2)], ["doc_id", "tag", "pos", "h1", "h2"])

    return lambda batches: _few_batches(run(batches))


_OUT = "n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
_ARROW = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())]


def _remove(n: int, carry: int):
    def one(text: str | None, at: pa.ListScalar, settled: pa.ListScalar, copy: bool | None) -> tuple:
        words = text.encode().split() if text else []
        if copy and len(words) >= n:
            return len(words), len(words), [{"start": 0, "end": len(words)}], ""
        start, size = _pairs_of(settled)
        if at.is_valid:
            pos = at.values.to_numpy().astype(np.int64)
            start, size = np.concatenate([start, pos]), np.concatenate([size, np.full(len(pos), n)])
        if not len(start):
            return len(words), 0, [], b" ".join(words).decode()
        gone = _within(len(words), start, start + size)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
        spans = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2], strict=True)]
        return len(words), int(gone.sum()), spans, kept.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts, copies = part.column("__text").to_pylist(), part.column("__copy").to_pylist()
                rows = [one(*x) for x in zip(texts, part.column("__at"), part.column("__settled"), copies, strict=True)]
                new = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:carry], *new], [*part.schema.names[:carry], *(f"__new_{x}" for x, _ in _ARROW)])

    return run


def _recurring(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi) that documents of different ids share."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")


def settled_spans(chosen: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """(doc_id, tag, settled): spans of words, 2*words, 4*words ... words from chosen places that an earlier document has too.

    A window that recurs at one length alone is held against the next; this ends when none recurs. A text that repeats itself
    has one row for its equal windows, so a line that fills very many texts costs a few rows for each of them.
    """
    alive, found, level = chosen, [], 0
    while True:
        step = F.col("chain")[level]
        now = alive.where(F.size("chain") > level).select("doc_id", "tag", "places", "chain", step["a"].alias("a"), step["b"].alias("b"))
        shared = scratch.write(_recurring(now, ["a", "b"]).select("a", "b", "lo"), "shared")
        new = scratch.write(now.join(shared, ["a", "b"]).select("doc_id", "tag", "places", "chain", (F.col("doc_id") > F.col("lo")).alias("later")), "alive")
        scratch.drop(shared)
        if new.isEmpty():
            break
        found.append(new.where("later").select("doc_id", "tag", "places", F.lit(words << level).alias("size")))
        alive, level = new, level + 1
    if not found:
        return chosen.sparkSession.createDataFrame([], "doc_id long, tag long, settled array<struct<pos:int,size:int>>")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("doc_id", "tag", "places").agg(F.max("size").alias("size"))
    spans = F.transform("places", lambda p: F.struct(p.alias("pos"), F.col("size").alias("size")))
    return scratch.write(best.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list(spans)).alias("settled")), "settled")


def substring_dedup(docs: DataFrame, words: int = 13, carry: list[str] = ("doc_id",)) -> DataFrame:
    """Remove each word that lies in a window of ``words`` words which also starts in a document with a smaller doc_id.

    Returns a row per input row: the columns named in carry, then n_words, n_removed, spans (removed, as word offsets), kept
    (words joined by one space). A new column whose name carry has gets underscores in front. Words are split at ASCII white
    space and unchanged.

    Levels: half the length (one anchor per window, so a quarter of the places), and only windows whose anchor recurs go on.
    From chosen places the length doubles as long as windows recur: a span that an earlier document has too is settled as a
    whole, so a long copied run costs few rows. What is left is decided at ``words`` words, window by window: a window inside
    a settled span has an earlier document, and in the earliest document that has it, it is in none; so no source is missed.
    Texts that an earlier document has as a whole are settled by digest first, and take no part in the levels.

    Null texts are empty and keep no words. Rows with a null doc_id lose nothing and remove nothing. Rows that repeat a
    doc_id don't remove from one another, as neither id is smaller. Texts under ``words`` words lose nothing. Very long texts
    are read whole, one at a time. Columns not in carry are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    every = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(carry)), F.col("doc_id").cast("long"), F.col("text").alias("__text"), F.xxhash64("text").alias("tag"))
    # a text with enough words has so many characters at least
    named = every.select("doc_id", F.col("__text").alias("text"), "tag").where("doc_id is not null").where(F.length("text") >= 2 * words - 1)

    digest = named.select("doc_id", "tag", F.unhex(F.md5("text")).alias("md5"))
    same = scratch.write(_recurring(digest, ["md5"]).select("md5", "lo"), "same")
    copies = scratch.write(digest.join(same, "md5").where("doc_id > lo").select("doc_id", "tag").distinct(), "copies")
    scratch.drop(same)

    first = scratch.write(named.mapInArrow(_first_level(words), "anchor long, doc_id long, tag long"), "anchors")
    # tables that grow with the documents are never broadcast, at any size
    repeated = scratch.write(_recurring(first, ["anchor"]).select("anchor"), "repeated")
    flagged = first.join(repeated.hint("merge"), "anchor").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors"))
    flagged = scratch.write(flagged.join(copies, ["doc_id", "tag"], "left_anti"), "flagged")
    scratch.drop(first, repeated)

    chosen = scratch.write(named.join(flagged, ["doc_id", "tag"]).mapInArrow(_choose(words), _CHOSEN), "chosen")
    settled = settled_spans(chosen, scratch, words)
    second = named.join(flagged.join(settled, ["doc_id", "tag"], "left"), ["doc_id", "tag"]).mapInArrow(_second_level(words), _SECOND)
    second = scratch.write(second, "windows")
    scratch.drop(flagged, chosen)
    source = scratch.write(_recurring(second, ["h1", "h2"]).select("h1", "h2", "lo"), "sources")
    covered = second.select("doc_id", "tag", "pos", "h1", "h2").join(source.hint("merge"), ["h1", "h2"]).where("doc_id > lo")
    covered = scratch.write(covered.groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("at")), "covered")
    scratch.drop(second, source)

    spans = covered.join(settled, ["doc_id", "tag"], "full").join(copies.withColumn("__copy", F.lit(True)), ["doc_id", "tag"], "full")
    both = every.where("doc_id is not null").join(spans.withColumnsRenamed({"at": "__at", "settled": "__settled"}), ["doc_id", "tag"], "left")
    both = both.unionByName(every.where("doc_id is null"), allowMissingColumns=True)
    own = [f"__{i}" for i in range(len(carry))]
    schema = "".join(f"{c} {every.schema[c].dataType.simpleString()}, " for c in own) + ", ".join(f"__new_{x}" for x in _OUT.split(", "))
    out = both.select(*own, "__text", "__at", "__settled", "__copy").mapInArrow(_remove(words, len(own)), schema)
    fresh = [n for n, _ in _ARROW]
    return out.withColumnsRenamed(dict(zip([*own, *(f"__new_{n}" for n in fresh)], [*carry, *free_names(list(carry), *fresh)], strict=True)))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS p FROM w WHERE len(ws) >= 13)),
src AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
cov AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(generate_series(p, p + 12)) AS i FROM win JOIN src USING (k) WHERE doc_id > lo)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
