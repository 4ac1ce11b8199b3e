"""Periodic runs of words: a harmonic grid of (period, place) pairs, extended by binary search on prefix hashes, verified word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BASES, mix, shared_dir, slices, small_batches, table

POWER, LEAST, PAIRS = 4, 6, 1 << 20
SPACE = r"[\x20\x09-\x0D]+"


class Prefixes:
    """Prefix hashes of a sequence of numbers modulo 2**64; the hash of a window is compared with another's by shifting the earlier one."""

    _up = np.ones(1, np.uint64)

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        if len(Prefixes._up) < n + 1:
            size = 1 << max(12, n.bit_length())
            up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASES[0], np.uint64)]), dtype=np.uint64)
            if size <= 1 << 22:
                Prefixes._up = up
        else:
            up = Prefixes._up
        self.up = up
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(BASES[1])) * up[:n], dtype=np.uint64)])

    def equal(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the windows of ``length`` at ``at`` and at ``at + period`` have equal hashes."""
        s, to = self.sums, at + period
        return (s[at + length] - s[at]) * self.up[period] == s[to + length] - s[to]


def _grid(n: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place): for each period p up to n / power the places 0, 2p, 4p ..., about n/2 + n/4 + n/6 ... pairs in all, PAIRS or so at a time."""
    periods = np.arange(1, n // power + 1, dtype=np.int64)
    counts = (n - 2 * periods) // (2 * periods) + 1
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(periods):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        c = counts[lo:hi]
        p = np.repeat(periods[lo:hi], c)
        yield p, (np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)) * 2 * p
        lo = hi


def _extent(h: Prefixes, at: np.ndarray, period: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """For all pairs at once, how far words at ``at`` and ``at + period`` go on being equal (backwards: those before), at most ``most``."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = h.equal(at - mid if back else at, period, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _scan_runs(ids: np.ndarray, power: int, least: int) -> np.ndarray:
    """(start, length, period) by comparing the words of each period one by one: exact whatever the hashes are."""
    n, found = len(ids), []
    for p in range(1, n // power + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids[p:] == ids[:-p]).view(np.int8), [0]])))
        start, length = edge[::2], edge[1::2] - edge[::2] + p
        ok = length >= max(least, power * p)
        found.append(np.stack([start[ok], length[ok], np.full(int(ok.sum()), p)], 1))
    return _smallest(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of runs with the same words the one with the smallest period, by start, then period; the others' periods are its multiples."""
    runs = runs[np.lexsort([runs[:, 2], runs[:, 1], runs[:, 0]])]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[new]
    return runs[np.lexsort([runs[:, 2], runs[:, 0]])]


def find_runs(ids: np.ndarray, power: int = POWER, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs: maximal stretches with smallest period q, of at least ``least`` and ``power * q`` words, by start and period.

    Words q apart agree along length - q >= (power - 1) * q places, so for power >= 4 a place of the grid lies among
    them with q agreeing places after it. Such pairs are kept, one of neighbours in the same run, and extended both ways.
    The words of each run are compared at last; should a run's hashes have been wrong, every period is compared word by word.
    """
    if power < 4:
        raise ValueError("power must be at least 4")
    n = len(ids)
    if n < max(least, power):
        return np.zeros((0, 3), np.int64)
    h, found = Prefixes(ids), []
    for p, at in _grid(n, power):
        same = ids[at] == ids[at + p]
        p, at = p[same], at[same]
        same = h.equal(at, p, p)
        p, at = p[same], at[same]
        if not len(p):
            continue
        fresh = np.ones(len(p), bool)  # the place before in the grid belongs to the same run only if the words between agree
        fresh[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 2 * p[1:])
        fresh |= ~h.equal(np.maximum(at - p, 0), p, np.minimum(p, at))
        p, at = p[fresh], at[fresh]
        before = _extent(h, at, p, at, True)
        after = _extent(h, at, p, n - at - p, False)
        length = before + after + p
        ok = length >= np.maximum(least, power * p)
        found.append(np.stack([(at - before)[ok], length[ok], p[ok]], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = _smallest(np.concatenate(found))
    for start, length, q in runs.tolist():
        if not np.array_equal(ids[start : start + length - q], ids[start + q : start + length]):
            return _scan_runs(ids, power, least)
    return runs


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:n]) == 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _run_texts(keep: list[str], names: list[str], power: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, every, kept = [], [], []
                for raw in part.column("text").cast(pa.binary()).to_pylist():
                    words = raw.split() if raw else []
                    known: dict[bytes, int] = {}
                    runs = find_runs(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), power, least)
                    counts.append(len(words))
                    every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()])
                    if len(runs):
                        stays = collapsed(len(words), runs)
                        words = [w for w, s in zip(words, stays, strict=True) if s]
                    kept.append(b" ".join(words))
                new = [pa.array(counts, pa.int64()), pa.array(every, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, *names])

    return run


def periodic_runs(docs: DataFrame, keep: list[str] = ("doc_id",), power: int = POWER, least: int = LEAST, names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """docs' columns ``keep`` with n_words, runs (start, length, period; by start, then period) and the collapsed text, under ``names``.

    A run is a maximal stretch of words with smallest period q, of at least ``least`` and ``power * q`` words. The collapsed
    text has the words that no run contains after its first period, joined by one space. Words stand between ASCII white space.

    Each text is one row's own work, so no row meets another: repeated rows and doc_ids each get a row, null doc_ids too.
    Null and empty texts have no words, no runs and an empty collapsed text. Very long texts are read whole, one at a time;
    the grid has about n/2 * ln(n/4) pairs for n words and is taken a million pairs at a time. Other columns are
    ignored; names given in ``names`` must differ from ``keep``. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{names[0]}` long", f"`{names[1]}` array<struct<start:bigint,length:bigint,period:bigint>>", f"`{names[2]}` string"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_run_texts(list(keep), list(names), power, least), schema)


def _repeating(words: Column, g: Column) -> Column:
    """Words from a = g % n on become the original words from a on, again and again with period 1 + (n - a) div (3 + g % 8)."""
    n = F.size(words).cast("long")
    a = g % n
    p = F.lit(1).cast("long") + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    # one-element arrays name a value, so that it is computed once
    by = lambda w, a, p: F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
    return F.array_join(F.get(F.transform(F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"))), lambda v: by(v["w"], v["a"], v["p"])), 0), " ")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of doc_id, get a periodic end. A null doc_id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACE, -1), lambda w: w != "")
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, _repeating(w, F.floor(h / 10).cast("long"))).otherwise(F.lit(""))), 0)
    return docs.select(F.col("doc_id").cast("long"), F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("under"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = F.col("top.length"), -F.col("top.before"), -F.col("top.under")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.under").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
