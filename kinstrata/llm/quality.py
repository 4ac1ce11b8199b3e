"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk, minimised on trusted positives and unlabelled text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import shared_dir, slices, small_batches, table

FOLDS, THRESHOLD, SAMPLE = 5, 0.3, 20_000
CUTS = 200  # thresholds at which the class prior is looked for
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]


def features(text: str | None) -> np.ndarray:
    """What a text looks like as a whole: shares of kinds of bytes, repetition of words and lines, lengths. No words or languages."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, high = count[65:91].sum(), count[97:123].sum(), count[48:58].sum(), count[128:].sum()
    words = raw.split()
    k = max(1, len(words))
    seen = Counter(words)
    most = seen.most_common(5)
    lines = [x for x in raw.split(b"\n") if x]
    shares = np.concatenate([[upper, lower, digits, high, count[10], count[32]], count[_PUNCT]]) / n
    return np.concatenate([
        np.log1p(200 * shares),
        [len(seen) / k, np.log(len(seen) + 1) / np.log(k + 2), most[0][1] / k if most else 0.0, sum(c for _, c in most) / k, sum(map(eq, words, words[1:])) / k,
         len(set(lines)) / max(1, len(lines)), np.log1p(n / k), np.log1p(k), np.log1p(k / max(1, len(lines)))],
    ])


WIDTH = len(features(""))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk, negative part) of scores of positives and of unlabelled texts, with the logistic loss l.

    The negative part, E_U[l(-f)] - prior * E_P[l(-f)], estimates the risk on negatives; below 0 it counts as 0.
    """
    negative = float(np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean())
    return float(prior * np.logaddexp(0, -fp).mean()) + max(0.0, negative), negative


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, scale, weights, bias) of a logistic scorer that minimises ``risk``, by Adam on whole samples.

    Where the negative part is below 0, the step goes against its gradient, so that the scorer doesn't overfit the positives.
    """
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), every.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = np.hstack([p, p * p / 8]), np.hstack([u, u * u / 8])
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def sigma(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for t in range(1, steps + 1):
        fp, fu = p @ w + b, u @ w + b
        _, negative = risk(fp, fu, prior)
        gp, gu = prior * (sigma(fp) - 1) / len(p), sigma(fu) / len(u)
        gn = -prior * sigma(fp) / len(p)
        if negative >= 0:
            rows_p, rows_u = gp + gn, gu
        else:
            rows_p, rows_u = -gn, -gu
        g = np.concatenate([rows_p @ p + rows_u @ u + decay * w, [rows_p.sum() + rows_u.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return mean, scale, w, float(b)


def class_prior(held: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scores of both; no fit has seen the positives ``held``.

    At a cut that unlabelled texts pass as often as that share of the positives would, no negative passes: the prior is the least
    ratio of the two shares over the cuts, where the uncertainty of the counts is added before ratios are compared.
    """
    cuts = np.unique(np.quantile(held, np.linspace(0, 1, CUTS)))
    p = 1 - np.searchsorted(np.sort(held), cuts) / len(held)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    doubt = np.sqrt(np.log(40) / 2 / len(unlabelled)) + np.sqrt(np.log(40) / 2 / len(held))
    best = int(np.argmin((u + doubt) / p))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def score(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w, b = model
    z = np.clip((x - mean) / scale, -8, 8)
    return 1 / (1 + np.exp(-np.clip(np.hstack([z, z * z / 8]) @ w + b, -30, 30)))


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


_DRAWS = 1_000_000_000


def _sampled(docs: DataFrame, about: int, seed: int, most: int) -> np.ndarray:
    """Feature vectors of at most ``most`` rows of docs, which has ``about`` rows: those with the least hashes of doc_id and text.

    Rows that a share of the hashes rules out are dropped first, so that few texts are read and few vectors are sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("draw"), pa.array([features(t).tolist() for t in part.column("text").to_pylist()], pa.list_(pa.float64()))], ["draw", "x"])

    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(_DRAWS)).alias("draw"), "text")
    rows = rows.where(F.col("draw") < int(min(1.0, 1.2 * most / max(1, about)) * _DRAWS)).mapInArrow(run, "draw long, x array<double>")
    got = rows.orderBy("draw", "x").limit(most).toArrow().column("x")
    return np.array(got.to_pylist(), np.float64).reshape(len(got), WIDTH)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on at most ``sample`` trusted positives and as many unlabelled documents, drawn by hashes of ids and texts.

    Labels are used of rows out of the held-out fold alone, and of these quality 1 alone, as positives; the class prior comes from
    positives and unlabelled texts (a fit on half of the positives scores the other half). None if no positive is a document.
    Only feature vectors of the samples reach the driver.
    """
    known = labels.where("doc_id is not null and quality = 1").where(~held_out("doc_id")).select(F.col("doc_id").cast("long")).distinct()
    ones = known.count()
    if not ones:
        return None
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    # at most ``sample`` ids, so that they are sent to the documents and no text is shuffled
    draw = F.xxhash64("doc_id", F.lit(9))
    ids = known.orderBy(draw, "doc_id").limit(sample)
    positive = _sampled(docs.join(F.broadcast(ids), "doc_id", "left_semi"), min(ones, sample), 9, sample)
    unlabelled = _sampled(docs, docs.count(), 10, sample)
    if not len(positive) or not len(unlabelled):
        return None
    prior = 0.5
    if len(positive) >= 20:
        first = fit_nnpu(positive[::2], unlabelled, prior, steps=150)
        prior = class_prior(score(positive[1::2], first), score(unlabelled, first))
    return fit_nnpu(positive, unlabelled, prior)


def quality_scores(docs: DataFrame, model, keep: list[str] = (), name: str = "score") -> DataFrame:
    """docs' columns ``keep`` with the score as ``name``; a null text is empty; without a model each score is 0.5. Whole texts are read."""
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                s = score(np.array([features(t) for t in texts]).reshape(len(texts), WIDTH), model) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], [*keep, name])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Null and repeated doc_ids stay (a null one is not held out); null texts are empty; very long texts are read whole, one at
    a time; other columns are ignored; an empty table gives no rows; labels of no known document have no effect.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = quality_scores(docs, train(docs, labels, sample), ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    small_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
