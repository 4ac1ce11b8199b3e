"""URL filters: rules first; else host names are split into words by unigram Viterbi, and naive Bayes scores host and path tokens."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; of equally long ones the first by text. Null if none fits."""
    out = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = text.find("/")
        name, start = (text[:at], text[at:]) if at >= 0 else (text, "")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; numbers count by their length alone."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike(r"^\p{N}+$"), F.concat(F.lit("#"), F.length(w).cast("string"))).otherwise(w))


def rule_tokens(rules=RULES) -> list[str]:
    """Tokens that the rules themselves name: on pages that a rule decides they say which rule it was, and no more."""
    parts = [(text[: text.find("/")], text[text.find("/") :]) if "/" in text else (text, "") for text, _ in rules]
    hosts = {"host:" + w for host, _ in parts for w in re.split(r"[.\-_:@]+", host) if w}
    return sorted(hosts | {"path:" + w.lower() for _, path in parts for w in re.split(r"[^A-Za-z0-9]+", path) if w})


def segment(word: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """The likeliest split of ``word`` under unigram counts; known: (start, length) -> count. An unknown part of n letters has probability 10/(total*10^n)."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for (at, n), count in known.items():
        if count:
            ends.setdefault(at + n, []).append((n, math.log(count / total)))
    best, back = [0.0], [0]
    unknown = (0.0, 0)  # of all starts, the greatest best[at] + at * log(10): an unknown part from there to here
    for to in range(1, len(word) + 1):
        score, at = unknown[0] + math.log(10 / total) - to * math.log(10), unknown[1]
        for n, p in ends.get(to, ()):
            if (best[to - n] + p, n) > (score, to - at):
                score, at = best[to - n] + p, to - n
        best.append(score)
        back.append(at)
        unknown = max(unknown, (score + to * math.log(10), to), key=lambda u: u[0])
    out, to = [], len(word)
    while to:
        out.append(word[back[to] : to])
        to = back[to]
    return out[::-1]


#: Words of at most so many letters are looked up whole; longer ones by so many first letters, and then compared.
SHORT = 24


def segmented(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(label, words) of distinct labels. Substrings meet the word counts in joins, so the word list is never sent to tasks.

    A label has a row for each place and each of at most SHORT lengths of short words, and one for each place where a long word may
    begin; rows carry a digest in place of a long label. So a label of m letters makes at most (SHORT + 1) * m short rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [segment(r["label"], {(k["at"], k["n"]): k["c"] for k in r["known"] or ()}, total) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["label"] for r in rows], pa.string()), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    named = F.when(F.length("label") <= 40, F.col("label")).otherwise(F.concat(F.lit("#"), F.sha2("label", 256)))
    labels = labels.withColumn("id", named)
    starts = labels.select("id", "label", F.explode(F.sequence(F.lit(0), F.length("label") - 1)).alias("at"))
    starts = starts.select("id", "at", (F.length("label") - F.col("at")).alias("left"), F.substr("label", F.col("at") + 1, F.lit(SHORT)).alias("head"))
    subs = starts.select("id", "at", "head", F.explode(F.sequence(F.lit(1), F.length("head"))).alias("n")).select("id", "at", "n", F.substr("head", F.lit(1), F.col("n")).alias("word"))
    found = subs.join(counts.where(F.length("word") <= SHORT), "word").select("id", "at", "n", "c")
    heads = starts.where(F.col("left") > SHORT)
    long = counts.where(F.length("word") > SHORT).select("word", "c", F.length("word").alias("n"), F.substring("word", 1, SHORT).alias("head"))
    maybe = heads.join(long, "head").where("n <= left").join(labels, "id")
    found = found.unionByName(maybe.where(F.substr("label", F.col("at") + 1, F.col("n")) == F.col("word")).select("id", "at", "n", "c"))
    found = found.groupBy("id").agg(F.collect_list(F.struct("at", "n", "c")).alias("known"))
    return labels.join(found, "id", "left").select("label", "known").mapInArrow(run, "label string, words array<string>")


def held_out(page_id: Column) -> Column:
    """A fifth of the pages, by the digest of their ids."""
    return F.coalesce(F.crc32(page_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def url_filter(pages: DataFrame, rules=RULES, hold_out: bool = False) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, method (what naive Bayes says, also where a rule decides).

    Words for splitting come from all titles and paths, and from hyphenated parts of hosts. Naive Bayes is trained on all
    pages that a rule decides (add-one smoothing); it decides the rest, ties go to allow. Host words and path tokens are
    separate features; tokens that the rules name are none. With ``hold_out`` it is not trained on pages in held_out().

    Null urls, or those without "://", have empty host and path. Null and repeated page_ids stay; very long urls are split
    whole; other columns but html are ignored, and html may be null or absent; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    title = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), title.alias("title"))
    rows = scratch.write(rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "rows")
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in r]) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("verdict", verdicts[F.col("rule")])
    rows = rows.withColumn("decided", F.when(~held_out(F.col("page_id")), F.col("verdict")) if hold_out else F.col("verdict"))
    named = F.array(*map(F.lit, rule_tokens(rules))).cast("array<string>")

    hosts = scratch.write(rows.groupBy("host").agg(F.count_if(F.col("decided") == "allow").alias("allow"), F.count_if(F.col("decided") == "block").alias("block"), F.count("*").alias("n")), "hosts")
    paths = rows.select(F.transform(tokens_of(F.col("path")), lambda w: F.concat(F.lit("path:"), w)).alias("tokens"), "decided")
    paths = scratch.write(paths.groupBy("tokens").agg(F.count_if(F.col("decided") == "allow").alias("allow"), F.count_if(F.col("decided") == "block").alias("block"), F.count("*").alias("n")), "paths")

    parts = hosts.select(F.explode(F.filter(F.split("host", r"[.\-_:@]+"), lambda w: w != "")).alias("label")).distinct()
    hyphened = hosts.select(F.explode(F.filter(F.split("host", r"\."), lambda w: w.contains("-"))).alias("label"), "n").select(F.explode(F.split("label", "-")).alias("word"), "n")
    words = rows.select(F.explode(F.filter(tokens_of(F.col("title")), lambda w: ~w.startswith("#"))).alias("word"), F.lit(1).cast("long").alias("n"))
    words = words.unionByName(hyphened).unionByName(paths.select(F.explode("tokens").alias("word"), "n").select(F.substr("word", F.lit(6)).alias("word"), "n"))
    counts = scratch.write(words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("c")), "words")
    total = counts.agg(F.sum("c")).first()[0] or 1
    split = segmented(parts, counts, total).select("label", F.transform("words", lambda w: F.concat(F.lit("host:"), w)).alias("words"))
    by_host = hosts.select("host", F.explode(F.filter(F.split("host", r"[.\-_:@]+"), lambda w: w != "")).alias("label")).join(split, "label")
    by_host = scratch.write(by_host.select("host", F.explode(F.filter("words", lambda w: ~F.array_contains(named, w))).alias("token")), "host_tokens")
    by_path = paths.select("tokens", "allow", "block", F.explode(F.filter("tokens", lambda w: ~F.array_contains(named, w))).alias("token"))

    seen = by_host.join(hosts, "host").select("token", "allow", "block").unionByName(by_path.select("token", "allow", "block"))
    stats = scratch.write(seen.groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "stats")
    sums = stats.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0)), F.count("*")).first()
    prior = hosts.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    base = math.log((prior[1] + 1) / (prior[0] + 1))
    scale = math.log((sums[0] + sums[2] + 1) / (sums[1] + sums[2] + 1))
    stats = scratch.write(stats.select("token", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + F.lit(scale)).alias("llr")), "ratios")

    host_score = scratch.write(by_host.join(stats, "token").groupBy("host").agg(F.sum("llr").alias("host_llr")), "host_scores")
    path_score = scratch.write(by_path.join(stats, "token").groupBy("tokens").agg(F.sum("llr").alias("path_llr")), "path_scores")
    scored = rows.withColumn("tokens", F.transform(tokens_of(F.col("path")), lambda w: F.concat(F.lit("path:"), w)))
    scored = scored.select("page_id", "host", "path", "rule", "verdict", "tokens").join(host_score, "host", "left").join(path_score, "tokens", "left")
    score = F.round(F.lit(base) + F.coalesce("host_llr", F.lit(0.0)) + F.coalesce("path_llr", F.lit(0.0)), 9)
    scored = scored.withColumn("method", F.when(score > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", "method").alias("verdict"), "method")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path and rule alone, which SQL can express."""
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return pages.withColumn("rule", rule_of(F.col("host"), F.col("path")))


URL_RULES_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p
"""
