"""Text summaries and tags as Column expressions, and TF-IDF as long tables."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.columns import CATEGORIES, CGI, CIVIC, CLINICAL, ONCOKB_LEVELS, ONTOLOGY, TITLES
from .scalars import na_if, split_terms

WORD = "[a-z0-9]{2,}"


def summary(most: int = 200, **fields: Column) -> Column:
    """"k=v; k=v" of the fields that aren't missing; values beyond ``most`` characters end in dots."""
    cut = lambda v: F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)
    return F.concat_ws("; ", *(F.when(na_if(v).isNotNull(), F.concat(F.lit(f"{k}="), cut(v))) for k, v in fields.items()))


def clean(c: Column) -> Column:
    """Trimmed, runs of white space as one blank; missing tokens are empty."""
    return F.coalesce(na_if(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))), F.lit(""))


def _field(df: DataFrame, name: str) -> Column:
    return clean(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def listed(df: DataFrame, keys: tuple[str, ...], most: int = 200) -> Column:
    """"k=v ; k=v" of the columns that df has and that aren't missing; values beyond ``most`` characters end in dots."""
    cut = lambda v: F.when(F.length(v) > most, F.concat(F.rtrim(F.substring(v, 1, most)), F.lit("..."))).otherwise(v)
    return F.concat_ws(" ; ", *(F.when(_field(df, k) != "", F.concat(F.lit(f"{k}="), cut(_field(df, k)))) for k in keys))


def oncokb_summary(df: DataFrame) -> Column:
    """"HIGHEST=...; LEVELS=...; ONCOGENIC=...; EFFECT=..." of what is there; a level counts if it is neither missing nor a no."""
    levels = F.array_join(F.filter(F.array(*(F.when(~_field(df, c).isin("", "0", "False", "false", "NO", "No"), c) for c in ONCOKB_LEVELS)), lambda x: x.isNotNull()), ",")
    parts = {"HIGHEST": _field(df, "HIGHEST_LEVEL"), "LEVELS": levels, "ONCOGENIC": _field(df, "ONCOGENIC"), "EFFECT": _field(df, "MUTATION_EFFECT")}
    return F.concat_ws("; ", *(F.when(v != "", F.concat(F.lit(f"{k}="), v)) for k, v in parts.items()))


def text_views(df: DataFrame, terms: int = 25) -> DataFrame:
    """Adds ONTO_* (at most ``terms`` terms each, joined by "; "), TXT_*, ONTOLOGY_TEXT and CLINICAL_TEXT. Absent columns are empty."""
    onto = {k: F.array_join(split_terms(F.col(f"`{c}`"), terms), "; ") if c in df.columns else F.lit("") for k, c in ONTOLOGY.items()}
    texts = {k: _field(df, c) for k, c in CLINICAL.items()} | {"CIVIC": listed(df, CIVIC), "CGI": listed(df, CGI), "ONCOKB": oncokb_summary(df)}
    out = df.withColumns({f"ONTO_{k}": v for k, v in onto.items()} | {f"TXT_{k}": v for k, v in texts.items()})
    block = lambda prefix, k: F.when(F.col(prefix + k) != "", F.concat(F.lit(f"{TITLES.get(k, k)}: "), F.col(prefix + k)))
    return out.withColumns({"ONTOLOGY_TEXT": F.concat_ws(" | ", *(block("ONTO_", k) for k in onto)), "CLINICAL_TEXT": F.concat_ws(" | ", *(block("TXT_", k) for k in texts))})


def term_sets(df: DataFrame, prefix: str = "ONTO_") -> Column:
    """A struct of the five term sets of a row."""
    return F.struct(*((split_terms(F.col(prefix + k)) if prefix + k in df.columns else F.array().cast("array<string>")).alias(k.lower()) for k in ONTOLOGY))


def ontology_categories(df: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ontology_text, ontology_categories (a JSON list), primary_ontology_category and a 0/1 column per category."""
    text = F.lower(F.concat_ws(" | ", *(na_if(F.col(prefix + c)) for c in ONTOLOGY if prefix + c in df.columns)))
    tags = category_tags(F.col("ontology_text"), {name: "|".join(p) for name, p in CATEGORIES.items()})
    out = df.withColumn("ontology_text", text).withColumn("__tags", tags)
    bits = {f"is_{name}": F.array_contains("__tags", name).cast("int") for name in CATEGORIES}
    return out.withColumns({"ontology_categories": F.to_json("__tags"), "primary_ontology_category": F.coalesce(F.get("__tags", F.lit(0)), F.lit("other / unassigned"))} | bits).drop("__tags")


def category_tags(text: Column, categories: dict[str, str]) -> Column:
    """Names of the categories whose pattern the lower-cased text has, in the order given; the first is the primary one."""
    return F.filter(F.array(*(F.when(F.lower(text).rlike(p), name) for name, p in categories.items())), lambda x: x.isNotNull())


def rule_values(rule, n: int = 3) -> list[float]:
    """A number, [lo, hi] or {value | values | min, max} as numbers; ranges give ``n`` evenly spaced ones."""
    if isinstance(rule, dict):
        if "value" in rule or "values" in rule:
            v = rule.get("values", rule.get("value"))
            return [float(x) for x in (v if isinstance(v, list) else [v])]
        rule = [rule["min"], rule["max"]]
    if not isinstance(rule, (list, tuple)):
        return [float(rule)]
    lo, hi = map(float, rule)
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)] if n > 1 else [lo]


def prototypes(spark: SparkSession, rules: dict, most: int = 64) -> DataFrame:
    """A row per combination of the rules' values, the first ``most`` in order."""
    rows = list(itertools.islice(itertools.product(*(rule_values(r) for r in rules.values())), most))
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in rules))


def nearest_prototype(rules: dict, most: int = 64) -> Column:
    """(rank, d2) of the prototype of the rules (the first ``most`` combinations of their values) that is nearest to a row's columns.

    Squared distances, rounded to 9 places, add up over the columns named in the rules; a null column adds nothing. Ties go to the first prototype, rank 0.
    """
    rows = list(itertools.islice(itertools.product(*(rule_values(r) for r in rules.values())), most))
    d2 = lambda row: sum((F.coalesce((F.col(c) - v) * (F.col(c) - v), F.lit(0.0)) for c, v in zip(rules, row, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*(F.struct(F.round(d2(row), 9).alias("d2"), F.lit(k).alias("rank")) for k, row in enumerate(rows))))


def tfidf(df: DataFrame, key: str, text: str, features: int = 5000) -> DataFrame:
    """(key, term, w): words and word pairs, the ``features`` most frequent (ties by term), tf * (ln((1 + n) / (1 + df)) + 1), of length 1."""
    words = df.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)).alias("ws"))
    pairs = F.when(F.size("ws") > 1, F.transform(F.arrays_zip(F.slice("ws", F.lit(1), F.size("ws") - 1).alias("a"), F.slice("ws", F.lit(2), F.size("ws") - 1).alias("b")), lambda x: F.concat_ws(" ", x.a, x.b)))
    counts = words.select(key, F.explode(F.concat("ws", F.coalesce(pairs, F.array().cast("array<string>")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    kept = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features).select("term", "df")
    n = df.agg(F.count("*").alias("n"))
    w = counts.join(F.broadcast(kept), "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, "term", "w")


def sparse_cosine(weights: DataFrame, key: str, block: Column) -> DataFrame:
    """(block, i, j, sim), i < j, for rows of a block that share a term; blocks bound the pairs."""
    a = weights.withColumn("block", block)
    b = a.select("block", F.col(key).alias("j"), "term", F.col("w").alias("v"))
    return a.join(b, ["block", "term"]).where(F.col(key) < F.col("j")).groupBy("block", F.col(key).alias("i"), "j").agg(F.sum(F.col("w") * F.col("v")).alias("sim"))


def sparse_cosine_all(weights: DataFrame, key: str, per_part: int = 1000) -> DataFrame:
    """(i, j, sim), i < j, for all rows that share a term. A term's rows are dealt into parts of about ``per_part`` and its parts meet in pairs."""
    parts = weights.groupBy("term").agg(F.ceil(F.count("*") / per_part).cast("int").alias("n"))
    t = weights.join(parts, "term").withColumn("part", F.pmod(F.xxhash64(key), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = t.select("term", F.col(key).alias("i"), F.col("w").alias("v"), F.col("part").alias("p"), every.alias("q"))
    b = t.select("term", F.col(key).alias("j"), F.col("w").alias("u"), F.col("part").alias("q"), every.alias("p"))
    return a.join(b, ["term", "p", "q"]).where("i < j").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("sim"))


def weighted_jaccard(pairs: list[tuple[Column, Column, float]]) -> Column:
    """Weighted mean of the Jaccard similarities of pairs of term sets; two empty sets have 0."""
    total = sum(w for *_, w in pairs)
    one = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    return sum((one(a, b) * w for a, b, w in pairs), F.lit(0.0)) / total
