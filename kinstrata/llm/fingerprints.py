"""Document fingerprints by order MinHash, in DataFrame functions alone: minimal occurrence-numbered k-mers, in text order, as hashed tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinstrata.operators.ordered import running

from .common import Scratch, free_names, table

# Tokens are stretches of at most TOKEN code points without white space; a k-mer is K tokens in a row.
TOKEN, K, TUPLE = 12, 2, 2
BIN_BITS = 6
BINS = 1 << BIN_BITS
_LOW32, _RANK = (1 << 32) - 1, (1 << (64 - BIN_BITS)) - 1
_STEPS = [1 << b for b in range(30, -1, -1)]


def _key(x: Column) -> Column:
    """The upper 32 bits of a packed number, without a sign."""
    return F.shiftrightunsigned(x, 32)


def _occurrence(s: Column, x: Column, i: Column) -> Column:
    """How many numbers just before place i of the sorted s have x's key, by doubling steps; without a search where the one before differs."""
    same = lambda back: (i >= back) & (_key(F.coalesce(F.get(s, (i - back).cast("int")), F.lit(0).cast("long"))) == _key(x))
    counted = F.aggregate(F.array(*(F.lit(b) for b in _STEPS)), F.lit(0), lambda t, b: F.when(same(t + b), t + b).otherwise(t))
    return F.when(same(F.lit(1)), counted).otherwise(F.lit(0))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with ``out``: an array of BINS ints, one for each bin of k-mers; 0 for a bin without a k-mer.

    Each occurrence of a k-mer gets a number, so repeats differ. A hash of k-mer and number gives a bin and a rank in it, so
    that one hash stands for BINS permutations, each on its own share of the k-mers. A bin's TUPLE least k-mers, in the order
    of the text, are hashed: moving a passage changes tuples though it changes no k-mer.

    All of it is arrays of the row itself: nothing is exploded or shuffled, and a text's arrays hold its tokens a few times
    over. The packed numbers hold 32 bits of a k-mer's hash and 32 of its place, so no text is too long. Equal texts have
    equal fingerprints. Null, empty and blank texts have no k-mer: all zeros. Fewer than K tokens are one k-mer.
    """
    a, b, c, d = free_names([*docs.columns, out], "k1", "k2", "k3", "k4")
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % TOKEN), F.lit(0))
    df = docs.withColumn(a, F.transform(tokens, lambda w: F.xxhash64(w)))
    first = F.slice(F.col(a), F.lit(1), F.greatest(F.size(a) - (K - 1), F.lit(1)))
    gram = lambda i: F.xxhash64(*(F.get(F.col(a), i + F.lit(j)) for j in range(K)))
    df = df.withColumn(b, F.sort_array(F.transform(first, lambda _, i: F.shiftleft(gram(i), 32).bitwiseOR(i.cast("long")))))
    numbered = F.transform(F.col(b), lambda x, i: F.xxhash64(_key(x), _occurrence(F.col(b), x, i)).bitwiseAND(F.lit(~_LOW32)).bitwiseOR(x.bitwiseAND(F.lit(_LOW32))))
    # the last number of each bin stands for its end, so that each bin has a first number
    ends = F.transform(F.sequence(F.lit(-(BINS >> 1)), F.lit((BINS >> 1) - 1)), lambda k: F.shiftleft(k.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(_RANK)))
    df = df.withColumn(c, F.sort_array(F.concat(numbered, ends)))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)

    def of_bin(x: Column, i: Column) -> Column:
        members = F.filter(F.slice(F.col(c), i + 1, TUPLE), lambda y: (bin_of(y) == bin_of(x)) & (y.bitwiseAND(F.lit(_RANK)) != F.lit(_RANK)))
        placed = F.sort_array(F.transform(members, lambda y: F.shiftleft(y, 32).bitwiseOR(_key(y))))
        return F.aggregate(placed, F.lit(0), lambda h, y: F.hash(h, y.bitwiseAND(F.lit(_LOW32))))

    begins = lambda x, i: (i == 0) | (bin_of(F.coalesce(F.get(F.col(c), i - 1), F.lit(0).cast("long"))) != bin_of(x))
    df = df.withColumn(d, F.filter(F.transform(F.col(c), lambda x, i: F.when(begins(x, i), of_bin(x, i))), lambda v: v.isNotNull()))
    return df.withColumn(out, F.col(d)).drop(a, b, c, d)


def likeness(a: str, b: str) -> Column:
    """The share of equal tuples among the bins that either has; 1 where neither has any, 0 where one fingerprint is null."""
    kinds = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    some, same = F.size(F.filter(kinds, lambda v: v > 0)), F.size(F.filter(kinds, lambda v: v > 1))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0)).when(some == 0, F.lit(1.0)).otherwise(same / some)


def as_text(a: str) -> Column:
    """A fingerprint as 8 hexadecimal digits a bin; dashes for a bin without k-mers."""
    return F.array_join(F.transform(F.col(a), lambda v: F.when(v == 0, F.lit("-" * 8)).otherwise(F.lower(F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(_LOW32))), 8, "0")))), "")


def following(ids: DataFrame, ranges: int = 256) -> DataFrame:
    """ids' rows, whose doc_id differ, with next_id: the next smaller doc_id; the greatest one after the smallest.

    Ids are dealt into ranges by approximate quantiles and sorted inside each; only a row a range is sorted in one place.
    """
    (at,) = free_names(ids.columns, "at")
    near = running(ids.withColumn(at, F.bitwise_not("doc_id")), [], at, [], ranges)
    greatest = F.broadcast(ids.agg(F.max("doc_id").alias("__greatest")))  # one row
    return near.crossJoin(greatest).select(*ids.columns, F.coalesce(F.bitwise_not("next"), "__greatest").alias("next_id"))


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_chars, fingerprint, head, next_fingerprint, next_text): head is a text without its last floor(n_chars / 2)
    code points, next_text what the next document, by descending doc_id, gives in their place.

    Whole texts move once, to meet the table of ids (who is next, and how many code points the one before needs); then heads
    and needed beginnings move once more, keyed by the document that they make up. Rows that repeat a doc_id have the same
    next document; what follows the next greater doc_id is the one of them with the least hash of its text. A null doc_id has
    no place in the order: no next document, and it is none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    h = F.xxhash64("text")
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg((F.max(F.length("text")) / 2).cast("long").alias("need"), F.min(h).alias("least"))
    ids = scratch.write(following(scratch.write(ids, "ids")), "following")
    before = ids.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "need")
    links = scratch.write(ids.select("doc_id", "least").join(before, "doc_id"), "links")

    def parts(rows: DataFrame) -> DataFrame:
        n = F.length("text")
        head, beginning = F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("text"), F.lit(1), F.col("need").cast("int"))
        return rows.select("doc_id", "text", F.when(h == F.col("least"), F.col("for_id")).alias("for_id"), n.cast("long").alias("n_chars"), head.alias("head"), beginning.alias("beginning"))

    # the work on a text's tokens follows these shuffles, so their partitions are not merged by bytes
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.where("doc_id is not null").repartition(spread, "doc_id").join(links, "doc_id")
    loose = docs.where("doc_id is null").withColumns({c: F.lit(None).cast("long") for c in ("least", "for_id", "need")})
    carried = scratch.write(fingerprints(parts(placed.unionByName(loose))).drop("text"), "carried")
    given = carried.where("for_id is not null").groupBy("for_id").agg(F.min(F.struct("beginning", "fingerprint")).alias("g"))
    given = given.select(F.col("for_id").alias("doc_id"), F.col("g.beginning").alias("beginning"), F.col("g.fingerprint").alias("next_fingerprint"))
    own = carried.select("doc_id", "n_chars", "fingerprint", "head")
    known = own.where("doc_id is not null").repartition(spread, "doc_id").join(given, "doc_id")
    rest = own.where("doc_id is null").withColumns({"beginning": F.lit(""), "next_fingerprint": F.lit(None).cast("array<int>")})
    return known.unionByName(rest).withColumn("next_text", F.substring(F.col("beginning"), F.lit(1), F.floor(F.col("n_chars") / 2).cast("int"))).drop("beginning")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(table(spark, sf_dir, "documents"), Scratch(spark, "fingerprints"))
    pairs = pairs.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.concat("head", "next_text").alias("edited"))
    out = fingerprints(pairs, "edited", "edited_fingerprint")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("fingerprint").alias("fingerprint"), as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def edited_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars and edited_sha256 of op12, which SQL can express."""
    return op12_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_DIGESTS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(text, 1, n - n // 2) || substring(after, 1, n // 2)) AS edited_sha256 FROM n
"""
