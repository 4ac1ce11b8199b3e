"""More named queries: sequences, texts, points, features, two-view vectors. They join those of queries.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S, texts as T
from .operators import aggregates as A, features as E, joins as J, sequences as Q, vectors as V
from .plans.dialect import GENOME, MERGED
from .plans.views import table
from .queries import QUERIES, SQL, WITH_V, chain_sql, families_of, on_variants, patients_of, query

SIZE, WIDTH, HALF = 300, 51, 20
GENOME_SQL = """WITH g AS (SELECT 'c' || item_id AS contig, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark),
x AS (SELECT contig, seq, unnest(generate_series(1, length(seq), 29)) AS pos FROM g),
v AS (SELECT contig, seq, pos, substr(seq, pos, CASE WHEN pos % 2 = 0 THEN 1 ELSE 3 END) AS ref, CASE pos % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'GATTACA' ELSE 'AC' END AS alt FROM x)"""


def _genome(spark, d):
    text = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return table(spark, d, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("contig"), F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC").alias("seq"))


def _loci(g):
    x = g.where("length(seq) > 0").select("contig", "seq", F.explode(F.sequence(F.lit(1).cast("long"), F.length("seq").cast("long"), F.lit(29).cast("long"))).alias("pos"))
    alt = F.when(F.col("pos") % 3 == 0, "T").when(F.col("pos") % 3 == 1, "GATTACA").otherwise("AC")
    return x.select("contig", "pos", F.substring("seq", F.col("pos"), F.when(F.col("pos") % 2 == 0, 1).otherwise(3)).alias("ref"), alt.alias("alt"))


@query("seq_window", GENOME_SQL + f""", w AS (SELECT *, CASE WHEN pos - 1 >= {WIDTH // 2} AND pos - 1 - {WIDTH // 2} + {WIDTH} <= length(seq) THEN substr(seq, pos - {WIDTH // 2}, {WIDTH}) END AS seq_ref FROM v)
 SELECT contig, pos, ref, alt, seq_ref, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN substr(seq_ref, 1, {WIDTH // 2}) || alt || substr(seq_ref, {WIDTH // 2 + 2})
 WHEN seq_ref IS NOT NULL THEN rpad(substr(seq_ref, 1, {WIDTH // 2}) || alt || substr(seq_ref, {WIDTH // 2 + 1} + length(ref)), {WIDTH}, 'N') END AS seq_alt FROM w""")  # fmt: skip
def _(spark, d):
    g = _genome(spark, d)
    return Q.centred_windows(_loci(g), Q.chunks(g, SIZE, WIDTH), SIZE, WIDTH).select("contig", "pos", "ref", "alt", "seq_ref", "seq_alt")


@query("seq_window_padded", GENOME_SQL + f""", w AS (SELECT *, greatest(pos - 1 - {HALF}, 0) AS l FROM v), u AS (SELECT *, substr(seq, l + 1, least(pos + {HALF}, length(seq)) - l) AS w FROM w),
 a AS (SELECT *, CASE WHEN substr(w, pos - l, length(ref)) = ref THEN substr(w, 1, pos - 1 - l) || alt || substr(w, pos - l + length(ref)) ELSE w END AS z, substr(w, pos - l, length(ref)) = ref AS ref_match FROM u)
 SELECT contig, pos, ref, alt, ref_match, rpad(repeat('N', CAST(floor(({2 * HALF + 1} - length(w)) / 2) AS BIGINT)) || w, {2 * HALF + 1}, 'N') AS seq_ref,
 rpad(repeat('N', CAST(floor(({2 * HALF + 1} - length(substr(z, 1, {2 * HALF + 1}))) / 2) AS BIGINT)) || substr(z, 1, {2 * HALF + 1}), {2 * HALF + 1}, 'N') AS seq_alt FROM a""")  # fmt: skip
def _(spark, d):
    g = _genome(spark, d)
    return Q.padded_windows(_loci(g), Q.chunks(g, SIZE, 2 * HALF + 1), SIZE, HALF).select("contig", "pos", "ref", "alt", "ref_match", "seq_ref", "seq_alt")


@query("seq_problems", "SELECT CASE WHEN text IS NULL THEN 'missing' WHEN text = '' THEN 'empty' WHEN length(text) > 512 THEN 'too long' WHEN regexp_matches(text, '[ \\t\\n\\r]') THEN 'spaces' WHEN NOT regexp_full_match(text, '[ACGTN]+') THEN 'alphabet' END AS problem, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(Q.problems(F.col("text")).alias("problem")).agg(F.count("*").alias("n"))


@on_variants("kb_fields", " SELECT DISTINCT concat_ws('; ', CASE WHEN pathway <> '.' THEN 'PATHWAY=' || CASE WHEN length(pathway) > 20 THEN substr(pathway, 1, 20) || '...' ELSE pathway END END, 'CLASS=' || CASE WHEN length(acmg_raw) > 20 THEN substr(acmg_raw, 1, 20) || '...' ELSE acmg_raw END) AS kb FROM variants")
def _(v):
    return v.select(T.summary(20, PATHWAY=F.col("pathway"), CLASS=F.col("acmg_raw")).alias("kb")).distinct()


@on_variants("ontology_tags", """, t AS (SELECT pathway, list_filter([CASE WHEN regexp_matches(lower(pathway), 'repair|recombination') THEN 'repair' END, CASE WHEN regexp_matches(lower(pathway), 'signal') THEN 'signalling' END, CASE WHEN regexp_matches(lower(pathway), 'cell cycle|apoptosis|cancer') THEN 'growth' END], lambda x: x IS NOT NULL) AS tags FROM variants)
 SELECT array_to_string(tags, ',') AS tags, coalesce(tags[1], 'other / unassigned') AS first, count(*) AS n FROM t GROUP BY ALL""")  # fmt: skip
def _(v):
    tags = T.category_tags(F.col("pathway"), {"repair": "repair|recombination", "signalling": "signal", "growth": "cell cycle|apoptosis|cancer"})
    return v.withColumn("t", tags).groupBy(F.array_join("t", ",").alias("tags"), F.coalesce(F.get("t", 0), F.lit("other / unassigned")).alias("first")).agg(F.count("*").alias("n"))


@on_variants("rule_prototypes", """, p AS (SELECT *, row_number() OVER (ORDER BY af, score, hit) - 1 AS rank FROM (VALUES (0.02::DOUBLE), (0.04), (0.06)) AS a(af), (VALUES (0.25::DOUBLE), (0.75)) AS b(score), (VALUES (20::DOUBLE)) AS c(hit)),
 d AS (SELECT ord_key, ord_line, (SELECT arg_min({'rank': rank, 'd2': d2}, (d2, rank)) FROM (SELECT rank, round(coalesce((pop_af - af) * (pop_af - af), 0) + (vaf - score) * (vaf - score) + (dp - hit) * (dp - hit), 9) AS d2 FROM p)) AS best FROM variants)
 SELECT ord_key, ord_line, CAST(best.rank AS INT) AS prototype, round(best.d2, 6) AS d2 FROM d""")  # fmt: skip
def _(v):
    rules = {"pop_af": {"min": 0.02, "max": 0.06}, "vaf": {"values": [0.25, 0.75]}, "dp": 20}
    best = v.select("ord_key", "ord_line", T.nearest_prototype(rules).alias("p"))
    return best.select("ord_key", "ord_line", F.col("p.rank").alias("prototype"), F.round("p.d2", 6).alias("d2"))


@on_variants("view_assembly", """, k AS (SELECT family_id, pos, tx, arg_min(dp, (ord_key, ord_line)) AS dp FROM variants GROUP BY ALL), t AS (SELECT family_id, pos, tx, arg_min(pathway, (ord_key, ord_line)) AS pathway FROM variants WHERE vaf > 0.5 GROUP BY ALL)
 SELECT k.*, pathway FROM k LEFT JOIN t USING (family_id, pos, tx)""")  # fmt: skip
def _(v):
    keys, order = ["family_id", "pos", "tx"], ["ord_key", "ord_line"]
    left = J.keep_first(v.select(*keys, "dp", *order), keys, order).drop(*order)
    return left.join(J.keep_first(v.where("vaf > 0.5").select(*keys, "pathway", *order), keys, order).drop(*order), keys, "left")


@on_variants("somatic_collapse", ", r AS (SELECT patient_id, chrom, pos, ref, alt, tx, ord_line % 2 AS run, count(*) AS n, max(dp) AS dp, max(vaf) AS vaf FROM variants WHERE origin = 'somatic' GROUP BY ALL) SELECT patient_id, chrom, pos, ref, alt, tx, CAST(sum(n) AS BIGINT) AS repeats, count(*) AS n_runs, max(dp) AS dp_som, max(vaf) AS vaf_som FROM r GROUP BY ALL")
def _(v):
    return A.collapse_runs(v.where("origin = 'somatic'"), F.col("ord_line") % 2)


@query("class_ge3_unique", f"{WITH_V}{chain_sql(MERGED)} SELECT chrom, pos, ref, alt, tx, string_agg(DISTINCT family_id || ':' || patient_id, ',' ORDER BY family_id || ':' || patient_id) AS carriers, max(evidence) AS class FROM patients WHERE evidence >= 3 GROUP BY ALL")
def _(spark, d):
    p = patients_of(spark, d, MERGED).where("evidence >= 3")
    return p.groupBy(*A.LOCUS).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "family_id", "patient_id"))), ",").alias("carriers"), F.max("evidence").alias("class"))


@query("labels", f"{WITH_V}{chain_sql(GENOME)} SELECT count_ge_2 AS label, CASE integrated_class WHEN 'LOW' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'TOP' THEN 3 ELSE -1 END AS class, count(*) AS n FROM families GROUP BY ALL")
def _(spark, d):
    c = F.col("integrated_class")
    level = F.when(c == "LOW", 0).when(c == "MODERATE", 1).when(c == "HIGH", 2).when(c == "TOP", 3).otherwise(-1)
    return families_of(spark, d, GENOME).groupBy(F.col("count_ge_2").alias("label"), level.alias("class")).agg(F.count("*").alias("n"))


@on_variants("best_ref_per_variant", " SELECT pos, max(dp * vaf) AS score, arg_max(ord_key, (dp * vaf, ord_key)) AS ref_id FROM variants GROUP BY 1")
def _(v):
    s = F.col("dp") * F.col("vaf")
    return v.groupBy("pos").agg(F.max(s).alias("score"), F.max_by("ord_key", F.struct(s, F.col("ord_key"))).alias("ref_id"))


@query("hash_sample")
def _(spark, d):
    return E.hash_sample(table(spark, d, "labels"), "doc_id", 50, 7)


@on_variants("multi_hot", " SELECT consequence, CAST(contains(consequence, 'missense_variant') AS INT) AS has_missense_variant, CAST(contains(consequence, 'intron_variant') AS INT) AS has_intron_variant, count(*) AS n FROM variants GROUP BY ALL")
def _(v):
    hot = E.multi_hot(F.col("consequence"), ["missense_variant", "intron_variant"])
    return v.groupBy("consequence", *(c.alias(n) for n, c in hot.items())).agg(F.count("*").alias("n"))


@query("tfidf_cosine", f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{T.WORD}') AS ws FROM benchmark), t AS (SELECT item_id, unnest(ws) AS term FROM w UNION ALL SELECT item_id, ws[p] || ' ' || ws[p + 1] FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 1)) AS p FROM w)),
 c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL), k AS (SELECT term, count(*) AS df FROM c GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 5000), r AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM c JOIN k USING (term)),
 u AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM r) SELECT a.item_id AS i, b.item_id AS j, round(sum(a.w * b.w), 6) AS sim FROM u a JOIN u b ON a.term = b.term AND a.item_id < b.item_id GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return T.sparse_cosine_all(T.tfidf(table(spark, d, "benchmark"), "item_id", "text"), "item_id").withColumn("sim", F.round("sim", 6))


@on_variants("weighted_jaccard", """, s AS (SELECT pos, list(DISTINCT origin) FILTER (WHERE vaf > 0.5) AS a1, list(DISTINCT origin) FILTER (WHERE dp > 20) AS b1, list(DISTINCT tx) FILTER (WHERE vaf > 0.5) AS a2, list(DISTINCT tx) FILTER (WHERE dp > 20) AS b2 FROM variants GROUP BY 1)
 SELECT pos, round((len(list_intersect(coalesce(a1, []), coalesce(b1, []))) / len(list_distinct(list_concat(a1, b1))) + 0.5 * len(list_intersect(coalesce(a2, []), coalesce(b2, []))) / len(list_distinct(list_concat(a2, b2)))) / 1.5, 6) AS jaccard FROM s""")  # fmt: skip
def _(v):
    some = F.col("vaf") > 0.5
    s = v.groupBy("pos").agg(F.collect_set(F.when(some, F.col("origin"))).alias("a1"), F.collect_set(F.when(F.col("dp") > 20, F.col("origin"))).alias("b1"), F.collect_set(F.when(some, F.col("tx"))).alias("a2"), F.collect_set(F.when(F.col("dp") > 20, F.col("tx"))).alias("b2"))
    return s.select("pos", F.round(T.weighted_jaccard([(F.col("a1"), F.col("b1"), 1.0), (F.col("a2"), F.col("b2"), 0.5)]), 6).alias("jaccard"))


TWO = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.label AS block, a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.v[1:32], b.v[33:64]), 9) AS sim FROM e a JOIN e b ON a.label = b.label)"


def _views(spark, d, part, by=None):
    return V.two_view_rows(table(spark, d, "embeddings"), "vec_id", F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), by=by, parts=(part,))


def _recalls():
    return [F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"recall_{k}") for k in (1, 5, 10)]


@query("infonce_by_label", TWO + ", l AS (SELECT block, i, ln(sum(exp(sim / 0.07))) - max(sim / 0.07) FILTER (WHERE i = j) AS l FROM p GROUP BY 1, 2 UNION ALL SELECT block, j, ln(sum(exp(sim / 0.07))) - max(sim / 0.07) FILTER (WHERE i = j) FROM p GROUP BY 1, 2) SELECT block, round(avg(l), 6) AS loss FROM l GROUP BY 1")
def _(spark, d):
    return _views(spark, d, "loss", "label").groupBy(F.col("block").cast("int").alias("block")).agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("recall_at_k_by_label", TWO + ", r AS (SELECT block, i, j, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM p UNION ALL SELECT block, i, j, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) FROM p) SELECT block, " + ", ".join(f"round(avg(CAST(r <= {k} AS INT)), 6) AS recall_{k}" for k in (1, 5, 10)) + " FROM r WHERE i = j GROUP BY 1")
def _(spark, d):
    return _views(spark, d, "rank", "label").groupBy(F.col("block").cast("int").alias("block")).agg(*_recalls())


TWO_ALL = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.v[1:32], b.v[33:64]), 9) AS sim FROM e a, e b)"


@query("infonce", TWO_ALL + ", l AS (SELECT ln(sum(exp(sim / 0.07))) - max(sim / 0.07) FILTER (WHERE i = j) AS l FROM p GROUP BY i UNION ALL SELECT ln(sum(exp(sim / 0.07))) - max(sim / 0.07) FILTER (WHERE i = j) FROM p GROUP BY j) SELECT round(avg(l), 6) AS loss FROM l")
def _(spark, d):
    return _views(spark, d, "loss").agg(F.round(F.avg("loss"), 6).alias("loss"))


@query("recall_at_k", TWO_ALL + ", r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM p UNION ALL SELECT i, j, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) FROM p) SELECT " + ", ".join(f"round(avg(CAST(r <= {k} AS INT)), 6) AS recall_{k}" for k in (1, 5, 10)) + " FROM r WHERE i = j")
def _(spark, d):
    return _views(spark, d, "rank").agg(*_recalls())


@query("field_pool", "SELECT vec_id, p - 1 AS place, round((CAST(embedding[p] AS DOUBLE) + 1.5 * (vec_id % 2) * CAST(embedding[65 - p] AS DOUBLE)) / (1 + 1.5 * (vec_id % 2) + 1e-8), 6) AS x FROM embeddings, generate_series(1, 64) AS s(p)")
def _(spark, d):
    pooled = V.field_pool([(F.col("embedding"), F.lit(True), 1.0), (F.reverse("embedding"), F.col("vec_id") % 2 == 1, 1.5)])
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(pooled).alias("place", "x")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("mutation_features", """WITH e AS (SELECT vec_id, p, CAST(embedding[p] AS DOUBLE) AS r, CAST(embedding[p + 32] AS DOUBLE) AS a FROM embeddings, generate_series(1, 32) AS s(p)),
 f AS (SELECT vec_id, p - 1 AS place, r AS x FROM e UNION ALL SELECT vec_id, p + 31, a FROM e UNION ALL SELECT vec_id, p + 63, a - r FROM e UNION ALL SELECT vec_id, p + 95, abs(a - r) FROM e UNION ALL SELECT vec_id, p + 127, a * r FROM e) SELECT vec_id, place, round(x, 6) + 0.0 AS x FROM f""")  # fmt: skip
def _(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode(V.mutation_features(F.slice(e, 1, 32), F.slice(e, 33, 32))).alias("place", "x"))
    return t.select("vec_id", F.col("place").cast("long").alias("place"), (F.round("x", 6) + 0.0).alias("x"))


@query("block_diffusion", "WITH m AS (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS x FROM embeddings, generate_series(1, 64) AS s(p) GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sum((a.x - b.x) * (a.x - b.x)), 6) AS d2 FROM m a JOIN m b ON a.p = b.p AND a.label < b.label GROUP BY ALL")
def _(spark, d):
    return V.centroid_distances(table(spark, d, "embeddings"), "label", "embedding").withColumn("d2", F.round("d2", 6))


@query("diffusion_intra")
def _(spark, d):
    return V.hierarchical_diffusion(table(spark, d, "embeddings"), "vec_id", "embedding")[0].withColumn("d2", F.round("d2", 6))


@query("diffusion_inter")
def _(spark, d):
    return V.hierarchical_diffusion(table(spark, d, "embeddings"), "vec_id", "embedding", 50)[1].withColumn("d2", F.round("d2", 6))


@query("classification_metrics", """WITH x AS (SELECT quality AS l, toxic AS p FROM labels), c AS (SELECT DISTINCT l AS c FROM x UNION SELECT p FROM x), s AS (SELECT c, (SELECT count(*) FROM x WHERE l = c) AS sup, (SELECT count(*) FROM x WHERE p = c) AS pre, (SELECT count(*) FROM x WHERE l = c AND p = c) AS tp FROM c),
 m AS (SELECT *, coalesce(tp / nullif(pre, 0), 0) AS pr, coalesce(tp / nullif(sup, 0), 0) AS re, coalesce(2 * tp / nullif(pre + sup, 0), 0) AS f FROM s)
 SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(f * sup) / sum(sup), 6) AS weighted_f1 FROM m""")  # fmt: skip
def _(spark, d):
    m = E.classification_metrics(table(spark, d, "labels"), "quality", "toxic")
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))

