"""Named queries of views, encoders, texts, samples and two-view losses. They join those of queries.py."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import encoders as C, scalars as S, texts as T
from .operators import features as E, joins as J, vectors as V, walks as W
from .operators.clusters import lifetimes, members, spanning_tree
from .operators.setjoin import soft_target_loss
from .plans.columns import BINARY, NUMERIC
from .plans.dialect import EXOME, GENOME, MERGED
from .plans.views import segments, table, variants
from .queries import QUERIES, SIDES, WITH_V, on_variants, query


# ---- joins ----
@on_variants("full_outer_annotate", SIDES + """ SELECT coalesce(g.family_id, s.family_id) AS family_id, coalesce(g.patient_id, s.patient_id) AS patient_id, coalesce(g.pos, s.pos) AS pos, coalesce(g.tx, s.tx) AS tx,
 g.dp, g.vaf, s.note, CASE WHEN g.pos IS NULL THEN 'right' WHEN s.pos IS NULL THEN 'left' ELSE 'both' END AS source_set FROM g FULL JOIN s
 ON g.family_id = s.family_id AND g.patient_id = s.patient_id AND g.pos = s.pos AND g.tx IS NOT DISTINCT FROM s.tx""")  # fmt: skip
def _(v):
    v = v.withColumn("tx", F.when(F.col("tx") != "NM_0", F.col("tx")))
    keys = ["family_id", "patient_id", "pos", "tx"]
    calls = v.where("origin = 'germline'").groupBy(*keys).agg(F.max("dp").alias("dp"), F.max("vaf").alias("vaf"))
    notes = v.where("origin = 'somatic'").groupBy(*keys).agg(F.max("dp").alias("dp"), F.min("acmg_raw").alias("note"))
    return J.full_outer_annotate(calls, notes, keys)


@on_variants("group_max", " SELECT ord_key, ord_line, CAST(max(origin = 'somatic') OVER (PARTITION BY family_id, patient_id) AS INT) AS has_somatic FROM variants")
def _(v):
    rows = v.select("ord_key", "ord_line", "family_id", "patient_id", (F.col("origin") == "somatic").cast("int").alias("somatic"))
    return J.group_max(rows, ["family_id", "patient_id"], "somatic", "has_somatic").select("ord_key", "ord_line", "has_somatic")


@on_variants("one_to_one", " SELECT pos, max(dp) AS dp, max(vaf) FILTER (WHERE origin = 'somatic') AS vaf FROM variants GROUP BY 1 HAVING count(*) FILTER (WHERE origin = 'somatic') > 0")
def _(v):
    left = v.groupBy("pos").agg(F.max("dp").alias("dp"))
    return J.one_to_one(left, v.where("origin = 'somatic'").groupBy("pos").agg(F.max("vaf").alias("vaf")), "pos")


for _d in (GENOME, MERGED, EXOME):
    _high = "0" if _d.roh is None else f"CAST((seg_id % 21) / 20 >= {_d.roh[0]}" + (f" AND (seg_id % 5) / 50 <= {_d.roh[1]}" if _d.roh[1] is not None else "") + " AS INT)"
    _any = f"SELECT p.chrom, p.pos, {'0' if _d.roh is None else 'CAST(count(seg_id) > 0 AS INT)'} AS in_roh, coalesce(max({_high}), 0) AS high FROM p LEFT JOIN segments ON chrom = seg_chrom AND pos BETWEEN seg_start AND seg_end GROUP BY ALL"
    # of the runs that start up to a place the last one alone counts, whether others go on or not
    _last = f"""SELECT chrom, pos, CAST(coalesce(pos <= l.e, false) AS INT) AS in_roh, CASE WHEN pos <= l.e THEN l.h ELSE 0 END AS high
 FROM (SELECT p.chrom, p.pos, max({{'s': seg_start, 'e': seg_end, 'h': {_high}}}) FILTER (WHERE seg_id IS NOT NULL) AS l FROM p LEFT JOIN segments ON chrom = seg_chrom AND seg_start <= pos GROUP BY ALL)"""
    query(f"roh_flags_{_d.name}", f"{WITH_V}, p AS (SELECT DISTINCT chrom, pos FROM variants) {_last if _d.roh_pick == 'as_of' else _any}")(
        lambda spark, sf, d=_d: J.homozygous_runs(variants(spark, sf).select("chrom", "pos").distinct(), segments(spark, sf).withColumns({"phom": F.col("seg_id") % 21 / 20, "phet": F.col("seg_id") % 5 / 50}), d.roh, d.roh_pick))


@query("cnv_pathogenic", f"""{WITH_V}, s AS (SELECT seg_id, CASE seg_id % 4 WHEN 0 THEN 'Deletion_LOH' WHEN 1 THEN 'No_LOH' WHEN 2 THEN 'Possible_LOH' ELSE 'Unknown' END AS loh, CAST(seg_id % 7 >= 3 AND seg_id % 3 <> 0 AS INT) AS by_rank, CAST(seg_id % 2 = 0 AS INT) AS by_call FROM segments)
 SELECT seg_id, by_rank, by_call, CAST(loh IN ('Deletion_LOH', 'Possible_LOH') AND by_rank = 1 AS INT) AS suspect FROM s""")  # fmt: skip
def _(spark, d):
    i = F.col("seg_id")
    s = segments(spark, d).select("seg_id", F.element_at(F.array(*map(F.lit, ("Deletion_LOH", "No_LOH", "Possible_LOH", "Unknown"))), (i % 4 + 1).cast("int")).alias("loh"), F.when(i % 3 != 0, (i % 7).cast("string")).otherwise("3.5").alias("rank"), F.when(i % 2 == 0, "copy-neutral LOH").otherwise("gain").alias("call"))
    s = s.withColumns({"by_rank": S.pathogenic_rank(F.col("rank")), "by_call": S.pathogenic_call(F.col("call"))})
    return s.select("seg_id", "by_rank", "by_call", S.suspect_loss(F.col("loh"), F.col("by_rank")).alias("suspect"))


# ---- profiles, means, samples ----
DESCRIBED = ("family_id", "origin", "consequence", "dp", "pop_af", "pathway")


def _described_sql(having: str = "") -> str:
    kinds = {"dp": "double", "pop_af": "double"}
    one = " UNION ALL ".join(f"SELECT '{c}' AS name, '{kinds.get(c, 'string')}' AS dtype, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct FROM variants" for c in DESCRIBED)
    return f" SELECT * FROM ({one})" if not having else f" SELECT name, n_distinct FROM ({one}) WHERE {having}"


@on_variants("column_describe", _described_sql())
def _(v):
    out = E.describe(v.select(*DESCRIBED))
    return out.withColumn("dtype", F.when(F.col("dtype").isin("string"), "string").otherwise("double"))


@on_variants("low_variance", _described_sql("n_distinct < 6"))
def _(v):
    return E.low_variance(v.select(*DESCRIBED), 6)


@on_variants("top_values", """, c AS (SELECT 'gene_name' AS name, gene_name AS value, count(*) AS n FROM variants GROUP BY 2 UNION ALL SELECT 'consequence', consequence, count(*) FROM variants GROUP BY 2)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 5""")  # fmt: skip
def _(v):
    return E.top_values(v, ["gene_name", "consequence"], 5)


@on_variants("quality_rates", " SELECT round(avg(CAST(ref = 'A' AS INT)), 6) AS ref_a, round(avg(CAST(consequence = '.' AS INT)), 6) AS empty FROM variants")
def _(v):
    out = E.rates(v, ref_a=F.col("ref") == "A", empty=F.col("consequence") == ".")
    return out.select(F.round("ref_a", 6).alias("ref_a"), F.round("empty", 6).alias("empty"))


@on_variants("weighted_means", " SELECT family_id, round(sum(vaf * dp) / sum(dp), 6) AS vaf, round(sum(pop_af * dp) / sum(dp) FILTER (WHERE pop_af IS NOT NULL), 6) AS pop_af FROM variants GROUP BY 1")
def _(v):
    out = E.weighted_means(v, ["family_id"], ["vaf", "pop_af"], "dp")
    return out.select("family_id", F.round("vaf", 6).alias("vaf"), F.round("pop_af", 6).alias("pop_af"))


@on_variants("held_out_pattern", " SELECT pos, CASE WHEN max(CAST(regexp_matches(family_id, '[24]$') AS INT)) = 1 THEN 'test' ELSE 'train' END AS split FROM variants GROUP BY 1")
def _(v):
    t = v.groupBy("pos").agg(F.collect_set("family_id").alias("fams"))
    return E.held_out_families(t, F.col("fams"), pattern="[24]$").select("pos", "split")


@query("held_out_share")
def _(spark, d):
    t = variants(spark, d).groupBy("pos").agg(F.collect_set("family_id").alias("fams"))
    return E.held_out_families(t, F.col("fams"), share=0.4, seed=7).select("pos", "split")


@on_variants("worker_share", " SELECT ord_key, ord_line FROM variants WHERE ord_key % 4 = 1")
def _(v):
    return E.worker_share(v.select("ord_key", "ord_line"), "ord_key", 1, 4)


@query("uncorrelated")
def _(spark, d):
    v = variants(spark, d).withColumns({"dp_again": F.col("dp") * 2 + 1, "vaf_minus": -F.col("vaf")})
    return spark.createDataFrame([(c,) for c in E.uncorrelated(v, ["dp", "vaf", "dp_again", "pop_af", "vaf_minus"])], "kept string")


# ---- encoders ----
@on_variants("predictor_bits", """ SELECT ord_key, ord_line, CAST(vaf > 0.5 AS INT) AS sift_bin, CASE WHEN dp > 30 THEN 2.0 WHEN dp > 15 THEN 1.0 WHEN dp > 5 THEN 0.0 END AS polyphen_ord,
 CASE WHEN dp > 5 THEN dp / 50 END AS polyphen_score FROM variants""")  # fmt: skip
def _(v):
    poly = F.when(F.col("dp") > 30, "probably_damaging(").when(F.col("dp") > 15, "possibly_damaging(").when(F.col("dp") > 5, "benign(")
    sift = F.when(F.col("vaf") > 0.5, "Deleterious(0.01)").otherwise("tolerated(0.9)")
    text = F.concat(poly, (F.col("dp") / 50).cast("string"), F.lit(")"))
    return v.select("ord_key", "ord_line", C.mentions(sift, "deleterious").alias("sift_bin"), C.polyphen(text).alias("polyphen_ord"), S.predictor_score(text).alias("polyphen_score"))


@on_variants("severity_maps", """ SELECT acmg_raw, origin, consequence, CASE acmg_raw WHEN 'Pathogenic' THEN 4 WHEN 'Likely_pathogenic' THEN 3 WHEN 'Uncertain_significance' THEN 2 WHEN 'Likely_benign' THEN 1 ELSE 0 END AS impact,
 CASE origin WHEN 'germline' THEN 1 ELSE 2 END AS origin_num, CASE consequence WHEN 'missense_variant' THEN 1 WHEN 'stop_gained' THEN 2 ELSE 0 END AS variant_class, CASE consequence WHEN 'missense_variant' THEN 3 WHEN 'stop_gained' THEN 2 WHEN 'intron_variant' THEN 1 ELSE 0 END AS biotype,
 CAST(consequence IN ('missense_variant', 'intron_variant') AS INT) AS canonical, CASE consequence WHEN 'missense_variant' THEN 2 WHEN 'stop_gained' THEN 1 ELSE 0 END AS loss, count(*) AS n FROM variants GROUP BY ALL""")  # fmt: skip
def _(v):
    def put(col: str, values: dict[str, str], other: str | None = None):
        out = F.lit(other).cast("string")
        for k, x in values.items():
            out = F.when(F.col(col) == k, x).otherwise(out)
        return out

    impact = put("acmg_raw", {"Pathogenic": "high", "Likely_pathogenic": "MODERATE", "Uncertain_significance": " LOW", "Likely_benign": "MODIFIER"}, ".")
    kind, bio = put("consequence", {"missense_variant": "SNV", "stop_gained": "indel"}, "?"), put("consequence", {"missense_variant": "protein_coding", "stop_gained": "lncRNA", "intron_variant": "pseudogene"})
    can, loss = put("consequence", {"missense_variant": "YES", "intron_variant": "1"}, "no"), put("consequence", {"missense_variant": "LOH", "stop_gained": "partial_LOH"}, "neutral")
    cols = {"impact": C.impact(impact), "origin_num": C.origin(F.upper("origin")), "variant_class": C.variant_class(kind), "biotype": C.biotype(bio), "canonical": C.canonical(can), "loss": C.loss(loss)}
    return v.groupBy("acmg_raw", "origin", "consequence", *(c.alias(n) for n, c in cols.items())).agg(F.count("*").alias("n"))


@on_variants("unified_depth", " SELECT ord_key, ord_line, CASE WHEN ord_line % 2 = 0 THEN dp ELSE dp + 1 END AS dp_uni, CASE WHEN ord_line % 3 = 0 THEN vaf WHEN ord_line % 3 = 1 THEN vaf / 2 ELSE ord_line / nullif(dp + ord_line, 0) END AS vaf_uni FROM variants")
def _(v):
    line = F.col("ord_line")
    t = v.select("ord_key", "ord_line", F.when(line % 2 == 0, F.col("dp")).alias("DP"), (F.col("dp") + 1).alias("S1.DP"), F.when(line % 3 == 0, F.col("vaf")).alias("VAF"), F.when(line % 3 == 1, F.col("vaf") / 2).alias("S1.BAF"), F.concat_ws(",", F.col("dp").cast("string"), F.lit("0"), line.cast("string")).alias("S1.AD"))
    return C.unified_depth(t, "S1", 2).select("ord_key", "ord_line", "dp_uni", "vaf_uni")


@on_variants("family_list", " SELECT DISTINCT family_id, family_id || '|X' AS families FROM variants")
def _(v):
    cell = F.concat(F.col("family_id"), F.lit("; NA ,X|"), F.col("family_id"))
    return v.select("family_id", F.array_join(C.family_list(cell), "|").alias("families")).distinct()


@on_variants("allele_choice", " SELECT DISTINCT ref, alt, upper(alt) AS ref_used, upper(ref) AS alt_used, upper(ref) || ' ' || upper(alt) AS tokens FROM variants WHERE length(ref) = 1 AND length(alt) = 1")
def _(v):
    t = v.select("ref", "alt", F.col("alt").alias("allele_1"), F.col("ref").alias("allele_2")).distinct()
    return C.chosen_alleles(t, snv_only=True).select("ref", "alt", "ref_used", "alt_used", C.spaced(F.concat("ref", "alt")).alias("tokens"))


@on_variants("global_lists", " SELECT DISTINCT family_id AS FAMILY_ID_LIST_GLOBAL, '' AS PATIENT_ID_LIST_GLOBAL FROM variants")
def _(v):
    return C.global_lists(v.select(F.col("family_id").alias("FAMILY_ID_LIST"))).select("FAMILY_ID_LIST_GLOBAL", "PATIENT_ID_LIST_GLOBAL").distinct()


# ---- texts ----
@on_variants("kb_summary", """ SELECT DISTINCT acmg_raw, pathway, consequence, concat_ws('; ', 'HIGHEST=' || acmg_raw, CASE WHEN consequence <> '.' THEN 'LEVELS=LEVEL_1,LEVEL_3A' ELSE 'LEVELS=LEVEL_3A' END, CASE WHEN pathway <> '.' THEN 'EFFECT=' || pathway END) AS oncokb,
 concat_ws(' ; ', 'CancerGenomeInterpreter_Association=' || repeat('ab', 100) || '...', CASE WHEN pathway <> '.' THEN 'CancerGenomeInterpreter_Source=' || pathway END) AS cgi FROM variants""")  # fmt: skip
def _(v):
    t = v.select("acmg_raw", "pathway", "consequence").distinct().withColumns({
        "HIGHEST_LEVEL": F.col("acmg_raw"), "LEVEL_1": F.col("consequence"), "LEVEL_2": F.lit("No"), "LEVEL_3A": F.lit("x  y"), "MUTATION_EFFECT": F.col("pathway"),
        "CancerGenomeInterpreter_Association": F.repeat(F.lit("ab"), 101), "CancerGenomeInterpreter_Source": F.col("pathway"),
    })
    return t.select("acmg_raw", "pathway", "consequence", T.oncokb_summary(t).alias("oncokb"), T.listed(t, ("CancerGenomeInterpreter_Association", "CancerGenomeInterpreter_Drug", "CancerGenomeInterpreter_Source")).alias("cgi"))


def _annotated(v):
    return v.select("consequence", "acmg_raw", "pathway").distinct().select("*", F.col("pathway").alias("GO_biological_process"), F.concat_ws(";", "pathway", "pathway").alias("KEGG_Pathway"), F.col("consequence").alias("Function_description"), F.col("acmg_raw").alias("ClinVar_CLNSIG"))


@on_variants("text_views", """, t AS (SELECT DISTINCT consequence, acmg_raw, pathway, CASE WHEN pathway = '.' THEN '' ELSE array_to_string(list_transform(string_split_regex(pathway, '[;,|]+'), lambda x: trim(x)), '; ') END AS terms FROM variants)
 SELECT consequence, acmg_raw, pathway, concat_ws(' | ', CASE WHEN terms <> '' THEN 'GO_BP: ' || terms END, CASE WHEN terms <> '' THEN 'KEGG: ' || terms END) AS ontology_text,
 concat_ws(' | ', CASE WHEN consequence <> '.' THEN 'FUNCTION: ' || consequence END, 'CLINVAR_CLNSIG: ' || acmg_raw) AS clinical_text FROM t""")  # fmt: skip
def _(v):
    out = T.text_views(_annotated(v))
    return out.select("consequence", "acmg_raw", "pathway", F.col("ONTOLOGY_TEXT").alias("ontology_text"), F.col("CLINICAL_TEXT").alias("clinical_text"))


@on_variants("ontology_categories", """, t AS (SELECT DISTINCT pathway FROM variants), c AS (SELECT pathway, regexp_matches(lower(pathway), '\\b(pi3k|akt)\\b') AS s, regexp_matches(lower(pathway), '\\b(dna repair|cell cycle)\\b') AS d FROM t)
 SELECT pathway, CASE WHEN s AND d THEN '["signal transduction","DNA cycle/cell cycle"]' WHEN s THEN '["signal transduction"]' WHEN d THEN '["DNA cycle/cell cycle"]' ELSE '[]' END AS categories,
 CASE WHEN s THEN 'signal transduction' WHEN d THEN 'DNA cycle/cell cycle' ELSE 'other / unassigned' END AS first, CAST(s AS INT) AS is_signal, CAST(d AS INT) AS is_cycle FROM c""")  # fmt: skip
def _(v):
    out = T.ontology_categories(v.select("pathway", F.col("pathway").alias("GO_BP")).distinct())
    return out.select("pathway", F.col("ontology_categories").alias("categories"), F.col("primary_ontology_category").alias("first"), F.col("is_signal transduction").alias("is_signal"), F.col("is_DNA cycle/cell cycle").alias("is_cycle"))


@on_variants("term_sets", """, t AS (SELECT DISTINCT pathway, CASE WHEN pathway = '.' THEN [] ELSE list_transform(string_split_regex(pathway, '[;,|]+'), lambda x: trim(x)) END AS s FROM variants)
 SELECT pathway, array_to_string(s, '/') AS go_bp, len(s) AS n_kegg, 0 AS n_hpo FROM t""")  # fmt: skip
def _(v):
    out = T.text_views(_annotated(v))
    out = out.select("pathway", T.term_sets(out).alias("t")).distinct()
    return out.select("pathway", F.array_join("t.go_bp", "/").alias("go_bp"), F.size("t.kegg").cast("long").alias("n_kegg"), F.size("t.hpo").alias("n_hpo"))


# ---- views ----
def _user_table(v):
    """The variant view under the names that user tables have."""
    return v.select(
        F.col("family_id").alias("FAMILY_ID"), F.concat_ws(":", "chrom", "pos", "ref", "alt", "tx").alias("VARIANT_KEY"), F.col("pos").alias("POS"), F.col("dp").cast("string").alias("DP_GERM"), F.col("vaf").alias("VAF_SOM"), F.col("pop_af").alias("MAX_POP_AF"),
        F.col("consequence").alias("Consequence"), F.col("origin").alias("ORIGIN"), (F.col("vaf") > 0.5).cast("int").cast("string").alias("GERM_PASS"), F.when(F.col("dp") > 25, "HIGH").otherwise("LOW").alias("IMPACT"), F.col("dp").alias("S1.DP"), "ord_key", "ord_line")


CONS_SQL = "CASE consequence WHEN '.' THEN 0 WHEN 'stop_gained' THEN 5 WHEN 'splice_donor_variant&intron_variant' THEN 5 WHEN 'missense_variant' THEN 4 WHEN 'synonymous_variant' THEN 2 ELSE 1 END"
NUMERIC_SQL = {"DP_GERM": "dp", "VAF_SOM": "vaf", "MAX_POP_AF": "coalesce(pop_af, 0)", "Consequence_num": CONS_SQL, "Impact_num": "CASE WHEN dp > 25 THEN 4 ELSE 2 END", "Origin_num": "CASE origin WHEN 'germline' THEN 1 ELSE 2 END"}
HOT_SQL = {
    "Consequence": ("consequence", (".", "intron_variant", "missense_variant", "splice_donor_variant&intron_variant", "stop_gained", "synonymous_variant")), "IMPACT": ("CASE WHEN dp > 25 THEN 'HIGH' ELSE 'LOW' END", ("HIGH", "LOW")), "ORIGIN": ("origin", ("germline", "somatic")),
}


@on_variants("numeric_view", " SELECT family_id AS \"FAMILY_ID\", concat_ws(':', chrom, pos, ref, alt, tx) AS \"VARIANT_KEY\", pos AS \"POS\", "
             + ", ".join(f'CAST({NUMERIC_SQL.get(c, 0)} AS DOUBLE) AS "{c}"' for c in NUMERIC) + ", " + ", ".join(f'CAST({"vaf > 0.5" if c == "GERM_PASS" else 0} AS INT) AS "{c}"' for c in BINARY)
             + ", " + ", ".join(f"CAST({e} = '{x}' AS INT) AS \"{c}_{x}\"" for c, (e, xs) in HOT_SQL.items() for x in xs) + " FROM variants")
def _(v):
    t = _user_table(v).drop("ord_key", "ord_line")
    return E.numeric_view(t, {c: list(xs) for c, (_, xs) in HOT_SQL.items()})


@on_variants("feature_matrix", ", m AS (SELECT median(pop_af) AS m FROM variants) SELECT ord_key, ord_line, CAST(dp AS FLOAT) AS \"DP_GERM\", CAST(coalesce(pop_af, m) AS FLOAT) AS \"MAX_POP_AF\", "
             + ", ".join(f"CAST(contains(consequence, '{t}') AS FLOAT) AS \"CONS__{t}\"" for t in E.CONSEQUENCES)
             + ", CAST(dp > 25 AS FLOAT) AS \"IMPACT_HIGH\", CAST(dp <= 25 AS FLOAT) AS \"IMPACT_LOW\", CAST(0 AS FLOAT) AS \"IMPACT_OTHER\" FROM variants, m")
def _(v):
    return E.feature_matrix(_user_table(v), ["ord_key", "ord_line"], ["DP_GERM", "MAX_POP_AF", "absent"])


# ---- two-view losses ----
RIGHT = "p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, round(list_cosine_similarity(a.v[1:32], b.v[33:64]), 9) / 0.07 AS x, {terms} AS s FROM e a, e b)"
E_SQL = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, ['t' || (vec_id % 7), 'u' || (vec_id % 3)] AS t FROM embeddings), "
JACCARD = "len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))"
LSE = "q AS (SELECT *, ln(sum(exp(x) ) OVER (PARTITION BY i)) AS li_lse, ln(sum(exp(x)) OVER (PARTITION BY j)) AS lj_lse FROM p)"


def _loss_sql(weight: str, back: str) -> str:
    """loss of contrastive_loss, from the SQL of the weight of a pair."""
    sums = f"w AS (SELECT *, {weight} AS w FROM q), t AS (SELECT *, sum(w) OVER (PARTITION BY i) AS wi FROM w), u AS (SELECT *, CASE WHEN wi > 0 THEN w / wi ELSE 0 END AS t FROM t)"
    ab = "(SELECT avg(l) FROM (SELECT sum(t * (li_lse - x)) AS l FROM u GROUP BY i))"
    if back == "own":
        ba = "(SELECT avg(l) FROM (SELECT coalesce(sum(w * (lj_lse - x)) / nullif(sum(w), 0), 0) AS l FROM u GROUP BY j))"
    elif back == "transposed":
        ba = "(SELECT avg(l) FROM (SELECT sum(t * (lj_lse - x)) AS l FROM u GROUP BY j))"
    else:
        ba = "(SELECT avg(l) FROM (SELECT coalesce(sum(t * (lj_lse - x)) / nullif(sum(t), 0), 0) AS l FROM u GROUP BY j))"
    return E_SQL + RIGHT.format(terms=JACCARD) + f", {LSE}, {sums} SELECT round({ab}, 5) AS loss_ab, round({ba}, 5) AS loss_ba, round(({ab} + {ba}) / 2, 5) AS loss"


def _seq():
    return F.slice("embedding", 1, 32)


def _bio():
    return F.slice("embedding", 33, 32)


def _tags():
    return F.array(F.concat(F.lit("t"), (F.col("vec_id") % 7).cast("string")), F.concat(F.lit("u"), (F.col("vec_id") % 3).cast("string")))


LOSSES = {
    "loss_supervised": ("CAST(li = lj AND i <> j AS INT)", "own", V.same_label, lambda: {"m": F.col("label")}),
    "loss_soft_terms": ("exp((CASE WHEN i = j THEN 0.7 ELSE 0.3 * s END) / 0.25)", "renormalised", V.soft_terms({"terms": 1.0}), lambda: {"terms": _tags()}),
    "loss_mixed_terms": ("CASE WHEN i = j THEN 0.5 ELSE 0.5 * s END", "renormalised", V.mixed_terms({"terms": 1.0}), lambda: {"terms": _tags()}),
    "loss_mixed_sources": ("CAST(i = j AS INT) + CAST(i % 50 = j % 50 AS INT) + 0.5 * CAST(li = lj AS INT) + 0.3 * (CASE WHEN i = j THEN 0 ELSE s END)", "transposed", V.mixed_sources({"terms": 1.0}), lambda: {"m": F.col("vec_id") % 50, "g": F.col("label"), "terms": _tags()}),
}
for _name, (_w, _back, _weights, _extra) in LOSSES.items():
    query(_name, _loss_sql(_w, _back))(
        lambda spark, d, w=_weights, x=_extra, b=_back: V.contrastive_loss(table(spark, d, "embeddings"), "vec_id", _seq(), _bio(), w, x(), back=b).select(*(F.round(c, 5).alias(c) for c in ("loss_ab", "loss_ba", "loss"))))

# where terms alone make the targets, these are rows of similar sets
for _name, _weight, _own in (("loss_soft_terms", lambda s: F.exp(0.3 * s / 0.25), math.exp(0.7 / 0.25)), ("loss_mixed_terms", lambda s: 0.5 * s, 0.5)):
    QUERIES[_name] = lambda spark, d, w=_weight, o=_own: soft_target_loss(table(spark, d, "embeddings"), "vec_id", _seq(), _bio(), _tags(), w, o).select(*(F.round(c, 5).alias(c) for c in ("loss_ab", "loss_ba", "loss")))


# labels, variants and terms at once: the targets of each are rows of similar sets too
_one = lambda c: F.array(c.cast("string"))
QUERIES["loss_supervised"] = lambda spark, d: soft_target_loss(table(spark, d, "embeddings"), "vec_id", _seq(), _bio(), _one(F.col("label")), lambda s: s, 0.0, back="own").select(*(F.round(c, 5).alias(c) for c in ("loss_ab", "loss_ba", "loss")))
QUERIES["loss_mixed_sources"] = lambda spark, d: soft_target_loss(
    table(spark, d, "embeddings"), "vec_id", _seq(), _bio(), [_one(F.col("vec_id") % 50), _one(F.col("label")), _tags()], [lambda s: s, lambda s: 0.5 * s, lambda s: 0.3 * s], 2.5, back="transposed").select(*(F.round(c, 5).alias(c) for c in ("loss_ab", "loss_ba", "loss")))


@query("three_view_loss")
def _(spark, d):
    out = V.three_view_loss(table(spark, d, "embeddings"), "vec_id", F.slice("embedding", 1, 20), F.slice("embedding", 21, 20), F.slice("embedding", 41, 20), V.own_partner)
    return out.select(*(F.round(c, 5).alias(c) for c in out.columns))


@query("recall_multi_positive", E_SQL + RIGHT.format(terms=JACCARD) + """, g AS (SELECT i, j, round(x * 0.07, 9) AS sim, i = j OR s >= 0.5 AS good FROM p), r AS (SELECT i AS k, 0 AS side, good, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM g
 UNION ALL SELECT j, 1, good, row_number() OVER (PARTITION BY j ORDER BY sim DESC, i) FROM g), m AS (SELECT k, side, min(r) FILTER (WHERE good) AS r FROM r GROUP BY 1, 2) SELECT """ + ", ".join(f"round(avg(CAST(r <= {k} AS INT)), 6) AS recall_{k}" for k in (1, 5, 10)) + " FROM m")  # fmt: skip
def _(spark, d):
    out = V.multi_positive_recall(table(spark, d, "embeddings"), "vec_id", _seq(), _bio(), _tags())
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("token_pool", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, p - 1 AS place, round((v[p] + (vec_id % 2) * v[p + 16] + v[p + 32]) / (2 + vec_id % 2), 6) AS mean, round(v[p], 6) AS first
 FROM e, generate_series(1, 16) AS s(p)""")  # fmt: skip
def _(spark, d):
    tokens = F.array(*(F.slice("embedding", 16 * k + 1, 16) for k in range(4)))
    mask = F.array(F.lit(1), (F.col("vec_id") % 2).cast("int"), F.lit(1), F.lit(0))
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(V.mean_pool(tokens, mask).alias("m"), V.first_token(tokens).alias("f"))).alias("place", "z"))
    return t.select("vec_id", F.col("place").cast("long").alias("place"), F.round("z.m", 6).alias("mean"), F.round(F.col("z.f").cast("double"), 6).alias("first"))


@query("distance_regulariser")
def _(spark, d):
    return W.table_regulariser(table(spark, d, "embeddings"), "vec_id", _seq(), _bio(), robust=True).select(F.round("mse", 5).alias("mse"))


@query("persistence")
def _(spark, d):
    tree = spanning_tree(table(spark, d, "embeddings"), "vec_id", "embedding")
    return lifetimes(tree).select("rank", F.round("death", 6).alias("death"))


@query("cluster_members", """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= 0.5),
 r AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.vec_id WHERE r.c < l.a) SELECT vec_id, min(c) AS cluster FROM r GROUP BY 1""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "embeddings")
    return members(e, "vec_id", spanning_tree(e, "vec_id", "embedding", most=0.5), 0.5)
