"""Named rule sets: the same pipeline with different gates, one dataclass."""

from dataclasses import dataclass, replace

# Text patterns of the short and the long annotation texts.
REPAIR = "dna repair|dna damage|double[- ]strand break|homologous recombination|mismatch repair|fanconi"
REPAIR_LONG = REPAIR + "|response to dna damage|nucleotide excision repair|base excision repair|non[- ]homologous end joining|genome stability|checkpoint"
PATHWAY = "p53|pi3k|akt|mtor|mapk|ras|wnt|notch|cell cycle|apoptosis|dna repair|fanconi"
PATHWAY_LONG = "p53|pi3k|akt|mtor|mapk|ras|wnt|tgf[- ]?beta|notch|hippo|jak[- ]stat|cell cycle|apoptosis|dna repair|dna damage|homologous recombination|mismatch repair|excisi?on repair|fanconi"
# Columns of population frequencies and of pathway texts (of a group the first that has a value).
POP_AF = ("gnomAD_AF", "GnomAD_Genome_AF", "Kaviar_AF", "EVS_MAF", "AF", "MAX_AF", "EXOME_MAX_AF")
POP_AF_EXOME = (
    "IG_AF", "MAX_AF", "gnomAD_Global_AF", "gnomAD_AFR_AF", "gnomAD_AMR_AF", "gnomAD_ASJ_AF", "gnomAD_EAS_AF", "gnomAD_FIN_AF", "gnomAD_NFE_AF", "gnomAD_OTH_AF", "gnomAD_SAS_AF",
    "1000G_Global_AF", "1000G_AFR_AF", "1000G_AMR_AF", "1000G_EAS_AF", "1000G_EUR_AF", "1000G_SAS_AF", "Kaviar_AF", "EVS_EA_MAF", "EVS_CA",
)
POP_AF_MERGED = ("INFO_AF", "ANN_gnomAD_AF", *POP_AF_EXOME, "EXOME_IG_AF", "EXOME_MAX_AF", "EXOME_gnomAD_Global_AF", "EXOME_1000G_Global_AF", "EXOME_Kaviar_AF")
TEXTS_EXOME = (("KEGG_Pathway",), ("GO_biological_process",), ("Function_description",), ("Disease_description",))
TEXTS_GENOME = (*TEXTS_EXOME, ("DisGeNET_disease",))
TEXTS_MERGED = tuple((f"EXOME_{c}", c) for (c,) in TEXTS_EXOME)


@dataclass(frozen=True)
class Dialect:
    """af_max, af_null_passes, acmg_snv: gates of a row. count_needs_pass: two carriers count only on a passing variant.
    global_counts: sum or max over families. score: "sum" of evidence, segregation and pathway, or "points" on five axes.
    cnv: how a segment makes a variant suspect: "as_of" (the last one to start, a loss), "containing" (the first around it, a
    pathogenic loss) or "never". germ_rows: presence of germline rows counts; segregation_overwrites: weaker rules win.
    roh: least homozygous and greatest heterozygous share of a homozygous run that counts as high; None: no limit. roh_pick:
    "any" run around a place, or "as_of" the last one to start. cancer: a carrier is affected by somatic rows of that locus
    ("row") or of any locus of the patient ("patient"). pop_af, pathway_texts, consequence: columns of a raw table, the first
    that is there or has a value; no_consequence_passes: whether a table without any consequence column passes that gate."""

    name: str
    af_max: float
    af_null_passes: bool
    acmg_snv: tuple[int, ...]
    count_needs_pass: bool
    global_counts: str
    acmg_predisposition: tuple[int, ...] = (4, 5)
    score: str = "points"
    cnv: str = "never"
    roh: tuple[float, float | None] | None = None
    pathway: str = PATHWAY_LONG
    repair: str = REPAIR_LONG
    germ_rows: bool = True
    segregation_overwrites: bool = False
    roh_pick: str = "any"
    cancer: str = "patient"
    pop_af: tuple[str, ...] = POP_AF_EXOME
    pathway_texts: tuple[tuple[str, ...], ...] = TEXTS_EXOME
    consequence: tuple[str, ...] = ("EXOME_Consequence", "Consequence")
    no_consequence_passes: bool = True


GENOME = Dialect("genome", 0.05, False, (3, 4, 5), True, "sum", score="sum", cnv="as_of", roh=(0.5, None), pathway=PATHWAY, repair=REPAIR, roh_pick="as_of", cancer="row", pop_af=POP_AF, pathway_texts=TEXTS_GENOME, consequence=("Consequence",), no_consequence_passes=False)
MERGED = Dialect("merged", 0.01, True, (2, 3, 4, 5), False, "max", cnv="containing", roh=(0.95, 0.05), pop_af=POP_AF_MERGED, pathway_texts=TEXTS_MERGED, consequence=("Consequence", "EXOME_Consequence"))
EXOME = Dialect("exome", 0.01, True, (0, 3, 4, 5), True, "max", (3, 4, 5))
#: As older runs of two rule sets came out: germline presence never set; weaker segregation rules written over stronger ones.
GENOME_COMPAT = replace(GENOME, name="genome_compat", germ_rows=False)
MERGED_COMPAT = replace(MERGED, name="merged_compat", segregation_overwrites=True)
DIALECTS = {d.name: d for d in (GENOME, MERGED, EXOME, GENOME_COMPAT, MERGED_COMPAT)}
