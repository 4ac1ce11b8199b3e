"""Names of columns and terms that user tables have: what readers, encoders and views look for."""

# Columns of the numeric view.
NUMERIC = (
    "QUAL", "DP_GERM", "VAF_GERM", "DP_SOM", "VAF_SOM", "DP_UNI", "VAF_UNI",
    "IG_AF", "EVS_EA_MAF", "1000G_Global_AF", "gnomAD_Global_AF", "Kaviar_AF", "MAX_AF", "MAX_POP_AF", "GnomAD_MNV_AF",
    "1000G_AFR_AF", "1000G_AMR_AF", "1000G_EAS_AF", "1000G_EUR_AF", "1000G_SAS_AF", "1000G_AA_AF", "1000G_EA_AF",
    "gnomAD_AFR_AF", "gnomAD_AMR_AF", "gnomAD_ASJ_AF", "gnomAD_EAS_AF", "gnomAD_FIN_AF", "gnomAD_NFE_AF", "gnomAD_OTH_AF", "gnomAD_SAS_AF",
    "PhyloP", "PhastCons", "Distance_Grantham", "MaxEntScan_alt", "MaxEntScan_diff", "MaxEntScan_ref", "ada_score", "rf_score",
    "DANN_Score", "FATHMM_Non_Coding_Score", "FATHMM_Coding_Score", "Gene_damage_index",
    "SIFT_score", "PolyPhen_ord", "PolyPhen_score", "Consequence_num", "Impact_num", "VariantClass_num", "Biotype_num", "Canonical_num", "Origin_num", "CNV_LOH_status_num",
    "N_PATIENTS_WITH_VARIANT", "N_CANCER_WITH_VARIANT", "N_NONCANCER_WITH_VARIANT", "SOMATIC_REPEAT_COUNT", "FAMILY_EVIDENCE_SCORE", "SEGREGATION_SCORE", "patient_cancer_evidence_score",
    "ACMG_INT_GERM", "ACMG_INT_SOM",
)

# 0/1 columns of the numeric view.
BINARY = (
    "SIFT_bin", "FAM_COUNT_GE_2", "FAM_SIRIUS_FLAG", "label_of_interest", "PAT_SIRIUS_FLAG", "HAS_GERM", "HAS_SOM", "N_GERM_ONLY", "N_GERM_AND_SOM", "PATHWAY_HIT", "PATH_DNA_REPAIR",
    "LOH_PARTIAL_PATHO", "LOH_PARTIAL_PATHO_SOM", "CNV_HIT", "CNV_pathogenic", "IN_ROH", "HET_HIGH_HOM", "HAS_SOMATIC_PATIENT",
    "SIRIUS_PASS_POPAF", "SIRIUS_PASS_NONSYN", "SIRIUS_PASS_SNV_GERMLINE", "SIRIUS_PASS_SNV_SOMATIC", "SIRIUS_PASS_CNV",
    "predisposition_flag", "somatic_driver_flag", "two_hit_flag", "literature_flag", "TWO_HIT_STRICT", "GERM_PASS",
)

# Columns that are one-hot encoded; keys and labels of every view.
CATEGORICAL = ("VARIANT_CLASS", "Consequence", "IMPACT", "BIOTYPE", "ORIGIN")
KEYS = ("FAMILY_ID", "VARIANT_KEY", "CHROM", "POS", "REF", "ALT", "TX", "Gene_Name", "HGNC_Name", "Feature_RefSeq", "label_clinvar", "label_acmg", "labels")

# Where the encoders look for a column, in this order.
PICKS = {
    "consequence": ("EXOME_Consequence", "ANN_Consequence", "Consequence"), "impact": ("EXOME_IMPACT", "ANN_IMPACT", "IMPACT"), "variant_class": ("EXOME_VARIANT_CLASS", "ANN_VARIANT_CLASS", "VARIANT_CLASS"),
    "biotype": ("EXOME_BIOTYPE", "ANN_BIOTYPE", "BIOTYPE"), "canonical": ("EXOME_CANONICAL", "ANN_CANONICAL", "CANONICAL"), "sift": ("ANN_SIFT", "EXOME_ANN_SIFT", "SIFT"),
    "polyphen": ("ANN_PolyPhen", "EXOME_ANN_PolyPhen", "PolyPhen"), "origin": ("ORIGIN",), "cnv_loh": ("CNV_LOH_status",), "gene": ("Gene_Name", "HGNC_Name"),
}

# Columns of one sample alone end in these after the last dot.
PER_SAMPLE = ("STATUT", "AD", "DP", "GQ", "GT", "PID", "Nb_Copy", "BAF")

# Columns that say the label or the locus, so no features.
NOT_FEATURES = (
    "FAMILY_ID", "VARIANT_KEY", "CHROM", "POS", "REF", "ALT", "labels", "label_of_interest", "label_clinvar", "label_acmg",
    "ACMG_INT", "ACMG_INT_GERM", "ACMG_INT_SOM", "Prediction_ACMG_tapes", "Probability_Path", "INTEGRATED_SCORE", "INTEGRATED_CLASS", "FAMILY_EVIDENCE_SCORE", "SEGREGATION_SCORE",
    "patient_cancer_evidence_score", "predisposition_flag", "somatic_driver_flag", "two_hit_flag", "literature_flag", "TWO_HIT_STRICT", "FAM_COUNT_GE_2", "FAM_SIRIUS_FLAG", "PAT_SIRIUS_FLAG",
    "SIRIUS_PASS_POPAF", "SIRIUS_PASS_NONSYN", "SIRIUS_PASS_SNV_GERMLINE", "SIRIUS_PASS_SNV_SOMATIC", "SIRIUS_PASS_CNV", "HGNC_Name", "Gene_name",
)

# Knowledge-base columns.
ONCOKB_LEVELS = ("LEVEL_1", "LEVEL_2", "LEVEL_3A", "LEVEL_3B", "LEVEL_4", "LEVEL_R1", "LEVEL_R2", "LEVEL_R3")
CIVIC = (
    "CIViC_Variant_clinical_significance", "CIViC_Variant_evidence_level", "CIViC_Variant_disease", "CIViC_Variant_drugs", "CIViC_Variant_citation_id", "CIViC_Region_variant_type",
    "CIViC_Region_clinical_significance", "CIViC_Region_evidence_level", "CIViC_Region_disease", "CIViC_Region_drugs", "CIViC_Region_citation_id",
)
CGI = ("CancerGenomeInterpreter_Association", "CancerGenomeInterpreter_Evidence_level", "CancerGenomeInterpreter_Drug", "CancerGenomeInterpreter_Primary_Tumor_type", "CancerGenomeInterpreter_Source")

# Ontology fields and their source columns; clinical fields, their source columns and their titles.
ONTOLOGY = {"GO_BP": "GO_biological_process", "GO_MF": "GO_molecular_function", "GO_CC": "GO_cellular_component", "KEGG": "KEGG_Pathway", "HPO": "HPO"}
CLINICAL = {"FUNC": "Function_description", "DISEASE": "Disease_description", "CLNSIG": "ClinVar_CLNSIG", "CLNDN": "ClinVar_CLNDN", "OMIM": "OMIM", "DISGENET": "DisGeNET", "GWAS": "Trait_association(GWAS)", "COSMIC": "COSMIC"}
TITLES = {"FUNC": "FUNCTION", "CLNSIG": "CLINVAR_CLNSIG", "CLNDN": "CLINVAR_CLNDN"}

# Categories of ontology text, and the patterns of each; the order decides which is the primary one.
CATEGORIES = {
    "immune response": (
        r"\bimmune\b", r"\bimmun", r"\binflamm", r"\bcytokine\b", r"\bchemokine\b", r"\bleukocyte\b", r"\blymphocyte\b", r"\bantigen\b", r"\binterferon\b",
        r"\binnate immune\b", r"\badaptive immune\b", r"\bhost defense\b",
    ),
    "signal transduction": (
        r"\bsignal transduction\b", r"\bsignaling\b", r"\bsignalling\b", r"\bkinase cascade\b", r"\bmapk\b", r"\bjak\b", r"\bstat\b", r"\bpi3k\b", r"\bakt\b", r"\bmtor\b",
        r"\bwnt\b", r"\bnotch\b", r"\btgf", r"\bsmad\b", r"\bnf[- ]?kappa", r"\bgpcr\b", r"\breceptor signaling\b", r"\breceptor signalling\b",
    ),
    "DNA cycle/cell cycle": (
        r"\bdna repair\b", r"\bdna replication\b", r"\bdna recombination\b", r"\bdna damage\b", r"\bcell cycle\b", r"\bmitotic\b", r"\bmitosis\b", r"\bmeiosis\b", r"\bcheckpoint\b",
        r"\bchromosome segregation\b", r"\bchromatin segregation\b", r"\bnuclear division\b", r"\bcell division\b",
    ),
    "Metabolic process": (
        r"\bmetabolic process\b", r"\bmetabolism\b", r"\bbiosynthetic\b", r"\bcatabolic\b", r"\bglycolysis\b", r"\boxidative phosphorylation\b", r"\brespiratory chain\b", r"\bmitochond",
        r"\blipid metabolic\b", r"\bamino acid metabolic\b", r"\bnucleotide metabolic\b", r"\bglucose metabolic\b",
    ),
    "development process": (
        r"\bdevelopment\b", r"\bdevelopmental\b", r"\bdifferentiation\b", r"\bmorphogenesis\b", r"\bembryo", r"\borgan development\b", r"\btissue development\b", r"\bcell fate\b",
        r"\bpattern specification\b",
    ),
    "cell adhesion and migration": (
        r"\badhesion\b", r"\bcell adhesion\b", r"\bcell[- ]cell adhesion\b", r"\bextracellular matrix\b", r"\becm\b", r"\bmigration\b", r"\bcell migration\b", r"\bmotility\b",
        r"\bchemotaxis\b", r"\binvasion\b", r"\bcell junction\b", r"\bfocal adhesion\b",
    ),
}
