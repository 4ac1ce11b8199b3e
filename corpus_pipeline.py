"""A training-corpus pipeline over ``documents``: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last
return the columns of documents. A runner writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinstrata.llm.common import Scratch, free_names, table
from kinstrata.llm.jaccard import jaccard_groups
from kinstrata.llm.packing import pack_documents
from kinstrata.llm.quality import THRESHOLD, quality_scores, train
from kinstrata.llm.substring import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "score")
    return quality_scores(docs, model, docs.columns, score).where(F.col(score) >= THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that five-word shingles link at a Jaccard similarity of 0.8 or more, the smallest doc_id stays."""
    groups = jaccard_groups(docs, 5, 80, 100)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that an earlier document has go; texts without such words stay as they are."""
    out = substring_dedup(docs, 13, docs.columns)
    removed, kept = free_names(docs.columns, "n_removed", "kept")
    text = F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text"))
    chars = F.when(F.col(removed) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 ids in sequences."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

# The classifier's score is no SQL expression; tests/llm holds run() against a plain Python version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
