"""Sinks: delimited tables with counts, multi-view exports, metadata and metric logs, embeddings, profiles."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import texts as T
from ..operators.features import column_stats, numeric_view, top_values
from ..plans.columns import CLINICAL, ONTOLOGY
from .tables import write_delimited


def safe_save(df: DataFrame, path: str, sep: str = "\t") -> tuple[int, int]:
    """Write a delimited table; the folder is made, an empty table still gets a header. Returns rows and columns, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").csv(path, sep=sep, header=True)
    return int(seen.get.get("rows", 0)), len(df.columns)


def json_file(spark: SparkSession, path: str, value: object | None = None) -> object:
    """Write a small JSON document (or read it, without ``value``) through the session's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if value is not None:
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(value, indent=1, ensure_ascii=False).encode()))
        out.close()
        return value
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def append_metrics(spark: SparkSession, path: str, **values: object) -> None:
    """Append a row (epoch, split, metrics ...) to a log table; each call is a file of its own."""
    spark.createDataFrame([tuple(values.values())], list(values)).coalesce(1).write.mode("append").option("header", True).csv(path)


def ml_views(df: DataFrame, test_family: str, values: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The five views of a variant table by name, with ``split``: test where FAMILY_ID is the held-out family, else train.

    SEQUENCES (keys, SEQ_REF, SEQ_ALT where there), NUMERIC, TEXT (ONTOLOGY_TEXT, CLINICAL_TEXT), TEXTFIELDS, ONTO.
    """
    df = T.text_views(df)
    split = F.when(F.col("FAMILY_ID").cast("string") == test_family, "test").otherwise("train").alias("split")
    keys = [c for c in ("FAMILY_ID", "VARIANT_KEY", "labels") if c in df.columns]
    some = lambda names: df.select(*keys, *(F.col(f"`{c}`") for c in names if c in df.columns), split)
    numeric = numeric_view(df, values)
    return {
        "SEQUENCES": some(("CHROM", "POS", "REF", "ALT", "SEQ_REF", "SEQ_ALT", "REF_MATCH")), "NUMERIC": numeric.select("*", split), "TEXT": some(("ONTOLOGY_TEXT", "CLINICAL_TEXT")),
        "TEXTFIELDS": some([f"TXT_{c}" for c in (*CLINICAL, "CIVIC", "CGI", "ONCOKB")]), "ONTO": some([f"ONTO_{c}" for c in ONTOLOGY]),
    }


def export_views(views: dict[str, DataFrame], path: str, evaluated: DataFrame | None = None) -> None:
    """path/<view>/split=train and split=test; rows whose VARIANT_KEY is in ``evaluated`` go to path/EVAL/<view>, and out of train."""
    for name, view in views.items():
        rest = view
        if evaluated is not None:
            keys = evaluated.select("VARIANT_KEY").distinct()
            write_delimited(view.join(keys, "VARIANT_KEY", "left_semi"), f"{path}/EVAL/{name}")
            rest = view.where("split = 'test'").unionByName(view.where("split = 'train'").join(keys, "VARIANT_KEY", "left_anti"))
        write_delimited(rest, f"{path}/{name}", by=("split",))


#: Rows of a global table that are exported by themselves beside tables.SUBSETS: by the greatest class, and by patient evidence.
GLOBAL_SUBSETS = {"class_3": "greatest(acmg_germ, acmg_som) = 3", "class_4": "greatest(acmg_germ, acmg_som) = 4", "class_5": "greatest(acmg_germ, acmg_som) = 5", "patient_class_ge_3": "patient_class >= 3"}


def export_global_subsets(df: DataFrame, path: str) -> None:
    for name, rows in GLOBAL_SUBSETS.items():
        write_delimited(df.where(rows), f"{path}/{name}")


def write_embeddings(df: DataFrame, key: str, inputs: list[str], embed: Callable[[pd.DataFrame], dict[str, np.ndarray]], names: list[str], path: str) -> DataFrame:
    """Embed a table batch by batch in its own tasks and write (key, one float array per name) as Parquet; returns the written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = embed(pdf)
            yield pd.DataFrame({key: pdf[key]} | {n: list(np.asarray(made[n], np.float32)) for n in names})

    kind = df.schema[key].dataType.simpleString()
    df.select(key, *inputs).mapInPandas(run, ", ".join([f"`{key}` {kind}", *(f"`{n}` array<float>" for n in names)])).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_profile(df: DataFrame, numeric: list[str], text: list[str], path: str) -> None:
    """path/numeric and path/text: the column profile as delimited tables."""
    write_delimited(column_stats(df, numeric), f"{path}/numeric")
    write_delimited(top_values(df, text), f"{path}/text")
