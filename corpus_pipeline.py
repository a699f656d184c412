"""A corpus pipeline of four operators: language, quality, near duplicates, packing.

run() applies STAGES to ``documents`` in order; each stage's rows are written to the shared folder
and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.language import held_out, identify_language, learn_limit, learn_profiles
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.packing import pattern_pack
from tidemark.llm.quality import repetition_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learned from the stage's own labelled rows; documents without letters, or far from every language, go.

    Null text has no letters; where no row is labelled nothing can be told, and all rows stay; equal rows stay or go together; an empty
    table gives an empty one.
    """
    labelled = docs.where(~held_out(docs, 5, 0))
    profiles = learn_profiles(labelled)
    if not profiles:
        return docs.select(*COLUMNS)
    limit = learn_limit(labelled, profiles)
    found = identify_language(docs.select(*COLUMNS), profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= limit)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules do not keep go; null and empty texts are among them, equal rows stay or go together."""
    return repetition_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a likeness of 0.8) stays: the one of least doc_id (null last).

    Of rows alike in doc_id and text one stays; texts without words are linked with nothing, and stay.
    """
    found = near_duplicates(docs, 5, 80).where("stays").groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    found = C.written(found, "stay").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), ((F.col("copies") > 1) & (F.col("n") > 0)).alias("_again"))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_text"))
    kept = rows.join(found, rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["_text"] == found["_hash"]))
    once = kept.where(~F.col("_again"))
    if found.where("_again").isEmpty():
        return once.select(*COLUMNS)
    return once.unionAll(kept.where("_again").dropDuplicates(["_doc", "_hash"])).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row per piece of a document, equal rows apart; null text is empty; an empty table gives none."""
    return pattern_pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Tokenisation and signatures are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage's are a written table.  Extra columns go with the first stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.written(docs, name)
    return docs
