"""Corpus pipeline: raw documents -> packed training sequences.

Each stage works on all that its predecessor kept; ``run`` writes every stage's result as
Parquet to the shared scratch folder and reads it back as the next one's input. All stages but the last
return the columns of ``documents``. Rows without an id pass the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankfold.llm import jaccard, packing, quality, secrets, suffix_dedup
from rankfold.llm.common import prepare, stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents, keep those predicted to be of quality."""
    prepare(spark)
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), only_good=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    prepare(spark)
    gone = jaccard.similar_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start earlier are cut out of the texts; ``n_chars`` follows."""
    prepare(spark)
    cut = suffix_dedup.deduplicate(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret or a linked credential go."""
    prepare(spark)
    return secrets.without_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all remaining documents with their sequence and place."""
    prepare(spark)
    return packing.pack_documents(docs, 2048)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", jaccard_join), ("suffix-array dedup", suffix_array_dedup),
          ("secret scans", secret_scan), ("best-fit packing", best_fit_packing)]

# Trained scores and tokenizer ids cannot be stated in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
