"""Corpus pipeline: quality rules, quality classifier, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Every stage works on all rows that the one before it kept:

* ``quality_rules`` drops the documents that the current rule policy rejects;
* ``quality_classifier`` drops those that the model, fitted on the labelled rows outside the
  held-out quarter, scores below ``MIN_QUALITY``;
* ``near_dedup`` keeps the smallest id of each near-duplicate class;
* ``pii`` replaces personal data in the texts by their kinds;
* ``packing`` gives the pieces of all documents and their places in sequences.

Null and empty texts have no words, so the rules reject them, like all texts of fewer than 50 words.
Rows with a null id go through every stage and are never duplicates. Repeated rows are copies: the
first of them stays. Several texts under one id are told apart. Of copies with equal ids the one
with the smaller digest stays. Very long texts are read whole by every stage. Further columns stay
as they are, whatever their names, but ``n_chars``, which follows the text. An empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findweave.llm import near_dedup, packing, pii, quality_classifier, quality_rules
from findweave.session import drop_materialized, materialize, materialized

#: Documents below this score are rejected; clean documents score far above it.
MIN_QUALITY = 0.5


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.reject(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_classifier.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model, MIN_QUALITY)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The stages have models, signatures and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``documents`` after all stages, each stage's result written and read again.

    What a stage has written is dropped once its result is, and a result once the next one is.
    """
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), materialized(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name)
            drop_materialized(spark, first, keep=1)
    return docs
