"""A corpus pipeline of the operators in dendrium.llm; each stage reads what the one before it wrote.

Classifier and rules drop documents, the join keeps one document of each class of near copies, the mix repeats or
drops documents so that sources meet their targets, and packing turns what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules
from dendrium.llm.common import release, table, written


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality trees, learned from this input and its labels, predict to be good."""
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and are no robust outliers."""
    return quality_rules.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each class of five-word shingle sets with a similarity of 0.8 or more;
    documents without words are classes of their own."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence whose length is a power of two."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classifier_stage),
    ("quality rules", rules_stage),
    ("n-gram jaccard join", near_copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: The trees, the robust estimates and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing makes of what the other stages keep of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir)), docs
        release(before)  # nothing reads it any more; tables of the input stay
    return STAGES[-1][1](spark, docs, sf_dir)
