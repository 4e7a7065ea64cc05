"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns the documents that the next one reads.

toxicity drops documents predicted toxic; near_duplicates keeps one document, that of the least id, of each class linked by 5-word shingles at
similarity 0.8; decontamination drops documents that hold a benchmark item; secrets replaces secrets in the texts; packing returns the pieces and their bins.

Rows without an id pass all filters but those that read the text alone. Rows equal in id and text count once after near_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, jaccard, packing, toxicity
from graphloom.llm import secrets as secret_scan
from graphloom.llm.common import spool


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard.linked_classes(docs, k=5, percent=80)
    kept = docs.join(classes.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    ids = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count()
    if ids.where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.scrub(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Models, hashes and best-fit order are beyond SQL. The tests hold each stage against its operator, and the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, with each stage's documents written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
