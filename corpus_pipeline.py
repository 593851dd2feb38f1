"""Corpus pipeline: language, quality, near-duplicates, secrets, packing; each stage on all that is left.

Counted as part of the llm subpackage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import forest, langid, packing, quality, secrets
from lodestone.llm.common import cut, shared, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is accepted unless there is none, or its odds against the others are below this.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or that fit no learned language, go; lang becomes the prediction.

    The model learns from the stage's own rows: text and lang of the rows that aren't held out.
    """
    rows = docs.select(*COLUMNS)
    found = langid.identify(rows, "text", langid.train(rows, "doc_id", "text", "lang"))
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail the base rules or are depleted by lines common on their host go; so do those lines.

    Copies of a text count once: one of them is to be kept by the next stage, however many there are.
    """
    rows = docs.select(*COLUMNS)
    kept = quality.clean(rows, "text", "source", cut(quality.statistics(rows, "doc_id", "text", "source")), copies=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similarity 0.85 stays, that with the smallest id."""
    rows = docs.select(*COLUMNS)
    found = forest.near_duplicates(rows, "doc_id", "text")
    ids = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    # Rows of one id are one group, and the first by text and the other columns stays; rows without an id
    # take no part in grouping, and stay.
    kept = rows.join(ids, F.col("doc_id") == F.col("key"), "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return kept.union(rows.filter(F.col("doc_id").isNull()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    rows = docs.select(*COLUMNS)
    ledger = secrets.Ledger(spark, f"{shared(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.update(rows, "doc_id", "text")
    findings = ledger.findings()
    # Findings by blob; a text's blob is its own hash, so equal ids with other texts don't mix.
    found = secrets.by_blob(findings)
    out = rows.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256)).join(found, "blob", "left")
    out = out.withColumn("text", secrets.redact(F.col("text"), F.col("found")))
    return out.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequence each goes to."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]

#: Language models and packing are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _kept(spark, docs)
    return docs


def _kept(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder and read again."""
    path = f"{shared(spark)}/stage-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return spark.read.parquet(path)
