"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's result as
Parquet in the cluster's shared folder and reads it as the next one's input. All but the last return the
columns of documents; the last returns a row for each piece of a document and its place in a sequence.

Defined cases: extra columns pass through all stages but the last, whatever their names; rows that are equal in every
column count as copies and become one, also without words; other rows with a null or wordless text stay; an empty
table gives an empty result; long texts are processed whole; for ties see the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm import decontamination, dedup, packing, privacy, toxicity
from tallygrove.llm._text import unused
from tallygrove.plans.lineage import checkpoint_dir, removed


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars as it is after a change of the text; null stays null."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the severity model rejects."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    results = tuple(unused(n, docs.columns) for n in toxicity.RESULTS)
    return toxicity.grade_texts(docs, model, results=results).where(~F.col(results[2])).select(docs.columns)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    row = unused("_row", docs.columns)
    rows = docs.withColumn(row, F.struct("doc_id", F.xxhash64(*docs.columns)))
    found = dedup.near_duplicates(rows.select(row, "text"), id_col=row)
    # rows that are equal in every column share their row value; those that dedup keeps as one stay one
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return rows.join(kept, F.col(row).eqNullSafe(kept["_kept"]), "left_semi").dropDuplicates([row]).select(docs.columns)


def drop_benchmark_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts."""
    return _counted(decontamination.remove_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).select(docs.columns)


def redact_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and terms that disclose it generalised."""
    return _counted(privacy.redact(docs, privacy.disclosing_terms(docs))).select(docs.columns)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL has neither the trained model nor the sketches; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; a stage's folder is deleted when the next one is written."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
