"""A corpus from raw documents to packed sequences: quality, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns of
``docs``. Rows with null text, null ids, repeats and further columns pass by the rules of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm import language_id, minhash, packing, quality_knn, superkmers
from duelbook.llm.common import cut, fresh, prepare, release, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, learnt from the labels beside the documents."""
    prepare(spark)
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_knn.score(docs, model) >= quality_knn.THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages, likely enough."""
    prepare(spark)
    into = fresh(docs, "language_id")
    return language_id.identify_documents(docs, into=into).where(f"{into}.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a text that loses nothing stays as it is."""
    prepare(spark)
    into = fresh(docs, "removal")
    out = superkmers.remove_repeats(docs, into=into)
    out = out.withColumn("text", F.when(F.col(f"{into}.n_removed") > 0, F.col(f"{into}.kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{into}.n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", pack)]

#: No SQL can express the classifier or the tokeniser; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stage's result written and read again; what a stage read and wrote
    before its result goes when the result is there."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:
            docs = keep(cut(stage(spark, before, sf_dir)))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
