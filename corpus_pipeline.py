"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all that the stage before it kept; run() writes each result
as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import contamination, jaccard, mixture, quality, token_files
from trailmark.llm.shared import documents, fresh, save, work_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.5 or more. Null and empty texts have a score as well; repeated rows all go or all stay; an empty table stays empty."""
    model = quality.train(docs, quality.training_labels(spark, sf_dir))
    (score,) = fresh(docs, "score")
    return quality.score_documents(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join: that of least doc_id, and of rows that repeat this id, that of least text hash.

    Rows without a word (null, empty or blank texts) all stay, as they are linked with nothing.
    """
    return jaccard.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item contaminates; each row is judged by its own text, so null and empty texts stay."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without a word have size 0 and are never taken."""
    return mixture.mix_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the files; copy tells repeats of a doc_id apart."""
    return token_files.encode_and_read(docs).select("doc_id", "copy", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("mixture", mix_to_targets),
    ("token_files", encode),
]

ORACLE_SQL = None  # a fitted classifier and a tokenizer aren't SQL; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"{path}/{i}-{name}")
    return docs
