"""A training corpus from raw documents: five stages, each one operator of the library over what the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. Between
stages the result is written as Parquet in the shared folder and read again, so a lost executor costs a
re-read of one stage's result and never the work of the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelloom.llm import decontaminate, jaccard_join, language_id, source_mix, token_file
from labelloom.scale.staging import StagingScope, ensure_shared_dir


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def prepare(spark: SparkSession) -> None:
    """A shared folder, and small Arrow batches of whole texts, of which every core holds some twice, unless the application sets their size."""
    ensure_shared_dir(spark)
    if spark.sparkContext.getConf().get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: null texts, texts without a letter and texts unlike every language go."""
    prepare(spark)
    return language_id.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard >= 0.8 over five-word shingles: the one with the smallest id.

    Texts are told by their digest, so rows with a null or repeated id are handled like any other: of rows with
    equal id and equal text one stays.
    """
    prepare(spark)
    return jaccard_join.first_of_groups(docs, num=80, den=100, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    prepare(spark)
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a document not taken goes."""
    prepare(spark)
    return source_mix.repeat_documents(docs, source_mix.mix_sources(docs, weights=(1, 2, 3), most=3))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark)
    return token_file.token_file_digest(docs)


STAGES = [
    ("language_id", identified),
    ("jaccard_join", deduplicated),
    ("decontamination", decontaminated),
    ("source_mix", mixed),
    ("token_file", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    scope = StagingScope(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scope.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# Tokenisation and the character models cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
