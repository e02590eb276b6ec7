"""The corpus pipeline: classify, drop near duplicates, redact secrets, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; `run` writes every stage's rows
as Parquet and reads them again.  All stages but the last return the columns of `documents`.  Executors and their Python workers live
through all stages, so these limit the session's Arrow batches by bytes and begin with the executors' garbage collected, and packing keeps
little of its words and nothing behind a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, mixing, near_dedup, packing, quality_classifier, secrets

#: Bytes, about, of words that a worker keeps while it packs.
PACKING_CACHE = 16_000_000


def _begin(spark: SparkSession) -> None:
    common.small_batches(spark)
    common.collect_garbage(spark)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for low quality or toxic go."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels, results=("__quality", "__toxic", "__kept")).where("__kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles alike by 0.8 or more."""
    _begin(spark)
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live findings are replaced in the text; no document goes."""
    _begin(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    _begin(spark)
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows."""
    import public_tokenizers

    _begin(spark)
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), cache_bytes=PACKING_CACHE, keep=False)


STAGES = [
    ("quality_classifier", classify),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifier's fit, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
