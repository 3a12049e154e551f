"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it
as Parquet into the shared folder and reads it again as the next stage's docs.
Executors collect their garbage before a stage begins, so that what one stage
made their heaps grow doesn't stay beside the Python workers of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import collect_garbage, materialise
from inkspan.llm.decontaminate import drop_leaking
from inkspan.llm.ngramjoin import keep_representatives
from inkspan.llm.packing import pack
from inkspan.llm.quality import keep_sampled
from inkspan.llm.toxicity import third_held_out, train, training_rows, without_toxic


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network doesn't reject."""
    collect_garbage(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, train(training_rows(docs, labels, third_held_out)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    collect_garbage(spark)
    return keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the least doc_id."""
    collect_garbage(spark)
    return keep_representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    collect_garbage(spark)
    return drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    collect_garbage(spark)
    return pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("best_fit_packing", pack_sequences),
]

#: Trained models and tokenizers have no SQL form; a test compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs.select(*(F.col(c) for c in docs.columns))
