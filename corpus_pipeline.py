"""The corpus pipeline: toxicity, exact dedup, near dedup, decontamination, BPE encoding.

``run`` applies the stages to ``documents``; each one's rows are written as Parquet in the
shared folder and reread as the next one's documents.  All stages but the last return the
columns of the documents.  Texts are never changed: a stage keeps a row or drops it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchframe.llm import bpe, decontamination, exact_dedup, near_dedup, toxicity
from watchframe.llm.common import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting of the rows that go to a Python worker at once, and how many do here: the JVM and the worker hold
#: such a batch of whole texts, some copies of it at times.
ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def in_small_batches(stage: Callable) -> Callable:
    """The stage, with at most ``BATCH`` rows to a batch from then on in the session; a smaller setting stays."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(ROWS)) <= BATCH:
            spark.conf.set(ROWS, str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic; labels of fold 2 of 4 are not learnt."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"), label="toxic",
                                  held_out=lambda c: F.pmod(c, F.lit(4)) == 2, threshold=0.3)


@in_small_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_dedup.deduplicated(docs, words=5, percent=80)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"), size=10, remove="documents")


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is left."""
    import public_tokenizers
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("same_text")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies),
          ("decontamination", drop_contaminated), ("bpe", encode)]

#: SQL has no nearest neighbours, merges or sketches; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
