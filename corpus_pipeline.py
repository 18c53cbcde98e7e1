"""A training corpus from raw documents: the stages, in order, and the run of all of them.

Each stage takes (spark, docs, sf_dir) and returns a frame; between stages run() writes Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, secret_scan, simhash_dedup, toxicity
from tidemark.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the toxicity threshold, with all their columns. The model is fitted on labelled rows of the documents it gets.

    Null and empty texts score the share of toxic labels; texts of any length are scored whole; a score at the threshold
    is toxic; repeated rows stay or go together; an empty table stays empty; without labels of both classes all get one score.
    """
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest doc_id (rows without an id only if there is no other).

    Null and empty texts are one group; texts of any length are hashed whole; of rows that share the smallest id one stays; an
    empty table stays empty.
    """
    return simhash_dedup.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced.

    Null texts stay null, empty ones empty; texts of any length are scanned whole; overlapping spans become one mark; repeated
    rows are replaced alike; an empty table stays empty.
    """
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of documents such that sources meet their targets.

    Null and empty texts have no words and come with the whole draws of their block; a null source is a source; texts of any
    length are drawn whole, but for one at each source's cut; repeated rows are drawn alike; an empty table stays empty.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null and empty texts are an end id alone; texts of any length are packed whole, in pieces; repeated rows are packed each;
    an empty table has no piece.
    """
    return packing.packed(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Models, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
