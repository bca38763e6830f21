"""A corpus pipeline of five stages over documents, each a Parquet table before the next one reads it.

Every stage takes all rows that the one before it kept. A null or empty text is an empty document: the
quality stage judges it by its importance of 0, exact dedup keeps one, and the mix, which counts words,
has no place for it. A null doc_id gives way to any other of its group. Repeated rows are one document
from exact dedup on. Extra columns are carried along up to the mix's result; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lichenmill.llm import exact, mixing, packing, quality, simhash
from lichenmill.llm._common import configure, materialize
from lichenmill.llm.queries import END_ID, tokenizer_path


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling by the labelled ones keeps; ties with the last one stay."""
    configure(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    configure(spark)
    return exact.drop_exact(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are linked, by one step or several, the row with the smallest doc_id.

    Links are SimHash fingerprints at 4 or fewer differing bits, all found by covering masks, and five-word
    shingles at a similarity of 0.8 or more, most of which lie beyond any such radius.
    """
    configure(spark)
    return simhash.drop_similar(docs, radius=4)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often and as far as the mix takes it, in the order of its schedule."""
    configure(spark)
    return mixing.take_texts(docs, mixing.mix(docs))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    configure(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), END_ID)


STAGES = [("quality", _quality), ("exact_dedup", _exact), ("near_dedup", _near), ("mixing", _mix), ("packing", _pack)]

#: Hash models, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
