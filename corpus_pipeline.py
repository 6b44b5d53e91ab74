"""The corpus pipeline: stages over ``documents``, each one of the operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskfold.llm import bpe, exact_dedup, minhash_dedup, mixing, quality_classifier
from riskfold.llm.common import stage_folder
from riskfold.sources.tables import read_table


def _classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.drop_rejected(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def _exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays."""
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; repeated documents are repeated rows."""
    return mixing.mixed_documents(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's number of ids and digests of its ids and of its decoded text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                cut_at_spaces=True)


STAGES = [
    ("quality classifier", _classify),
    ("exact dedup", _exact),
    ("MinHash near-dedup", _near),
    ("mixing", _mix),
    ("byte-level BPE", _encode),
]

#: The stages fit a model, confirm links on whole sets and tokenise: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{stage_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
