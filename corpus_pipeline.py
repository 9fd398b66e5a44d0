"""From raw documents to packed training sequences: reject poor texts, keep one of each group of near duplicates,
redact secrets, and pack.

Stages keep the columns of documents (the last gives pieces) whatever their names, work on rows of any id (null and
repeated ids too) and on whole texts of any length, and turn an empty table into an empty one. What each does with null
and empty texts and with repeated rows is in its docstring. run() leaves its stage tables in the shared checkpoint folder:
the result is read from the last of them.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import ngram_join, packing, quality, secrets
from stratalake.llm.common import ready, table
from stratalake.llm.vocabulary import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.7 or more; labels of the input table train the classifier.

    Null and empty texts score alike, as a text without words; repeated rows score alike and stay or go together. With no
    usable label every score is 0.5, so nothing stays.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: that with the smallest
    doc_id. Null and blank texts link with nothing and stay; of rows equal in id and text one stays; rows that share an id
    but no text are groups of their own.
    """
    return ngram_join.one_of_each(docs, 5, 8, 10)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret redacted, a row for each row; null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens; a null or empty text is one piece with the end token, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learnt weights, inferred automata, connected components and tokenizers have no SQL form: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each result written to the shared checkpoint folder and read again."""
    ready(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    at = os.path.join(folder, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
