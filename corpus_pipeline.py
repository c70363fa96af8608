"""A corpus from raw documents: stages that each apply one operator to all that the stage before kept.

Documents of low quality go, of near duplicates (five words, similarity 0.8) one stays, documents that
hold a benchmark window go, sources are mixed to their target weights, and what is left is written as
token ids in binary frames and read back. Every stage but the last returns the columns of documents.

Defined results: null and empty texts, and texts of white space, are rejected by the first stage; rows with a
null key are judged like all others, stay apart from near duplicates, and come first in the frames; of rows
that share a key one stays in the second stage; a row that the mix takes twice stands twice in the frames;
texts of any length pass whole; further columns of documents, whatever their names, are kept up to the
last stage; an empty table gives no rows at any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bookloom.llm import decontamination, mixing, near_dedup, quality, token_output
from bookloom.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.distinct_rows(docs, 5, 0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.read_ids(*token_output.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: SQL can express neither the classifier nor the byte-pair ids; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
