"""From raw documents to encoded training data, stage by stage.

Every stage is a function of (spark, docs, sf_dir) and works on all that the one
before it kept; each result is written as Parquet in the shared folder and read
again. All stages but the last return the columns of documents:

1. quality: documents that the trained classifier rejects go;
2. near duplicates: one document of each group of near copies stays;
3. personal data: found spans are masked in the text;
4. mixing: documents are repeated or dropped to meet the sources' targets;
5. byte-level BPE: tokens of each document, and a round trip of its bytes.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pactlake.llm import cpsjoin, gbdt, mixing, skipchain, word_shuffle_bpe
from pactlake.llm._arrow import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gbdt.keep(docs, gbdt.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cpsjoin.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return skipchain.redact(docs, skipchain.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return word_shuffle_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Boosted trees, the random field and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
