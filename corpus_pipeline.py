"""A training-data pipeline over the documents table: five stages, each one operator.

toxicity     documents that the classifier rejects go
near_dedup   one document of each group of near copies stays
secrets      live-looking credentials in the texts are put as <KIND>
mixing       documents repeated or left out so that sources meet their targets
packing      the pieces of training sequences

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `docs`. Whoever runs the stages writes each result before
the next one reads it, as run() does in the checkpoint folder. Each begins by
cleaning the driver of what the stages before it left there.

Defined cases, for each stage: null and empty texts are clean, are nobody's
copies, have no secrets and pack as the end id alone; of rows that repeat an id
near_dedup keeps one, rows without an id all stay; documents without words take
no part in a mix's budget but follow its order; empty tables give empty results;
other columns are passed on, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import dedup, mixing, packing, secrets, toxicity
from gridloom.llm.common import documents, tokenizer_file
from gridloom.session import clean_driver, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean_driver(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean_driver(spark)
    return dedup.keep_one(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean_driver(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean_driver(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean_driver(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, the near-copy groups or the tokenizer.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents. A stage's folder goes when the next one's is written; the last one's stays, as the result reads it."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = documents(spark, sf_dir), ""
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:
            _delete(spark, read)
        read = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
