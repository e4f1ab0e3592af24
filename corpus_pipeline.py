"""A training-data pipeline over the table of documents.

Five stages, each written and read again before the next: the quality classifier's rejects go;
of documents linked by their word 5-grams one stays; personal data are masked; sources are
interleaved to their target weights; texts become token ids, which are decoded again.

The mixture is an order of all rows, in which they are written. Readers pack files by size and
so lose it; the last stage takes it from where each row stands in the files. It has each row's
slot and place in the schedule and whether the mixture is still complete there, and the result
is sorted by them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import bpe, common, jaccard, mixing, pii, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, common.table(spark, sf_dir, "labels"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Each source's rows are in the order in which the stage before wrote them.
    read = mixing.as_written(docs.select("doc_id", "source", "text"))
    placed = common.staged(mixing.mixed(read.select("source", "file", "line"), order=("file", "line")).drop("source"), "pipeline-places")
    coded = bpe.encode(read, bpe.read_vocabulary(), decoded=True).select("doc_id", "source", "file", "line", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return coded.join(placed, ["file", "line"]).select("doc_id", "source", "slot", "place", "in_mix", "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("personal data", mask_personal_data),
    ("mixing to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained classifiers and connected components have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs.sort("slot", "place")
