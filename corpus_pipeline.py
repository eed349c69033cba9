"""A corpus pipeline: toxic documents go, exact and near copies go, sources are mixed to target weights, and the mix is encoded.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the next documents. run() writes each stage's result to the shared folder that
spark.checkpoint.dir names and reads it again, so a lost executor repeats no earlier stage. Every stage but the last returns the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from lectern.llm.common import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold stay."""
    model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    score = f"score_{uuid.uuid4().hex}"  # no column of docs has this name
    return toxicity.with_scores(docs, model, name=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    index = exact_dedup.DigestIndex(spark, f"lectern_digests_{uuid.uuid4().hex}")
    kept = exact_dedup.keep(docs, index)
    index.drop()  # what stays is decided
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays; rows without a doc_id stay. SimHash links are the first candidates; a link takes a Jaccard similarity of five-word shingles of at least 0.8."""
    found = near_copies.components(docs)
    gone = found.where("id <> component_id").select(F.col("id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the parts, as the mix takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and decoded of each document of the mix."""
    return bpe.encode(docs, bpe.default_vocabulary()).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Stages 1, 3 and 5 have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to all documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
