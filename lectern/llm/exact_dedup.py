"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text, so that looking up new digests is a sort-merge
anti-join without a shuffle of the index. New data is grouped by digest first, and only digests that the index lacks are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, lower_ascii, table


#: A bucket of the index is laid out for about so many digests (some 120 MB).
BUCKET_ROWS = 1_000_000


class DigestIndex:
    """Digests seen so far: columns digest (hex), keep_id and group_size of the batch that brought the digest, batch.

    The table is made, empty, before its first batch, with buckets for the number of digests it is expected to hold; every batch, the first too, is held against it by the same
    merge anti-join. A batch has a name: one that was broken off after its append is run again under the same name and finds its own digests as its own.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def create(self, like: DataFrame, expected: int) -> None:
        """The empty table for rows like those of `like`."""
        self.buckets = self.buckets or max(16, -(-expected // BUCKET_ROWS))
        self.write(like.withColumn("batch", F.lit("")).where(F.lit(False)), "overwrite")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest isn't in the index. The index isn't shuffled: the groups are dealt by its buckets."""
        return groups.repartition(self.buckets, "digest").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the groups (digest, keep_id, group_size) whose digest isn't in the index; return the rows that this batch brought, as the index holds them."""
        batch = batch or uuid.uuid4().hex
        if not self.exists():
            self.create(groups, groups.count())
        elif self.buckets is None:
            described = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(described["data_type"])
        self.write(self.unseen(groups).withColumn("batch", F.lit(batch)), "append")
        return self.read().where(F.col("batch") == batch).drop("batch")

    def compact(self, name: str) -> DigestIndex:
        """The index under another name with one sorted file a bucket, after many appends have left several."""
        new = DigestIndex(self.spark, name, self.buckets)
        new.write(self.read().repartition(self.buckets, "digest"), "overwrite")
        return new

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("digest"))


def resolve(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row per row of docs: (id, digest, keep_id, group_size, kept); digests new to the index are appended to it.

    Of equal texts in docs the row with the largest id stays, unless the index had the text before: then none stays and keep_id is null.
    Null and empty texts are equal. Rows that repeat an id as well as a text can't be told apart: all of them stay with their id, and
    each counts in group_size. Rows with a null id stay only where the whole group has none. An empty table gives an empty result.
    """
    found = checkpointed(digests(docs, id_col, text_col))
    groups = checkpointed(found.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")))
    new = index.add(groups, batch)
    sizes = new.select("digest", "keep_id", "group_size")
    return found.join(sizes, "digest", "left").withColumn("kept", F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")) & F.col("group_size").isNotNull(), F.lit(False)))


def keep(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of rows that repeat both id and text one stays. What stays is decided and kept before this returns, so the index may go then."""
    own, digest = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "digest"))
    hashed = F.xxhash64(F.col(id_col).cast("long"))
    stays = resolve(docs, index, id_col, text_col).where("kept").select(F.xxhash64(F.col("id").cast("long")).alias(own), F.col("digest").alias(digest)).distinct()
    stays = checkpointed(stays)
    rows = docs.withColumns({digest: F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256), own: hashed})
    # Of each digest one id stays, so digest and hash tell rows apart; join and deduplication share one exchange.
    return rows.join(stays, [digest, own], "left_semi").dropDuplicates([digest, own]).select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for all documents, against an index that begins empty."""
    index = DigestIndex(spark, f"lectern_digests_{uuid.uuid4().hex}")
    found = checkpointed(resolve(table(spark, sf_dir, "documents"), index))
    index.drop()
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
