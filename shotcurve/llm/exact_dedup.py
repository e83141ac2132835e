"""Exact dedup against a persistent digest index.

The index is a parquet table, bucketed and sorted by SHA-256 digest, so a new
batch meets it in a sort-merge anti-join that moves only the batch's digests.
A batch is first reduced to one row per digest where it lies: a text copied a
million times is one row per task before anything is shuffled.

Defined results: a null text counts as empty; all empty texts are one group;
of equal texts the largest doc_id stays, null doc_id only if there is no other;
of rows repeated with one doc_id one stays; other columns are carried along.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotcurve.scratch import shared_folder, stored

BUCKETS = 64


def text_digest(text) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """Digests seen so far with the id that stays: (digest, keep_id).

    path: a folder all executors reach; an index found there is continued."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = path or shared_folder(spark, "digest-index")
        self.buckets = buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame):
        (fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.table))

    def fold(self, digests: DataFrame) -> DataFrame:
        """Add the digests not yet known; returns them with the id that stays.

        digests: digest, doc_id."""
        batch = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        fresh = stored(batch.join(self.read().select("digest"), "digest", "left_anti"), "fresh-digests")
        self.append(fresh)
        return fresh


def annotate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (rows of this batch
    with the text), kept, text_sha256. Texts are hashed in one scan."""
    # the row number only tells repeated rows apart; it is fixed by storing it
    digests = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_digest("text").alias("digest"),
        F.monotonically_increasing_id().alias("row")), "digests")
    fresh = index.fold(digests)
    groups = digests.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("last"))
    groups = (
        groups.join(index.read(), "digest")
        .join(fresh.select("digest", F.lit(True).alias("is_new")), "digest", "left"))
    # digests of a hot group are spread by adaptive splitting of this join
    out = digests.join(groups, "digest")
    return out.select(
        "doc_id", "keep_id", "group_size",
        (F.col("is_new").isNotNull() & (F.col("row") == F.col("last.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs whose text is new to the index, one per text, with all
    their columns; their digests are in the index afterwards."""
    taken = {c.lower() for c in docs.columns}
    digest = next(n for n in ("digest", *(f"digest_{i}" for i in range(len(taken) + 1))) if n not in taken)
    fresh = index.fold(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_digest("text").alias("digest")))
    docs = docs.withColumn(digest, text_digest("text"))
    stays = fresh.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k"))
    # the key holds doc_id too, so copies of one text are spread over all tasks
    kept = docs.join(
        stays, docs[digest].eqNullSafe(stays["_d"]) & docs["doc_id"].eqNullSafe(stays["_k"]), "left_semi")
    return kept.dropDuplicates([digest, "doc_id"]).drop(digest)
