"""Exact deduplication against a persistent digest index.

The index is a Parquet table ``(digest, doc_id)``, hash-bucketed and sorted by ``digest``. A batch of
documents is reduced to one digest row per text, anti-joined with the index (a sort-merge join whose
index side needs neither exchange nor sort, since the files already lie in that order), and the
survivors are appended in the same layout. The index only grows by new digests.

Defined results
    null text counts as the empty text; a null ``doc_id`` is smaller than any other;
    rows that repeat both ``doc_id`` and text are returned each, and one of them is kept;
    texts already in the index keep their earlier owner; an empty batch leaves the index as it is;
    further columns, whatever their names, pass through ``unique_rows`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewise.session import scratch_path

BUCKETS = 64


def digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """``(digest, doc_id)`` in files bucketed and sorted by digest under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, doc_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Adds rows whose digests are not in the index; one file per bucket and batch."""
        rows = fresh.select("digest", "doc_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def admit(self, docs: DataFrame) -> None:
        """The largest ``doc_id`` of every text that the index does not hold yet."""
        owners = docs.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
        owners = owners.groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
        known = self.read().select("digest").hint("merge")
        self.append(owners.join(known, "digest", "left_anti"))


def group_rows(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document with its group: doc_id, digest, keep_id, group_size, kept.

    Rows are counted per (text, doc_id) first, so a text with very many copies is spread by its ids;
    the join with the index has one index row per digest and is left to adaptive skew splitting.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    owners = index.read().withColumnRenamed("doc_id", "keep_id").join(sizes, "digest")
    ids = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    joined = ids.join(owners, "digest")
    nth = joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
    return nth.select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
    )


def unique_rows(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, all columns: per text the row of its owner in the index."""
    index = index or DigestIndex(docs.sparkSession)
    index.admit(docs)
    owners = index.read().select(F.col("digest").alias("owner_digest"), F.col("doc_id").alias("owner"))
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"), digest(F.col("text")).alias("digest"),
    )
    same = (F.col("digest") == F.col("owner_digest")) & F.col("id").eqNullSafe(F.col("owner"))
    one = Window.partitionBy("digest", "id").orderBy(F.lit(1))
    rows = marked.join(owners, same, "left_semi").withColumn("nth", F.row_number().over(one))
    return rows.where("nth = 1").select("row.*")
