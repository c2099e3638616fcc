"""Exact dedup with a persistent digest index (operator 4).

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch of documents is reduced to one row per
digest (partial sums first, so a text with a third of all rows costs one row per task), set against the index by a
sort-merge anti-join in which the index side is not shuffled (Spark sorts a bucket again, which is cheap where it is
one sorted file), and what is new is appended. ``compacted`` makes one file for each bucket again after many appends.
Only DataFrame operations are used.

Defined cases: a null text counts as empty; rows are told apart by their id, so repeated rows (same id, same text)
get the same verdict; a null id never outranks another; an empty table gives no rows; further columns of the input
are ignored by ``verdicts`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import join_weighted, materialize, read_table, scratch_path

#: Rows of an index for each of its buckets, and the fewest buckets.
BUCKET_ROWS, FEWEST = 4_000_000, 16


def buckets_for(rows: int) -> int:
    return max(FEWEST, -(-rows // BUCKET_ROWS))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of every row, whole texts."""
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """The table of all digests seen so far, in ``buckets`` buckets sorted by digest, at ``path``.

    The number of buckets is fixed when the index is made; ``buckets_for`` the rows of the final index is a good one.
    An index that another session wrote is opened by giving its path: its files name the buckets. The catalog knows
    the table under a name of its own until ``close``, which leaves the files where they are.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = FEWEST):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + uuid.uuid4().hex
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compacted(self, path: str, buckets: int | None = None) -> DigestIndex:
        """A copy at another path with one file for each bucket, of which there may be another number."""
        new = DigestIndex(self.spark, path, buckets or self.buckets)
        new.append(self.rows())
        return new

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (one per digest) whose digest the index does not hold."""
        return batch.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Add rows that ``unseen`` has let through; one file for each bucket."""
        columns = batch.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        columns.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def absorb(self, batch: DataFrame) -> DataFrame:
        """Append the new ones of a batch's ``groups``; returns these."""
        new = materialize(self.unseen(batch), "new-digests")
        self.append(new)
        return new


def verdicts(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index a new one is made in the shared folder. With one, a document whose digest it already holds is
    not kept, and keep_id and group_size are those of the batch that brought the digest.
    """
    spark = docs.sparkSession
    rows = materialize(digests(docs, id_col, text_col), "digests")
    own = None if index else DigestIndex(spark, scratch_path(spark, "digest-index"), buckets_for(rows.count()))
    batch = materialize(groups(rows), "digest-groups")
    new = (index or own).absorb(batch)
    uses = batch.select("digest", F.col("group_size").alias("uses"))
    if own:  # all is new
        known = new.select("digest", "keep_id", "group_size", F.col("group_size").alias("uses"), F.lit(True).alias("new"))
        own.close()
    else:
        known = uses.hint("merge").join(index.rows(), "digest").join(new.select("digest", F.lit(True).alias("new")).hint("merge"), "digest", "left")
    return join_weighted(rows, known, "digest", "uses").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("new").isNotNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as tell it from the columns of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text no row with a larger id has; of repeated rows one stays.

    Rows without an id go when a row with an id has their text; of the others one for each text stays.
    """
    id_name, digest_name = (unused(docs, name) for name in ("_kept_id", "_digest"))
    rows = verdicts(docs, None, id_col, text_col)
    kept = rows.filter(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_name))
    named = docs.join(kept, F.col(id_col) == F.col(id_name), "left_semi").dropDuplicates([id_col])
    alone = rows.filter(F.col("keep_id").isNull()).select(F.col("text_sha256").alias(digest_name)).distinct()
    nameless = docs.filter(F.col(id_col).isNull()).withColumn(digest_name, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    nameless = nameless.join(alone, digest_name, "left_semi").dropDuplicates([digest_name]).drop(digest_name)
    return named.unionByName(nameless)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
