"""Exact deduplication against a persistent digest index, with DataFrame functions only.

The index is a Parquet table of (text_sha256, keep_id, group_size), bucketed and sorted by digest. A batch of
documents is reduced to one row per digest, deduplicated against the index by a sort-merge anti-join, whether the index holds rows or not, and
appended. Digests that hold at least one row in a thousand of the batch itself (so at most
1,000 of them, whatever the index holds) are joined back by broadcast, so a group of a third of all rows never meets in one task.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import Workspace, plan_bytes, shared_dir

#: A digest with 1/HOT_SHARE of a batch's rows is broadcast: at most HOT_SHARE rows.
HOT_SHARE = 1000
#: Bytes of documents for each bucket of a new index; their digests are about a fortieth of that.
BUCKET_BYTES = 4 << 30
#: Most buckets that Spark allows a table.
MOST_BUCKETS = 100_000


def text_digest(text: str | F.Column) -> F.Column:
    """SHA-256 (lowercase hex) of the text, null as empty, each run of [\\x20\\x09-\\x0D] as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text if not isinstance(text, str) else F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


class DigestIndex:
    """The digests seen so far. Opening the same ``path`` again continues with what it holds."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """``buckets`` is fixed when an index is made (default: the session's shuffle partitions) and stored beside its rows.

        Opening an existing index takes the stored number; asking for another one is an error.
        """
        self.spark, self.path = spark, path
        layout = f"{path}-layout"
        try:
            stored = spark.read.schema("buckets int").parquet(layout).first()
        except AnalysisException:
            stored = None
        if stored and buckets not in (None, stored.buckets):
            raise ValueError(f"the index has {stored.buckets} buckets, not {buckets}")
        self.buckets = stored.buckets if stored else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not stored:
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.mode("overwrite").parquet(layout)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (text_sha256 STRING, keep_id BIGINT, group_size BIGINT) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """One row (text_sha256, keep_id, group_size) for each digest of a batch (id, text_sha256) that the index doesn't hold."""
        fresh = digests.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        self.spark.catalog.refreshTable(self.name)
        #: A group's size is never 0; asking for it keeps the optimizer from moving the join below the aggregate, where every copy of a hot text would meet in one task.
        held = self.table().select(F.col("text_sha256").alias("held")).hint("merge")
        return fresh.join(held, (F.col("text_sha256") == F.col("held")) & (F.col("group_size") > 0), "left_anti")

    def add(self, digests: DataFrame) -> None:
        """Append what the index lacks. Adding a batch again appends nothing, so a batch that was broken off can be rerun."""
        fresh = self.unseen(digests).repartition(self.buckets, "text_sha256")
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def hot_digests(digests: DataFrame) -> DataFrame:
    """Digests that hold at least 1/HOT_SHARE of the batch's rows: HOT_SHARE rows at most."""
    least = max(-(-digests.count() // HOT_SHARE), 2)
    return digests.groupBy("text_sha256").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("text_sha256")


def exact_duplicates(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of the batch: id, keep_id, group_size, kept, text_sha256; the batch's new digests join the index.

    Of equal texts the smallest id stays, or the one the index already holds from an
    earlier batch, as that one has been passed on; group_size counts the rows of the batch that brought the digest in. Null and empty texts are equal.
    A row with a null id is never the one that stays unless its group has no other id. Rows that repeat id and
    text are all ``kept`` if that id stays. Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(index.spark, "exact-dedup")
    digests = work.save(docs.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("text_sha256")), "digests")
    index.add(digests)
    seen = index.table()
    hot = work.save(hot_digests(digests), "hot").select(F.col("text_sha256").alias("hot"))
    marked = digests.join(F.broadcast(hot), F.col("text_sha256") == F.col("hot"), "left")
    #: Both broadcasts hold at most HOT_SHARE rows: the index's rows of hot digests, and the digests themselves.
    known = seen.join(F.broadcast(hot), F.col("text_sha256") == F.col("hot"), "left_semi")
    warm = marked.where("hot is not null").select("id", "text_sha256").join(F.broadcast(known), "text_sha256")
    cold = marked.where("hot is null").select("id", "text_sha256").join(seen.hint("merge"), "text_sha256")
    return warm.unionByName(cold).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def fresh_index(spark: SparkSession, docs: DataFrame | None = None) -> DigestIndex:
    """An empty index below the shared folder, with a bucket for every ``BUCKET_BYTES`` of ``docs`` if they are more than the shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex[:12]}", min(max(least, plan_bytes(docs) // BUCKET_BYTES), MOST_BUCKETS) if docs is not None else least)
