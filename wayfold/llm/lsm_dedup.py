"""Exact deduplication through a log-structured merge index of text digests, in DataFrame operations only.

Memtables: documents are dealt to runs by a hash of their id, so a text that fills a third of the table is spread over
all runs and becomes one row in each. A flush writes a run as a Parquet file sorted by digest: each digest with its
smallest and largest identifier and its count. A run's filter is a column of its own, the 64-bit fingerprints of its
digests, which is read without them. Probing lays the filters of all runs over each other; a digest whose fingerprint no
other run holds is settled inside its run. Compaction merges the other rows alone and keeps the smallest and largest
identifiers, which are the result's. Every hit's bytes are verified: the texts of a digest are compared by grouping on
them, and where one digest has several texts, these decide in its stead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import drop_path, hot_lookup, may_be_in, new_path, texts_of, written


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """Sorted runs of (digest, fingerprint, smallest, largest, n) below one folder."""

    ROWS = "run long, digest binary, fingerprint long, smallest long, largest long, n long"

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.folder, self.digest = spark, folder or new_path(spark, "digests"), digest

    def digests(self, docs: DataFrame) -> DataFrame:
        return texts_of(docs).select("doc_id", self.digest(F.col("text")).alias("digest"))

    def flush(self, digests: DataFrame, runs: int) -> None:
        """Adds ``runs`` sorted runs, a file each, made of ``doc_id, digest`` rows."""
        dealt = digests.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(runs))).repartition(runs, "run")
        memtables = dealt.groupBy("run", "digest").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        memtables = memtables.select("run", "digest", F.xxhash64("digest").alias("fingerprint"), "smallest", "largest", "n")
        memtables.sortWithinPartitions("run", "digest").write.mode("append").parquet(self.folder)

    def runs(self) -> DataFrame:
        return self.spark.read.schema(self.ROWS).parquet(self.folder)

    def suspects(self) -> DataFrame:
        """The fingerprints that more than one run's filter holds."""
        return self.runs().groupBy("fingerprint").count().filter("count > 1").select("fingerprint")

    def hits(self) -> DataFrame:
        """``digest, smallest, largest, n`` of every digest met more than once: merged where filters meet, else as its run has it."""
        suspects, _ = written(self.suspects(), "suspects")
        merged = may_be_in(self.runs(), "fingerprint", suspects).join(suspects, "fingerprint", "left_semi")
        merged = merged.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
        settled = self.runs().filter("n > 1").join(suspects, "fingerprint", "left_anti")
        return merged.filter("n > 1").unionByName(settled.select("digest", "smallest", "largest", "n"))


def exact_dedup(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` of every document; of equal texts the ``keep`` id stays.

    Nulls: a null text is empty; null doc_ids count in their group and are never the one that stays unless the whole
    group is null (then keep_id is null and kept is false). Rows with the same doc_id and text share their fate. An
    empty table gives no rows.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    spark = docs.sparkSession
    index = DigestIndex(spark, digest=digest)
    digests, _ = written(index.digests(docs), "digest-rows")
    index.flush(digests, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hits, _ = written(index.hits().select("digest", F.struct(F.col(keep).alias("keep_id"), F.col("n").alias("group_size")).alias("class")), "digest-hits")
    drop_path(spark, index.folder)
    texts = may_be_in(texts_of(docs).withColumn("digest", digest(F.col("text"))), "digest", hits)
    best = F.max if keep == "largest" else F.min
    # byte verification: equal texts become one row before they are shuffled
    verified = texts.groupBy("digest", "text").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    shared, _ = written(verified.filter("texts > 1").select("digest"), "shared-digests")
    found = hot_lookup(digests, "digest", hits, "class")
    plain = found
    if not shared.isEmpty():  # one digest, several texts: those documents are matched by their bytes
        plain = found.join(shared, "digest", "left_anti")
        apart = texts.join(shared, "digest")
        by_text = apart.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.withColumn("class", F.struct("keep_id", "group_size")).select(F.col("digest").alias("_d"), F.col("text").alias("_t"), "class")
        matched = apart.join(by_text, (F.col("digest") == F.col("_d")) & (F.col("text") == F.col("_t"))).select("doc_id", "digest", "class")
        plain = plain.select("doc_id", "digest", "class").unionByName(matched)
    keep_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class.keep_id"))
    out = plain.select("doc_id", keep_id.alias("keep_id"), F.coalesce("class.group_size", F.lit(1).cast("long")).alias("group_size"), "digest")
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "digest")
