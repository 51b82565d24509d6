"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by byte length and a hash of a normalised prefix; only rows that share a group
have their whole text hashed, and are grouped by that. The texts are read twice, and none crosses
a shuffle: the (length, prefix) keys that rows share are broadcast while they are few (checked by
counting them); beyond that every text is hashed, in the same pass. The hashes are stored, and all
that follows reads these.

Defined cases: null text is the empty text; texts that differ only in A-Z case are equal; very
long texts are hashed whole; of a group the row with the largest id stays (a null id is the
smallest); rows that repeat an id are one document, share its verdict and count one by one in
group_size (keep_one keeps one of them); an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import Scratch, keep_rows, lower_ascii, read_table

#: Characters of the prefix that the second refinement hashes.
PREFIX_CHARS = 256
#: Most (length, prefix hash) keys that are broadcast, 16 bytes each, and most groups, with a digest each.
BROADCAST_KEYS, BROADCAST_GROUPS = 500_000, 100_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id_col, keep_id, group_size, kept, digest) for every row of docs.

    digest is the SHA-256 of the normalised text: of surviving rows, or of all rows with digest_all.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    prefix = F.xxhash64(lower_ascii(F.substring(text, 1, PREFIX_CHARS)))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.octet_length(text).alias("n"), prefix.alias("p"))
    # partial aggregates, so a large group is a row a task here
    shared = rows.groupBy("n", "p").agg(F.count("*").alias("c")).where("c > 1")
    shared = scratch.save(shared.select(F.col("n").alias("of_n"), F.col("p").alias("of_p")))
    if shared.count() <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(shared), (F.col("n") == F.col("of_n")) & (F.col("p") == F.col("of_p")), "left").withColumn("live", F.col("of_n").isNotNull())
    else:
        marked = rows.withColumn("live", F.lit(True))
    digest = F.when(F.col("live") | F.lit(digest_all), F.sha2(lower_ascii(F.col("t")), 256))
    hashed = scratch.save(marked.select("id", "n", "live", digest.alias("h")))
    groups = hashed.where("live").groupBy("n", "h").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.save(groups.withColumnsRenamed({"n": "group_n", "h": "group_h"}))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    out = hashed.join(groups, (F.col("n") == F.col("group_n")) & (F.col("h") == F.col("group_h")), "left")
    keep = F.when(F.col("group_n").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("h").alias("digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stay of their group; of repeated rows one."""
    verdicts = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    key = F.xxhash64(F.sha2(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), 256))
    return keep_rows(docs, verdicts.select(F.col(id_col).alias("id"), F.xxhash64("digest").alias("key"), "kept"), key, id_col)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of documents."""
    return exact_dedup(read_table(spark, sf_dir, "documents"), digest_all=True).withColumnRenamed("digest", "text_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
