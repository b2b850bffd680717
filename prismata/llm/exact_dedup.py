"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

1. Each text is hashed once; (doc_id, digest) is written to the shared folder.
2. A Misra-Gries summary (Spark's built-in frequent-items sketch, merged in two steps)
   names the digests that may exceed a share of the rows. Its error is at most 3.5 / tracked of
   the rows, so no digest above the share is missed.
3. One more aggregation counts those candidates exactly. The verified winners number 1 / share at
   most, whatever the input's size; they are broadcast and decided on the map side.
4. The other digests, each under the share, take an ordinary shuffle: those that come more than once are aggregated
   and written, then joined, so that no task needs all rows of a digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frequent, quoted, table, text_or_empty, written

#: A digest with more than this share of the rows is hot: at most 1000 digests can be.
SHARE = 0.001
#: Counters of the summary, and how many of its items are verified (more than 1 / (SHARE - 3.5 / TRACKED)).
TRACKED, CANDIDATES = 16384, 2048


def exact_dedup(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Texts are equal when identical. Of equal texts the largest doc_id
    is kept; rows that repeat the kept doc_id are all marked kept, and so are rows without doc_id
    in a group that has none. An empty table gives no rows. Other columns are ignored.
    """
    digests = written(quoted(docs, ["doc_id", "text"]).select("doc_id", F.unhex(F.sha2(text_or_empty(), 256)).alias("digest")), "digests")
    summary = frequent(digests, "hex(digest)", TRACKED, CANDIDATES)
    candidates = summary.select(F.explode("top").alias("t"), "n").select(F.unhex(F.col("t.item")).alias("digest"), (F.col("n") * share).alias("limit")).where(F.col("t.count") > F.col("limit"))
    winners = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest", "limit")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where(F.col("group_size") > F.col("limit"))
        .drop("limit")
    )
    winners = written(winners, "winners")
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = written(rest.groupBy("digest").agg(F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "groups")
    rest = rest.join(groups, "digest", "left").select("digest", "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"))
    return hot.select(rest.columns).unionAll(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
