"""Exact deduplication with a heavy-hitter split.

Spark's ``approx_top_k`` is a mergeable frequent-items sketch of the Misra-Gries family: it returns every digest that
holds more than ``1 / tracked`` of the rows. Its candidates are verified by an exact count; the verified winners are
broadcast, so their copies are resolved map-side. The remaining digests, none of them frequent, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.text import join_decisions, or_empty, squeeze
from graphloom.runtime import broadcast_if_few, stage

#: A digest is frequent if it holds at least 1/SHARE of the rows; so at most SHARE digests are broadcast.
SHARE = 1000
#: Counters of the frequent-items sketch; it misses no digest above 1/(0.75 * TRACKED) of the rows.
TRACKED = 8192


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256, and ``_hash`` of the raw text.

    Null text counts as empty; texts equal up to runs of white space form a group. The smallest non-null id of a
    group stays. Rows with a null id never displace others; if all ids of a group are null they all count as kept.
    A repeated row (same id and text) is the same document, so its copies carry the same result. An empty table gives
    no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    slim = docs.select(
        F.col(key).alias("id"),
        F.unhex(F.sha2(squeeze(or_empty(text)), 256)).alias("digest"),
        F.xxhash64(or_empty(text)).alias("_hash"),
    )
    slim = stage(slim, "digests")
    rows = slim.count()
    frequent = slim.select(F.xxhash64("digest").alias("h")).agg(
        F.expr(f"approx_top_k(h, {share}, {max(TRACKED, share)})").alias("top")
    )
    candidates = frequent.select(F.explode("top.item").alias("h")).distinct()
    verified = (
        slim.withColumn("h", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "h", "left_semi")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") * share >= F.lit(rows))
    )
    verified = stage(verified, "winners")
    hot = slim.join(F.broadcast(verified), "digest")
    same = Window.partitionBy("digest")
    rest = slim.join(F.broadcast(verified.select("digest")), "digest", "left_anti").withColumns(
        {"keep_id": F.min("id").over(same), "group_size": F.count(F.lit(1)).over(same)}
    )
    return hot.unionByName(rest).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "_hash",
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, in their own columns."""
    marked = stage(exact_dedup(docs, key, text), "marked")
    gone = marked.filter(~F.col("kept")).select(F.col(key).alias("_id"), "_hash").distinct()
    kept = join_decisions(docs, gone, "left_anti", key, text).select("d.*")
    # What is left of a group has one id; only rows repeated with that id are more than one.
    same = marked.filter("kept").groupBy(F.col(key).alias("_id"), "text_sha256").count().filter("count > 1")
    if same.isEmpty():
        return kept
    digest = F.sha2(squeeze(or_empty(text)), 256)
    same = broadcast_if_few(same)
    on = F.col(f"k.`{key}`").eqNullSafe(F.col("s._id")) & (F.col("k._digest") == F.col("s.text_sha256"))
    k, s = kept.withColumn("_digest", digest).alias("k"), same.alias("s")
    once = k.join(s, on, "left_anti").select("k.*").drop("_digest")
    again = k.join(s, on, "left_semi").select("k.*").dropDuplicates([key, "_digest"]).drop("_digest")
    return once.unionByName(again)
