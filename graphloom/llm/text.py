"""Text expressions that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]+"


def or_empty(text: str = "text") -> Column:
    """The text column, empty where null."""
    return F.coalesce(F.col(text), F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Each run of white space replaced by one space."""
    return F.regexp_replace(text, SPACE, " ")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_decisions(docs: DataFrame, decisions: DataFrame, how: str, key: str = "doc_id", text: str = "text", measure: bool = True) -> DataFrame:
    """Join documents with decisions keyed by ``_id`` and ``_hash`` (the id, and a hash of the text: rows equal in both are one document).

    The decisions are broadcast if they are few; else, or without ``measure``, both sides shuffle.
    """
    from graphloom.runtime import broadcast_if_few

    d, x = docs.alias("d"), (broadcast_if_few(decisions) if measure else decisions).alias("x")
    here = F.xxhash64(F.coalesce(F.col(f"d.`{text}`"), F.lit("")))
    return d.join(x, F.col(f"d.`{key}`").eqNullSafe(F.col("x._id")) & (here == F.col("x._hash")), how)
